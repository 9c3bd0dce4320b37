"""Gated requests against a sequential loop, in batch and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from evigrain.operators import access

DDL = "tenant string, actor string, request string, at timestamp, seq long, blocker string"


def made(spark, seed=0, n=600):
    rng, at, rows = random.Random(seed), 0, []
    for seq in range(n):
        at += rng.choice([0, 0, 1, 2, 5, 30, 61])
        rows.append((rng.choice(["t1", "t1", "t2", None]), rng.choice(["a", "b", None]), rng.choice([f"q{rng.randint(0, 25)}", None]), at, seq, rng.choice([None, None, None, "access.scope.denied"])))
    frame = spark.createDataFrame(rows, "tenant string, actor string, request string, at long, seq long, blocker string")
    return rows, frame.withColumn("at", F.timestamp_seconds("at"))


def brute(rows, limit, capacity):
    times, ledger, out = {}, {}, {}
    for tenant, actor, request, at, seq, blocker in sorted(rows, key=lambda r: (r[3], r[4])):
        seen = [x for x in times.get((tenant, actor), []) if x >= at - 60]
        ids = ledger.setdefault(tenant, [])
        if len(seen) >= limit:
            out[seq] = "access.rate.exceeded"
        elif blocker:
            out[seq] = blocker
        elif request in ids:
            out[seq] = "access.replay.request_reused"
        else:
            out[seq] = None
            seen.append(at)
            ids.append(request)
            del ids[:-capacity]
        times[tenant, actor] = seen
    return out


@pytest.mark.parametrize("limit,capacity", [(3, 5), (1, 1), (50, 4096), (2, 0)])
def test_gated(spark, limit, capacity):
    rows, frame = made(spark, limit)
    got = {r.seq: r.denied for r in access.gated(frame, limit, capacity).collect()}
    want = brute(rows, limit, max(capacity, 1))
    assert got == want
    if limit == 3:
        assert {"access.rate.exceeded", "access.replay.request_reused", "access.scope.denied", None} == set(want.values())


def test_the_first_id_is_forgotten_when_one_more_is_accepted(spark):
    rows = [("t", "a", q, i * 100, i, None) for i, q in enumerate(["x", "y", "x", "z", "x", "y"])]
    frame = spark.createDataFrame(rows, "tenant string, actor string, request string, at long, seq long, blocker string").withColumn("at", F.timestamp_seconds("at"))
    got = [r.denied is None for r in access.gated(frame, 10, 2).orderBy("seq").collect()]
    assert got == [True, True, False, True, True, True]


def test_empty(spark):
    assert access.gated(spark.createDataFrame([], DDL), 3).count() == 0


def test_stream(spark, tmp_path):
    from evigrain.streaming import access_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, frame = made(spark, 7, 300)
    source = str(tmp_path / "in")
    last = [0, 90, 91, 200, 300]
    for lo, hi in zip(last, last[1:]):
        frame.where(F.col("seq").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(source)
    q = access_stream.gated_stream(stream, 3, 5).writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    assert {r.seq: r.denied for r in spark.table("gated").collect()} == brute(rows, 3, 5)
