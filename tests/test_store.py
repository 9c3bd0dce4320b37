"""The append-only store: replayed, forked and failed batches, snapshots and commits."""

import os

import pytest

from evigrain.sinks import store

DDL = "review_id string, seq long, event_id string, event_type string, payload string, previous_hash string, event_hash string"


def event(review, seq, before, event_id=None, payload="{}"):
    return (review, seq, event_id or f"{review}-{seq}", "t", payload, before, f"h-{review}-{seq}")


def chain(review, lo, hi):
    return [event(review, s, f"h-{review}-{s - 1}" if s else store.GENESIS) for s in range(lo, hi)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def verdicts(got):
    return {r.event_id: r.verdict for r in got.collect()}


def stored(spark, root):
    return sorted(r.event_id for r in store.read_events(spark, root, DDL).collect())


def test_appends_replays_and_forks(spark, tmp_path):
    root = str(tmp_path / "store")
    first = frame(spark, chain("a", 0, 3) + chain("b", 0, 2))
    assert set(verdicts(store.append_events(first, root, "b1")).values()) == {"append"}
    assert set(verdicts(store.append_events(first, root, "b1")).values()) == {"append"}  # the batch again: nothing new
    assert set(verdicts(store.append_events(first, root, "b2")).values()) == {"replay"}  # its events in another batch
    more = chain("a", 3, 4) + [event("b", 2, "h-elsewhere"), event("b", 3, "h-b-2"), event("a", 1, "h-a-0", payload='{"x":1}'), event("c", 0, "h-x"), event("d", 0, store.GENESIS), event("d", 0, store.GENESIS)]
    assert verdicts(store.append_events(frame(spark, more), root, "b3")) == {"a-3": "append", "b-2": "previous_hash_mismatch", "b-3": "after_refused_event", "a-1": "conflicting_event_id", "c-0": "previous_hash_mismatch", "d-0": "append"}
    assert stored(spark, root) == ["a-0", "a-1", "a-2", "a-3", "b-0", "b-1", "d-0"]
    version, heads = store.heads(spark, root)
    assert version == 3 and {(r.review_id, r.head, r.n) for r in heads.collect()} == {("a", "h-a-3", 4), ("b", "h-b-1", 2), ("d", "h-d-0", 1)}
    both = [event("e", 0, store.GENESIS, "same", "{}"), event("e", 1, "h-e-0", "same", "[]")]
    assert verdicts(store.append_events(frame(spark, both), root, "b4")) == {"same": "conflicting_event_id"}


def test_a_batch_that_failed_half_way_shows_nothing_and_comes_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store.append_events(frame(spark, chain("a", 0, 2)), root, "b1")
    take = store.take_version

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(store, "take_version", fail)
    with pytest.raises(OSError):
        store.append_events(frame(spark, chain("a", 2, 4)), root, "b2")
    monkeypatch.setattr(store, "take_version", take)
    assert stored(spark, root) == ["a-0", "a-1"]
    assert set(verdicts(store.append_events(frame(spark, chain("a", 2, 4)), root, "b2")).values()) == {"append"}
    assert stored(spark, root) == ["a-0", "a-1", "a-2", "a-3"]


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path / "store")
    _, now = store.heads(spark, root)
    store.take_version(now, root, 1, "mine")
    with pytest.raises(store.ConflictError):
        store.take_version(now, root, 1, "theirs")
    store.take_version(now, root, 1, "mine")
    assert store.committed(spark, root) == ["mine"]


def test_stream_commits_each_batch_once(spark, tmp_path):
    root, source = str(tmp_path / "store"), str(tmp_path / "in")
    for lo, hi in ((0, 2), (2, 5), (4, 7)):
        frame(spark, chain("a", lo, hi) + chain("b", lo, hi)).coalesce(1).write.mode("append").parquet(source)
    for checkpoint in ("cp1", "cp2"):  # the second starts from nothing: all its events are there already
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(source)
        q = store.append_stream(stream, root, str(tmp_path / checkpoint), checkpoint)
        q.awaitTermination(240)
        assert q.exception() is None
        assert stored(spark, root) == sorted(f"{r}-{s}" for r in "ab" for s in range(7))


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a long, b string")
    got = store.write_snapshot(one, root, "flow")
    assert got == store.write_snapshot(one.repartition(3).select("b", "a"), root, "flow") and got["rows"] == 3
    assert store.write_snapshot(one.distinct(), root, "flow")["digest"] != got["digest"]
    assert len(os.listdir(f"{root}/snapshots/flow")) == 2 and spark.read.parquet(f"{root}/{got['path']}").count() == 3
    assert store.write_snapshot(one.limit(0), root, "empty")["rows"] == 0
    with pytest.raises(ValueError):
        store.write_snapshot(one, root, "../x")


def test_commits(spark, tmp_path):
    root = str(tmp_path)
    records, receipt = spark.range(5), spark.createDataFrame([("r1", 5)], "receipt_id string, records long")
    got = store.commit_execution("run-1", {"records": records, "receipt": receipt}, root)
    assert got == store.commit_execution("run-1", {"receipt": receipt, "records": records.orderBy("id")}, root)
    with pytest.raises(store.ConflictError):
        store.commit_execution("run-1", {"records": spark.range(6), "receipt": receipt}, root)
    assert spark.read.parquet(f"{root}/commits/run-1/parts/records").count() == 5
