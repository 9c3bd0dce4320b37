"""An append-only store of audit events, execution commits and snapshots in a folder that all executors share.

    events/batch=<id>/     events a batch added
    rejected/batch=<id>/   those it refused, with a code
    heads/version=<n>/     the head of every review after n batches, and the id of the batch

A batch is committed by writing the next version of the heads, which only one writer can: a
version that exists is never written again. Readers see the events of the batches that the
heads name, so a batch that failed half-way shows nothing, and a batch that comes again
changes nothing. Snapshots and commits lie under the digest of their content.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENESIS = "GENESIS"
EVENT = ("review_id", "seq", "event_id", "event_type", "payload", "previous_hash", "event_hash")
HEADS = "review_id string, head string, n long"


class ConflictError(ValueError):
    """An id that is in the store with other content, or a version that another writer took."""


def versions(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """The names after ``prefix`` of the folders in a folder that were written whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    whole = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(p.getPath().getName().removeprefix(prefix) for p in fs.listStatus(path) if p.getPath().getName().startswith(prefix) and whole(p.getPath()))


def heads(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    """(version, heads): how many batches are committed, and the head and length of each review."""
    known = versions(spark, f"{root}/heads", "version=")
    if not known:
        return 0, spark.createDataFrame([], HEADS)
    return int(known[-1].split("-")[0]), spark.read.schema(HEADS).parquet(f"{root}/heads/version={known[-1]}")


def committed(spark: SparkSession, root: str) -> list[str]:
    """The ids of the committed batches, in order."""
    return [v.split("-", 1)[1] for v in versions(spark, f"{root}/heads", "version=")]


def read_events(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The events of all committed batches."""
    batches = committed(spark, root)
    return spark.read.schema(schema).parquet(*(f"{root}/events/batch={b}" for b in batches)) if batches else spark.createDataFrame([], schema)


def content(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def sorted_out(batch: DataFrame, stored: DataFrame, now: DataFrame) -> DataFrame:
    """batch with verdict: append, replay (in the store already) or a code.

    An id with other content conflicts, in the store or in the batch; equal rows of the batch are one event. What is left
    must continue its review's chain in order of seq; from the first that doesn't, the rest of that review is refused.
    """
    own = content(*(c for c in EVENT if c != "seq")).alias("content")
    rows = batch.select(*EVENT, own).groupBy("event_id", "content").agg(*(F.min_by(c, "seq").alias(c) for c in EVENT if c != "event_id"))
    twice = F.count("*").over(Window.partitionBy("event_id")) > 1
    known = stored.select("event_id", content(*(c for c in EVENT if c != "seq")).alias("stored"))
    rows = rows.withColumn("twice", twice).join(known, "event_id", "left")
    verdict = F.when(F.col("stored") == F.col("content"), "replay").when(F.col("stored").isNotNull() | F.col("twice"), "conflicting_event_id")
    rows = rows.withColumn("verdict", verdict)
    order = Window.partitionBy("review_id").orderBy("seq", "event_id")
    fresh = rows.where("verdict IS NULL").join(now, "review_id", "left")
    before = F.coalesce(F.lag("event_hash").over(order), F.col("head"), F.lit(GENESIS))
    breaks = F.when(~F.coalesce(F.col("previous_hash") == before, F.lit(False)), 1).otherwise(0)
    fresh = fresh.withColumn("breaks", breaks).withColumn("broken", F.max("breaks").over(order))
    code = F.when(F.col("broken") == 0, "append").when(F.col("breaks") == 1, "previous_hash_mismatch").otherwise("after_refused_event")
    return rows.where("verdict IS NOT NULL").select(*EVENT, "verdict").unionByName(fresh.select(*EVENT, code.alias("verdict")))


def append_events(batch: DataFrame, root: str, batch_id: str) -> DataFrame:
    """Commit a batch of events once; returns (event_id, verdict) of what it did, also when it comes again."""
    spark = batch.sparkSession
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in batch.select(*EVENT).schema)}, verdict string"
    done = lambda: spark.read.schema(schema).parquet(f"{root}/events/batch={batch_id}", f"{root}/rejected/batch={batch_id}")
    if batch_id in committed(spark, root):
        return done().select("event_id", "verdict")
    version, now = heads(spark, root)
    stored = read_events(spark, root, schema)
    # only the batch's own ids and reviews are looked up
    verdicts = sorted_out(batch, stored.join(batch.select("event_id").distinct(), "event_id", "left_semi"), now)
    verdicts.where("verdict = 'append'").write.mode("overwrite").parquet(f"{root}/events/batch={batch_id}")
    verdicts.where("verdict <> 'append'").write.mode("overwrite").parquet(f"{root}/rejected/batch={batch_id}")
    added = spark.read.schema(schema).parquet(f"{root}/events/batch={batch_id}").groupBy("review_id").agg(F.max_by("event_hash", "seq").alias("last"), F.count("*").alias("more"))
    after = now.join(added, "review_id", "full").select("review_id", F.coalesce("last", "head").alias("head"), (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
    take_version(after, root, version + 1, batch_id)
    return done().select("event_id", "verdict")


def take_version(rows: DataFrame, root: str, version: int, batch_id: str) -> None:
    """Compare and set: write the heads as this version unless another writer has it."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/claims/{version:020d}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    try:
        claim = fs.create(path, False)  # fails if it exists
        claim.write(bytearray(batch_id.encode()))
        claim.close()
    except Exception as e:
        held = fs.open(path)
        mine = bytes(held.readAllBytes()).decode() == batch_id
        held.close()
        if not mine:
            raise ConflictError(f"version {version} is taken") from e
    rows.write.mode("overwrite").parquet(f"{root}/heads/version={version:020d}-{batch_id}")


def append_stream(events: DataFrame, root: str, checkpoint: str, name: str = "stream"):
    """Append each micro-batch of a stream; a batch that is run again after a failure commits once."""
    return events.writeStream.foreachBatch(lambda batch, i: append_events(batch, root, f"{name}-{i:012d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digest(rows: DataFrame) -> tuple[str, int]:
    """(digest, number) of the rows as a multiset: SHA-256 over the count and the sum of the rows' own digests, part by part.

    Sums don't depend on order, and equal rows count as often as they come.
    """
    own = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(4)]
    r = rows.select(own.alias("h")).agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256).alias("d"), F.count("*").alias("n")).first()
    return r["d"], r["n"]


def write_snapshot(rows: DataFrame, root: str, name: str) -> dict:
    """Write a derived table under the digest of its content, unless it is there; returns its receipt."""
    if not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"snapshot name {name!r}: letters, digits, - and _ only")
    d, n = digest(rows)
    folder = f"{root}/snapshots/{name}"
    if d not in versions(rows.sparkSession, folder, ""):
        rows.write.mode("overwrite").parquet(f"{folder}/{d}")
    return {"name": name, "path": f"snapshots/{name}/{d}", "digest": d, "rows": n}


def commit_execution(commit_id: str, parts: dict[str, DataFrame], root: str) -> dict:
    """Write an execution's tables (receipt, records, event) as one immutable commit; again with the same content it is the same commit."""
    spark = next(iter(parts.values())).sparkSession
    if not commit_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"commit id {commit_id!r}: letters, digits, - and _ only")
    whole = {name: digest(rows) for name, rows in sorted(parts.items())}
    folder = f"{root}/commits/{commit_id}"
    manifest = spark.createDataFrame([(name, d, n) for name, (d, n) in whole.items()], "part string, digest string, rows long")
    if versions(spark, folder, "manifest"):
        there = {r["part"]: (r["digest"], r["rows"]) for r in spark.read.parquet(f"{folder}/manifest").collect()}  # a row for each part
        if there != whole:
            raise ConflictError(f"commit {commit_id} exists with other content")
    else:
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{folder}/parts/{name}")
        try:
            manifest.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest")
        except AnalysisException as e:
            raise ConflictError(f"commit {commit_id} was written meanwhile") from e
    return {"commit_id": commit_id, "path": f"commits/{commit_id}", "parts": {name: d for name, (d, _) in whole.items()}}
