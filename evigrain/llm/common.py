"""Helpers that several operators share: materialising and connected components."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster is refused."""
    got = spark.sparkContext.getCheckpointDir() or spark.conf.get(SHARED, None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED} to a folder that the driver and all executors share")
        import tempfile

        got = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(got)
    return got


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts the lineage. An application's tables are in one folder, named by its id."""
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions, which the user sizes to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give the memory that this process has freed back to the system. Workers are kept for later tasks, and with them what their largest task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def releasing(run):
    """``run``, a function for mapInArrow, with release() before and after each task."""

    def task(batches):
        release()
        yield from run(batches)
        release()

    return task


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: rows (node, component), component the smallest node.

    Alternates the large-star and small-star steps until the edges stop changing. A step
    joins each node with its smallest neighbour, so it never gathers a node's neighbours;
    Spark can split the join at a node with many. Nodes without an edge to another node
    don't appear. Null ends drop out.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    now, before = materialise(now), None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        now = materialise(small)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state




def carried(docs: DataFrame, carry, **columns) -> DataFrame:
    """``columns`` under their new names, and the columns named in ``carry`` in one struct ``rest`` that keeps clear of them."""
    return docs.select(*(c.alias(name) for name, c in columns.items()), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in carry)).alias("rest"))


def rest_ddl(rows: DataFrame) -> str:
    return f"rest {rows.schema['rest'].dataType.simpleString()}"


def uncarried(rows: DataFrame, carry, *columns) -> DataFrame:
    return rows.select(*columns, *(F.col(f"rest.`{c}`").alias(c) for c in carry))


def tile_labels(same: np.ndarray, v: np.ndarray, h: np.ndarray):
    """(node, label): for each row id v and column id h of a Boolean link matrix the smallest id linked with it, where it has a link."""
    big = np.iinfo(np.int64).max
    rows, columns = np.flatnonzero(same.any(axis=1)), np.flatnonzero(same.any(axis=0))
    same, v, h = same[np.ix_(rows, columns)], v[rows], h[columns]
    node = np.concatenate((v, h))
    while len(node):
        h2 = np.minimum(h, np.where(same, v[:, None], big).min(axis=0))
        v2 = np.minimum(v, np.where(same, h2[None, :], big).min(axis=1))
        if (h2 == h).all() and (v2 == v).all():
            break
        v, h = v2, h2
    return node, np.concatenate((v, h))
