"""Connected components of an edge list, by joins."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions, which the user sizes to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder all executors share (spark.checkpoint.dir) and read it back."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "inner") -> DataFrame:
    """A join by sorting both sides. Files written between steps are far smaller than their rows, so that Spark would send millions of rows through the driver."""
    return left.join(right.hint("merge"), on, how)


#: About how many pairs a task makes, and how many tasks of pairs there are at most.
PAIRS, TASKS = 20_000_000, 10_000


def tasks(spark: SparkSession, n: float | None, each: int) -> int:
    """A number of shuffle partitions for n rows or pairs: what few bytes grow to is not seen by Spark."""
    return min(max(math.ceil((n or 0) / each), parts(spark)), TASKS)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the edges (a, b): component is the smallest node reachable.

    Alternates large-star (each node's larger neighbours move to its smallest one) and small-star (its smaller neighbours do)
    until the edges stay the same, by their count and the sum of their hashes. Edges shrink towards one a node.
    """
    now, before = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = shuffled(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(shuffled(large, least, ["u"]).select(F.explode(ends).alias("e")).select("e.*").where("u != v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
