"""Readers of event folders: ordered segment files, and receipts named by their request.

    <root>/<review>/audit.jsonl                        events of an older form, a line each
    <root>/<review>/events/<ordinal>-<hash>.json       one event a file, numbered on from there
    <root>/<review>/lifecycle/receipts/<request>.json

A file's name says what it holds; readers check it against the content.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def texts(spark: SparkSession, pattern: str, back: int, whole: bool = False) -> DataFrame:
    """(review, file, line) of the files of a pattern, a row a line that isn't blank or a row a file; review is the folder so many steps up. No files give no rows."""
    try:
        rows = spark.read.text(pattern, wholetext=whole)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "review string, file string, line string")
    steps = F.split("_metadata.file_path", "/")
    return rows.select(F.url_decode(F.element_at(steps, -back)).alias("review"), F.url_decode(F.element_at(steps, -1)).alias("file"), F.col("value").alias("line")).where(F.col("line").rlike(r"\S"))


def one_a_file(rows: DataFrame) -> DataFrame:
    """(review, file, rows, line): how many lines a file has, and the first of them in order."""
    return rows.groupBy("review", "file").agg(F.count("*").alias("rows"), F.min("line").alias("line"))


def field(name: str) -> Column:
    return F.try_variant_get(F.try_parse_json("line"), f"$.{name}", "string")


def event_segments(spark: SparkSession, root: str) -> DataFrame:
    """(review, ordinal, file, event_id, event_hash, event, problem) of all segment files, in the order of their names.

    The ordinals of a review go on after its events of the older form. problem is null, not_one_event, not_json, or
    unexpected_name where a file is not named by its ordinal and hash, as after a gap.
    """
    older = texts(spark, f"{root}/*/audit.jsonl", 2).groupBy("review").agg(F.count("*").alias("older"))
    rows = one_a_file(texts(spark, f"{root}/*/events/*.json", 3)).join(older, "review", "left")
    ordinal = F.row_number().over(Window.partitionBy("review").orderBy("file")) + F.coalesce("older", F.lit(0))
    rows = rows.withColumn("ordinal", ordinal).withColumn("event_hash", field("event_hash"))
    named = F.concat(F.lpad(F.col("ordinal").cast("string"), 20, "0"), F.lit("-"), F.coalesce("event_hash", F.lit("")), F.lit(".json"))
    problem = F.when(F.col("rows") != 1, "not_one_event").when(F.try_parse_json("line").isNull(), "not_json").when(F.col("file") != named, "unexpected_name")
    return rows.select("review", "ordinal", "file", field("event_id").alias("event_id"), "event_hash", F.col("line").alias("event"), problem.alias("problem"))


def lifecycle_receipts(spark: SparkSession, root: str) -> DataFrame:
    """(review, file, request_id, receipt, problem): problem is null, not_json, or name_differs from the request's id. A receipt may run over several lines."""
    rows = texts(spark, f"{root}/*/lifecycle/receipts/*.json", 4, whole=True)
    rows = rows.withColumn("request_id", F.try_variant_get(F.try_parse_json("line"), "$.request.request_id", "string"))
    problem = F.when(F.try_parse_json("line").isNull(), "not_json").when(~F.coalesce(F.col("file") == F.concat("request_id", F.lit(".json")), F.lit(False)), "name_differs")
    return rows.select("review", "file", "request_id", F.col("line").alias("receipt"), problem.alias("problem"))
