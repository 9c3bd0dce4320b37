"""Bibliographic files in and out by the name of their format, with a receipt of what a conversion read and wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .sinks import export
from .sinks.store import digest
from .sources import tagged

RECORD = "record_id string, native_id string, kind string, title string, abstract string, authors array<string>, container string, year int, doi string, pmid string, subjects array<string>, languages array<string>, urls array<string>"
#: Formats that can be read and written, and the column that a written row has.
READS = ("records_json", "json_lines", "csl_json", "ris", "nbib")
WRITES = {"records_json": "line", "json_lines": "line", "csl_json": "csl", "ris": "ris", "nbib": "nbib", "csv": "line"}
CSV_HEADER = ("record_id", "title", "authors", "year", "doi", "pmid", "container")


class UnsupportedFormatError(ValueError):
    """A format that can't be read or written."""


def import_records(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(file, error, then the fields of a record) of the files at a path.

    json_lines files are split anywhere; the others are read file by file, since a record may run over lines. error is null,
    or names the line (json_lines) or the file that is not of the format. Blank lines are passed over.
    """
    if fmt not in READS:
        raise UnsupportedFormatError(f"{fmt} can't be read; formats: {', '.join(READS)}")
    fields = [f.split()[0] for f in RECORD.split(", ")]
    name = F.col("_metadata.file_path").alias("file")
    none = F.lit(None).cast("string")
    if fmt in ("json_lines", "records_json"):
        rows = spark.read.text(path, wholetext=fmt == "records_json").select(name, F.col("value").alias("raw")).where(F.col("raw").rlike(r"\S"))
        kind = f"struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in RECORD.split(', '))}>"
        value = F.try_parse_json("raw")
        good = F.substring(F.to_json(value), 1, 1) == ("{" if fmt == "json_lines" else "[")
        error = F.when(~F.coalesce(good, F.lit(False)), F.concat(F.lit("not a record: " if fmt == "json_lines" else "not a list of records: "), F.substring("raw", 1, 80)))
        parsed = F.array(F.from_json("raw", kind)) if fmt == "json_lines" else F.from_json("raw", f"array<{kind}>")
        rows = rows.select("file", error.alias("error"), F.when(error.isNull(), parsed).alias("records"))
        return rows.select("file", "error", F.explode_outer("records").alias("r")).select("file", "error", *(F.col(f"r.{c}").alias(c) for c in fields))
    files = spark.read.text(path, wholetext=True).select(name, F.col("value").alias("text"))
    if fmt == "csl_json":
        got = tagged.csl(files, "file", "text")
        read = got.select("file", none.alias("error"), *fields)
        wrong = files.where("try_parse_json(text) IS NULL OR substring(to_json(try_parse_json(text)), 1, 1) <> '['")
        return read.unionByName(wrong.select("file", F.concat(F.lit("not a list of items: "), F.substring("text", 1, 80)).alias("error")), allowMissingColumns=True)
    return tagged.tagged(files, "file", "text", fmt).select("file", none.alias("error"), *fields)


def rendered(records: DataFrame, fmt: str) -> DataFrame:
    """(record_id, text) of each record in a format; line ends inside values become spaces where the format is line by line."""
    if fmt not in WRITES:
        raise UnsupportedFormatError(f"{fmt} can't be written; formats: {', '.join(WRITES)}")
    if fmt in ("ris", "nbib"):
        records = records.withColumns({c: F.regexp_replace(c, r"[\r\n]+", " ") for c in ("title", "abstract", "container")}).withColumn("authors", F.transform("authors", lambda a: F.regexp_replace(a, r"[\r\n]+", " ")))
        got = getattr(export, fmt)(records)
        return got.select("record_id", F.concat(fmt, F.lit("\n")).alias("text"))
    if fmt == "csl_json":
        return export.csl(records).select("record_id", F.col("csl").alias("text"))
    if fmt == "csv":
        fields = [F.col(c).cast("string") if c != "authors" else F.array_join("authors", "; ") for c in CSV_HEADER]
        return records.select("record_id", F.concat_ws(",", *map(T.csv_escape, fields)).alias("text"))
    return export.jsonl(records).select("record_id", F.col("line").alias("text"))


def export_records(records: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> DataFrame:
    """Write records as text files in a folder, part by part, and return what was written as (record_id, text).

    csl_json and records_json parts hold an item a line; ``import_records`` reads RIS, NBIB and json_lines parts back.
    """
    got = rendered(records, fmt)
    got.select("text").write.mode(mode).text(path)
    return got


def conversion_receipt(review_id: str, read: DataFrame, written: DataFrame, input_format: str, output_format: str, warnings: tuple[str, ...] = (), lossless: bool = False) -> dict:
    """What a conversion read and wrote, with digests of the content of both sides, whatever the order of their rows.

    A conversion can't write more records than it read, nor be lossless with warnings.
    """
    (a, n), (b, m) = digest(read), digest(written)
    if m > n:
        raise ValueError(f"{m} records written of {n} read")
    if lossless and (warnings or m != n):
        raise ValueError("a conversion with warnings or missing records is not lossless")
    return {"operation_id": str(uuid.uuid4()), "review_id": review_id, "input_format": input_format, "output_format": output_format, "input_digest": a, "output_digest": b, "records_read": n, "records_written": m, "warnings": list(warnings), "lossless": lossless}
