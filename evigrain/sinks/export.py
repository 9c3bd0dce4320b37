"""Rendering records: JSON lines, CSL, RIS, NBIB and CSV text, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def lines(*parts: Column) -> Column:
    """The parts that are not null, one line each; an array gives a line for each item."""
    return F.array_join(F.flatten(F.array_compact(F.array(*parts))), "\n")


def one(tag: str, x: Column, sep: str) -> Column:
    return F.when(x.isNotNull(), F.array(F.concat(F.lit(tag + sep), x)))


def many(tag: str, x: Column, sep: str) -> Column:
    return F.transform(x, lambda v: F.concat(F.lit(tag + sep), v))


def one_line(records: DataFrame) -> DataFrame:
    """records whose abstract is one line, as RIS and NBIB need: a space for each run of line ends."""
    return records.withColumn("abstract", F.regexp_replace("abstract", r"[\r\n]+", " "))


def ris(records: DataFrame) -> DataFrame:
    sep = "  - "
    text = lines(one("TY", T.ris_type(F.col("kind")), sep), one("ID", F.col("record_id"), sep), one("TI", F.col("title"), sep), many("AU", F.col("authors"), sep), one("JO", F.col("container"), sep), one("PY", F.col("year").cast("string"), sep), one("AB", F.col("abstract"), sep), one("DO", F.col("doi"), sep), F.array(F.lit("ER  - ")))
    return records.select("record_id", text.alias("ris"))


def nbib(records: DataFrame) -> DataFrame:
    pad = lambda tag: tag.ljust(4)
    sep = "- "
    text = lines(one(pad("PMID"), F.col("pmid"), sep), one(pad("TI"), F.col("title"), sep), many(pad("FAU"), F.col("authors"), sep), one(pad("JT"), F.col("container"), sep), one(pad("DP"), F.col("year").cast("string"), sep), one(pad("AB"), F.col("abstract"), sep), one(pad("LID"), F.concat("doi", F.lit(" [doi]")), sep))
    return records.select("record_id", text.alias("nbib"))


def csv(records: DataFrame) -> DataFrame:
    """All fields quoted; authors joined by a semicolon."""
    fields = [F.col("record_id"), F.col("n").cast("string"), F.col("title"), F.array_join("authors", "; "), F.col("year").cast("string"), F.col("doi"), F.col("pmid"), F.col("container")]
    return records.select("record_id", F.concat_ws(",", *map(T.csv_escape, fields)).alias("line"))


def csl(records: DataFrame) -> DataFrame:
    item = F.struct(F.col("record_id").alias("id"), T.csl_type(F.col("kind")).alias("type"), "title", F.transform("authors", lambda a: F.struct(a.alias("literal"))).alias("author"), F.col("container").alias("container-title"), F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year")).alias("date-parts"))).alias("issued"), F.col("doi").alias("DOI"), F.col("pmid").alias("PMID"))
    return records.select("record_id", F.to_json(item).alias("csl"))


def jsonl(records: DataFrame) -> DataFrame:
    return records.select("record_id", F.to_json(F.struct(*records.columns)).alias("line"))


def receipt(read: DataFrame, written: DataFrame, fmt: str, key: str = "record_id") -> DataFrame:
    """One row: what a conversion read and wrote, with a digest of the ids of both (independent of order)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"records_{name}"), F.bit_xor(F.conv(F.substring(F.md5(F.col(key)), 1, 12), 16, 10).cast("long")).alias(f"digest_{name}"))

    both = side(read, "read").withColumn("one", F.lit(1)).join(side(written, "written").withColumn("one", F.lit(1)), "one").drop("one")
    return both.select(F.lit(fmt).alias("format"), "*", (F.col("records_written") <= F.col("records_read")).alias("bounded"))
