"""A corpus pipeline from the operators in evigrain.llm: filter, deduplicate, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
The stages before the last return the columns of documents, under their own names and in
their own order, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm import decontaminate, jaccard_join, mixing, suffix_dedup, toxicity
from evigrain.llm.common import materialise
from evigrain.llm.window_dedup import NO_ID

REJECT = 0.7
#: A document that loses more than this share of its bytes as repeated passages goes whole: next to nothing is left of it.
NEARLY_ALL = 0.9


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns numbered, so that no name can clash with an operator's; the new names by the old."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def others(names: dict[str, str], *own: str) -> tuple[str, ...]:
    return tuple(new for old, new in names.items() if old not in own)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below REJECT."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), allowed=toxicity.remainder("doc_id", 3) != 1)
    plain, names = numbered(docs)
    scored = toxicity.score(plain, model, names["doc_id"], names["text"], carry=others(names, "doc_id"))
    return scored.where(F.col("score") < REJECT).select(*names.values()).toDF(*names)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, and all without words.

    Of rows with the same doc_id and text one stays, the least by a hash of the other columns; those with the same
    doc_id and different texts are different documents. Ids alone are grouped; the texts are shuffled once, by the same plan at every size.
    """
    found = jaccard_join.groups(docs)
    kept = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc", "uid")).alias("k")).select("k.*")
    kept = materialise(kept.unionByName(found.where("group IS NULL").select("doc", "uid")).groupBy("doc", "uid").agg(F.count("*").alias("rows")))
    plain, names = numbered(docs)
    doc_id = F.col(names["doc_id"]).cast("long")
    keyed = plain.withColumns({"doc": F.coalesce(doc_id, F.lit(NO_ID)), "uid": F.xxhash64(names["doc_id"], names["text"])})
    rows = keyed.join(kept.select("doc", "uid").hint("merge"), ["doc", "uid"], "left_semi")
    repeated = materialise(found.groupBy("doc", "uid").agg(F.count("*").alias("rows")).where("rows > 1"))
    if not repeated.isEmpty():
        other = [n for c, n in names.items() if c not in ("doc_id", "text")]
        rows = rows.groupBy("doc", "uid").agg(F.min_by(F.struct(*names.values()), F.xxhash64(F.lit(0), *other)).alias("row")).select("row.*")
    return rows.select(*names.values()).toDF(*names)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur again; one that loses more than NEARLY_ALL of its bytes goes whole.

    All others stay, with the text that repeats nowhere.
    """
    plain, names = numbered(docs)
    plain = plain.withColumn("no_text", F.col(names["text"]).isNull())
    got = suffix_dedup.remove_repeats(plain, names["doc_id"], names["text"], carry=(*others(names, "doc_id", "text"), "no_text"))
    got = got.where(F.col("n_removed") <= NEARLY_ALL * F.col("n_bytes"))
    text = F.when(~F.col("no_text"), F.col("kept_text"))
    changed = {names["text"]: text}
    if "n_chars" in names:
        changed[names["n_chars"]] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"]))
    return got.select(*(changed.get(c, F.col(c)).alias(c) for c in names.values())).toDF(*names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold the benchmark's passages."""
    plain, names = numbered(docs)
    benchmark = read(spark, sf_dir, "benchmark")
    got = decontaminate.contamination(plain, benchmark, names["doc_id"], names["text"], carry=others(names, "doc_id"))
    return got.where(~decontaminate.contaminated()).select(*names.values()).toDF(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.taken(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the stages; tests/llm hold each stage's decisions against hand-made cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
