"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Each URL expands into the pairs of its host and parent domains with its path's beginnings
of the lengths that rule paths have. Expressions meet rules on the first bytes of their
digests, then the full digests must agree, and the longest rule wins. Everything runs on
DataFrame functions; rows without a matching rule get ``default``.

Defined cases: null url, or one without ``://``: host and path are empty and no rule fits.
Rules with a null host, path or verdict are void. Of equal rules that differ in verdict,
the alphabetically first verdict counts. Each input row gives a row, repeated rows too.
Other columns of both inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page. rules: (host, path, verdict), hosts in lower case."""
    rules = rules.select(F.col("host").cast("string").alias("r_host"), F.col("path").cast("string").alias("r_path"), F.col("verdict").cast("string").alias("r_verdict")).dropna()
    rules = rules.groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))
    rule = F.concat("r_host", "r_path")
    digest = F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)
    rules = rules.select(rule.alias("rule"), "r_verdict", digest.alias("r_digest"), F.substring(digest, 1, PREFIX).alias("short"), F.length("r_path").alias("n"))
    lengths = [r.n for r in rules.select("n").distinct().orderBy("n").toLocalIterator()]  # few: the distinct lengths of rule paths
    lengths = F.lit(lengths) if lengths else F.array().cast("array<int>")

    parsed = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parsed = parsed.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    labels = F.split("host", r"\.")
    hosts = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    beginnings = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.left(F.col("path"), n))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(beginnings, lambda p: F.sha2(F.concat_ws("\n", h, p), 256))))
    expressions = parsed.select("row", "page_id", "host", "path", F.explode_outer(pairs).alias("digest"))
    found = expressions.withColumn("short", F.substring("digest", 1, PREFIX)).join(rules, "short", "left")
    fits = F.col("digest") == F.col("r_digest")
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("size"), "rule", "r_verdict"))).alias("best")
    got = found.groupBy("row", "page_id", "host", "path").agg(best)
    return got.select(F.col("page_id").alias(page_id), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
