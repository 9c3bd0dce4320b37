"""Review data derived from the given tables, each as a DataFrame and as the same DuckDB SQL.

Bibliographic records come from documents, screening decisions from lineitem, resolutions
from orders, audit events from events, citation edges and study links from orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["journal_article", "preprint", "conference", "trial_registry", "thesis", "report", "dataset"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    i, n = F.col("doc_id"), F.col("n_chars")
    key = F.substring(F.md5("text"), 1, 12)
    doi = F.when(i % 8 == 0, F.concat(F.lit("https://doi.org/10.1000/"), F.upper(key))).when(i % 4 == 0, F.concat(F.lit("10.1000/"), key)).when(i % 10 == 3, F.concat(F.lit("doi:10.1000/"), key))
    authors = F.when(i % 7 == 0, F.array().cast("array<string>")).when(i % 3 == 1, F.array(F.concat("source", F.lit(" "), "lang"))).otherwise(F.array(F.concat("lang", F.lit(", "), "source"), F.concat("source", F.lit(" "), "lang")))
    return d.select(
        i.alias("n"), F.concat(F.lit("rec-"), F.lpad(i.cast("string"), 8, "0")).alias("record_id"),
        F.element_at(F.array(*map(F.lit, KINDS)), (i % 7 + 1).cast("int")).alias("kind"),
        F.regexp_extract("text", r"^[^ \n]+( [^ \n]+){0,7}", 0).alias("title"), F.when(i % 5 != 0, F.col("text")).alias("abstract"), authors.alias("authors"),
        F.when(i % 11 != 0, (1990 + n % 30).cast("int")).alias("year"), doi.alias("doi"),
        F.when(i % 6 == 0, F.concat((n * 1000 + 7).cast("string"))).alias("pmid"),
        F.when(i % 9 == 0, F.concat(F.lit(" nct"), F.lpad(n.cast("string"), 8, "0"))).alias("trial"),
        F.when(i % 2 == 0, F.concat(F.lit("Journal of "), "source")).alias("container"), F.array("source", "lang").alias("subjects"), F.col("lang").alias("language"),
    )


RECORDS = r"""records AS (
    SELECT doc_id AS n, 'rec-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS record_id,
        ['journal_article', 'preprint', 'conference', 'trial_registry', 'thesis', 'report', 'dataset'][CAST(doc_id % 7 + 1 AS INT)] AS kind,
        regexp_extract(text, '^[^ \n]+( [^ \n]+){0,7}', 0) AS title, CASE WHEN doc_id % 5 <> 0 THEN text END AS abstract,
        CASE WHEN doc_id % 7 = 0 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 3 = 1 THEN [source || ' ' || lang] ELSE [lang || ', ' || source, source || ' ' || lang] END AS authors,
        CASE WHEN doc_id % 11 <> 0 THEN CAST(1990 + n_chars % 30 AS INT) END AS year,
        CASE WHEN doc_id % 8 = 0 THEN 'https://doi.org/10.1000/' || upper(substr(md5(text), 1, 12)) WHEN doc_id % 4 = 0 THEN '10.1000/' || substr(md5(text), 1, 12)
            WHEN doc_id % 10 = 3 THEN 'doi:10.1000/' || substr(md5(text), 1, 12) END AS doi,
        CASE WHEN doc_id % 6 = 0 THEN CAST(n_chars * 1000 + 7 AS VARCHAR) END AS pmid,
        CASE WHEN doc_id % 9 = 0 THEN ' nct' || lpad(CAST(n_chars AS VARCHAR), 8, '0') END AS trial,
        CASE WHEN doc_id % 2 = 0 THEN 'Journal of ' || source END AS container, [source, lang] AS subjects, lang AS language
    FROM documents WHERE text IS NOT NULL)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decision_id, subject_id, round, reviewer_id, reviewer_kind, decision, exclusion_reason, confidence, decided_at."""
    t = table(spark, sf_dir, "lineitem")
    decision = F.when(F.col("l_returnflag") == "A", "include").when(F.col("l_returnflag") == "N", "exclude").otherwise("unclear")
    return t.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("decision_id"), F.col("l_orderkey").alias("subject_id"),
        F.when(F.col("l_linestatus") == "F", "full_text").otherwise("title_abstract").alias("round"), (F.col("l_suppkey") % 7).alias("reviewer_id"),
        F.when(F.col("l_linenumber") >= 6, "agent").otherwise("human").alias("reviewer_kind"), decision.alias("decision"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 3), F.concat(F.lit("reason-"), (F.col("l_quantity") % 5).cast("int").cast("string"))).alias("exclusion_reason"),
        (F.col("l_discount") * 11).alias("confidence"), F.col("l_shipdate").alias("decided_at"),
    )


DECISIONS = """decisions AS (
    SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS decision_id, l_orderkey AS subject_id,
        CASE WHEN l_linestatus = 'F' THEN 'full_text' ELSE 'title_abstract' END AS round, l_suppkey % 7 AS reviewer_id,
        CASE WHEN l_linenumber >= 6 THEN 'agent' ELSE 'human' END AS reviewer_kind,
        CASE l_returnflag WHEN 'A' THEN 'include' WHEN 'N' THEN 'exclude' ELSE 'unclear' END AS decision,
        CASE WHEN l_returnflag = 'N' AND l_quantity > 3 THEN 'reason-' || CAST(CAST(l_quantity AS INT) % 5 AS VARCHAR) END AS exclusion_reason,
        l_discount * 11 AS confidence, l_shipdate AS decided_at
    FROM lineitem)"""


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, round, decision: adjudicated conflicts."""
    t = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1"))
    return t.select(F.col("o_orderkey").alias("subject_id"), F.when(F.col("o_orderkey") % 2 == 0, "full_text").otherwise("title_abstract").alias("round"), F.when(F.col("o_orderstatus") == "F", "include").otherwise("exclude").alias("resolved"))


RESOLUTIONS = """resolutions AS (
    SELECT o_orderkey AS subject_id, CASE WHEN o_orderkey % 2 = 0 THEN 'full_text' ELSE 'title_abstract' END AS round,
        CASE WHEN o_orderstatus = 'F' THEN 'include' ELSE 'exclude' END AS resolved
    FROM orders WHERE o_orderpriority LIKE '1%')"""


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, seq, event_id, event_type, occurred_at, actor_kind, payload: seq orders the events of all reviews."""
    t = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "system").when(F.col("event_id") % 4 == 0, "agent").otherwise("human")
    return t.select((F.col("user_id") % 40).alias("review_id"), F.col("event_id").alias("seq"), F.concat(F.lit("ev-"), "event_id").alias("event_id"), "event_type", F.col("ts").alias("occurred_at"), F.col("user_id").alias("actor_id"), kind.alias("actor_kind"), F.col("props").alias("payload"), "value")


AUDIT_EVENTS = """audit_events AS (
    SELECT user_id % 40 AS review_id, event_id AS seq, 'ev-' || event_id AS event_id, event_type, ts AS occurred_at, user_id AS actor_id,
        CASE WHEN event_type = 'error' THEN 'system' WHEN event_id % 4 = 0 THEN 'agent' ELSE 'human' END AS actor_kind, props AS payload, value
    FROM events)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, source, target: citation edges between customers."""
    t = table(spark, sf_dir, "orders")
    return t.select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("source"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 997).alias("target"))


CITATIONS = "citations AS (SELECT o_orderkey AS edge_id, o_custkey AS source, (o_custkey * 7 + o_orderkey) % 997 AS target FROM orders)"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(previous, current) snapshots (record_id, body) of a living review."""
    o = table(spark, sf_dir, "orders")
    body = lambda price: F.concat_ws("|", F.col("o_orderstatus"), price, F.col("o_orderpriority"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    before = o.where("o_orderkey % 10 != 3").select(F.col("o_orderkey").alias("record_id"), body(cents.cast("string")).alias("body"))
    after = o.where("o_orderkey % 10 != 7").select(F.col("o_orderkey").alias("record_id"), body((cents + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)).cast("string")).alias("body"))
    return before, after


SNAPSHOTS = """before AS (SELECT o_orderkey AS record_id, o_orderstatus || '|' || CAST(round(o_totalprice * 100) AS BIGINT) || '|' || o_orderpriority AS body FROM orders WHERE o_orderkey % 10 <> 3),
after AS (SELECT o_orderkey AS record_id, o_orderstatus || '|' || (CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) || '|' || o_orderpriority AS body FROM orders WHERE o_orderkey % 10 <> 7)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow diagram's counts for each customer's orders."""
    o = table(spark, sf_dir, "orders")
    by = lambda c: F.count_if(F.expr(c))
    return o.groupBy(F.col("o_custkey").alias("review_id")).agg(
        by("o_orderkey % 3 = 0").alias("databases"), by("o_orderkey % 3 = 1").alias("registers"), by("o_orderkey % 3 = 2").alias("other"), by("o_orderkey % 10 = 0").alias("duplicates"),
        by("o_orderkey % 10 = 1").alias("automation"), F.lit(0).cast("long").alias("other_removed"), by("o_orderkey % 10 > 1").alias("screened"), by("o_orderkey % 10 > 1 AND o_orderstatus = 'F'").alias("excluded"),
        by("o_orderkey % 10 > 1 AND o_orderstatus != 'F'").alias("sought"), by("o_orderkey % 10 > 1 AND o_orderstatus = 'P'").alias("not_retrieved"),
        by("o_orderkey % 10 > 1 AND o_orderstatus = 'O'").alias("assessed"), by("o_orderkey % 10 > 1 AND o_orderstatus = 'O' AND o_orderkey % 7 < 3").alias("ft_excluded"),
        by("o_orderkey % 10 > 1 AND o_orderstatus = 'O' AND o_orderkey % 7 >= 3").alias("reports"), by("o_orderkey % 10 > 1 AND o_orderstatus = 'O' AND o_orderkey % 7 >= 4 OR o_orderkey % 50 = 2").alias("studies"),
    )


FLOWS = """flows AS (
    SELECT o_custkey AS review_id, count(*) FILTER (o_orderkey % 3 = 0) AS databases, count(*) FILTER (o_orderkey % 3 = 1) AS registers, count(*) FILTER (o_orderkey % 3 = 2) AS other,
        count(*) FILTER (o_orderkey % 10 = 0) AS duplicates, count(*) FILTER (o_orderkey % 10 = 1) AS automation, 0 AS other_removed, count(*) FILTER (o_orderkey % 10 > 1) AS screened,
        count(*) FILTER (o_orderkey % 10 > 1 AND o_orderstatus = 'F') AS excluded, count(*) FILTER (o_orderkey % 10 > 1 AND o_orderstatus <> 'F') AS sought,
        count(*) FILTER (o_orderkey % 10 > 1 AND o_orderstatus = 'P') AS not_retrieved, count(*) FILTER (o_orderkey % 10 > 1 AND o_orderstatus = 'O') AS assessed,
        count(*) FILTER (o_orderkey % 10 > 1 AND o_orderstatus = 'O' AND o_orderkey % 7 < 3) AS ft_excluded,
        count(*) FILTER (o_orderkey % 10 > 1 AND o_orderstatus = 'O' AND o_orderkey % 7 >= 3) AS reports,
        count(*) FILTER (o_orderkey % 10 > 1 AND o_orderstatus = 'O' AND o_orderkey % 7 >= 4 OR o_orderkey % 50 = 2) AS studies
    FROM orders GROUP BY o_custkey)"""


def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, reason_id, label, count: why the reports of a flow were excluded after reading."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 > 1 AND o_orderstatus = 'O' AND o_orderkey % 7 < 3")
    label = F.element_at(F.array(F.lit("wrong <population>"), F.lit('no "control" & arm'), F.lit("other")), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.groupBy(F.col("o_custkey").alias("review_id"), (F.col("o_orderkey") % 7).alias("reason_id"), label.alias("label")).agg(F.count("*").alias("count"))


EXCLUSION_REASONS = """exclusion_reasons AS (
    SELECT o_custkey AS review_id, o_orderkey % 7 AS reason_id, ['wrong <population>', 'no "control" & arm', 'other'][CAST(o_orderkey % 7 + 1 AS INT)] AS label, count(*) AS count
    FROM orders WHERE o_orderkey % 10 > 1 AND o_orderstatus = 'O' AND o_orderkey % 7 < 3 GROUP BY ALL)"""


def registered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered audit events of one review a user, chained; some reviews hold an event that breaks a rule."""
    t = table(spark, sf_dir, "events")
    return t.selectExpr("CAST(user_id AS STRING) AS review_id", "event_id AS seq", *REGISTERED_SPARK)


#: Shared by both engines: who said what. The rules that judge it are not shared.
_PLACE = "row_number() OVER (PARTITION BY user_id ORDER BY event_id)"
_BEFORE = "lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id)"


def _registered(text: str, sha: str) -> list[str]:
    e, u = f"CAST(event_id AS {text})", f"CAST(user_id AS {text})"
    number = lambda n: f"CAST(event_id % {n} AS {text})"
    odd = "event_id % 16 = 0"
    kind = (
        "CASE WHEN user_id % 20 = 6 AND event_id % 16 = 0 THEN 'made_up' WHEN event_id % 9 = 0 THEN 'review_plan_validated' WHEN event_id % 9 <= 2 THEN 'search_run_completed' WHEN event_id % 9 = 3 THEN 'protocol_amended' "
        "WHEN event_id % 9 = 4 THEN 'review_status_changed' ELSE 'screening_decision_recorded' END"
    )
    payload = (
        f"CASE WHEN user_id % 20 = 3 AND {odd} THEN '{{\"plan_id\":{{\"deep\":[1,{{\"Token\":2}}]}}}}' WHEN user_id % 20 = 4 AND {odd} THEN '{{\"unheard_of\":1}}' WHEN user_id % 20 = 7 AND {odd} THEN '{{\"_schema_version\":9}}' "
        f"WHEN event_id % 9 = 0 THEN '{{\"plan_id\":\"p' || {u} || '\"}}' "
        f"WHEN event_id % 9 = 1 THEN '{{\"source_id\":\"s' || {number(3)} || '\",\"run_id\":\"run-' || {number(5)} || '\",\"record_count\":' || {number(100)} || '}}' "
        f"WHEN event_id % 9 = 2 THEN '{{\"run_id\":\"run-' || {number(5)} || '\",\"_schema_version\":0,\"provider\":\"v' || {number(3)} || '\",\"record_count\":' || {number(100)} || '}}' "
        f"WHEN event_id % 9 = 3 THEN '{{\"amendment_id\":\"a' || {number(4)} || '\"}}' WHEN event_id % 9 = 4 THEN '{{\"status\":\"st' || {number(3)} || '\"}}' "
        f"ELSE '{{\"record_id\":\"rec' || {number(6)} || '\",\"stage\":\"full_text\",\"decision\":\"' || CASE WHEN event_id % 5 < 2 THEN 'include' ELSE 'exclude' END || '\",\"final_authority\":' || CASE WHEN event_id % 4 = 0 THEN 'false' ELSE 'true' END || '}}' END"
    )
    before = f"CASE WHEN user_id % 20 = 5 AND {_PLACE} = 20 THEN 'elsewhere' WHEN {_BEFORE} IS NULL THEN 'GENESIS' ELSE {sha.format(f'CAST({_BEFORE} AS {text})')} END"
    return [
        "'audit-event.v1' AS schema_version", f"'e' || {e} AS event_id", f"{kind} AS event_type", f"'u' || {number(7)} AS actor_id", "CASE WHEN event_id % 7 = 0 THEN 'agent' ELSE 'human' END AS actor_type",
        f"{payload} AS payload", f"{before} AS previous_hash", f"{sha.format(e)} AS event_hash",
    ]


REGISTERED_SPARK = _registered("STRING", "sha2({}, 256)")
REGISTERED_EVENTS = "registered AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS review_id, event_id AS seq, " + ", ".join(_registered("VARCHAR", "sha256({})")) + " FROM events)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (tenant, actor, request, at, seq, blocker) of three users a tenant; some ids come again, some are denied otherwise."""
    t = table(spark, sf_dir, "events")
    blocker = F.when(F.col("event_type") == "error", "access.scope.denied")
    return t.select(F.floor(F.col("user_id") / 3).alias("tenant"), F.col("user_id").alias("actor"), F.concat(F.lit("q"), F.col("event_id") % 40).alias("request"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), blocker.alias("blocker"))
