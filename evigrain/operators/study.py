"""Study graphs, evidence tables and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import parts

#: Rows of a study graph that one task groups by identifier.
ROWS = 500_000


def dangling_links(links: DataFrame, reports: DataFrame, studies: DataFrame) -> DataFrame:
    """(link_id, end): link ends that no report or study has."""
    missing = lambda end, known, key: links.join(known.select(F.col(key).alias(end)), end, "left_anti").select("link_id", F.lit(end).alias("end"))
    return missing("report_id", reports, "report_id").unionByName(missing("study_id", studies, "study_id"))


def unlinked_reports(reports: DataFrame, links: DataFrame) -> DataFrame:
    return reports.join(links, "report_id", "left_anti").select("report_id")


def reports_per_study(studies: DataFrame, links: DataFrame) -> DataFrame:
    """(study_id, reports), studies without a report too."""
    n = links.groupBy("study_id").agg(F.count_distinct("report_id").alias("n"))
    return studies.join(n, "study_id", "left").select("study_id", F.coalesce("n", F.lit(0)).alias("reports"))


def latest_attempt(reports: DataFrame, attempts: DataFrame) -> DataFrame:
    """(report_id, outcome): the last retrieval attempt of each report, else not_attempted."""
    last = attempts.groupBy("report_id").agg(F.max_by("outcome", "turn").alias("outcome"))
    return reports.join(last, "report_id", "left").select("report_id", F.coalesce("outcome", F.lit("not_attempted")).alias("outcome"))


def seed_recall(seeds: DataFrame, retrieved: DataFrame, group: str, key: str) -> DataFrame:
    """(group, total, found, recall): how many of each strategy's seed records it retrieved."""
    hit = retrieved.select(group, key).distinct().withColumn("hit", F.lit(1))
    got = seeds.select(group, key).distinct().join(hit, [group, key], "left")
    return got.groupBy(group).agg(F.count("*").alias("total"), F.count("hit").alias("found")).withColumn("recall", F.try_divide("found", "total"))


def validation_ready(findings: DataFrame, recall: DataFrame, group: str, minimum: float) -> DataFrame:
    """(group, unresolved, recall, ready): no major finding open and enough seeds found."""
    open_ = findings.groupBy(group).agg(F.count_if(~F.col("resolved") & F.col("severity").isin("major", "critical")).alias("unresolved"))
    got = recall.join(open_, group, "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(0)))
    return got.select(group, "unresolved", "recall", ((F.col("unresolved") == 0) & F.coalesce(F.col("recall") >= minimum, F.lit(False))).alias("ready"))


def regressions(baseline: DataFrame, candidate: DataFrame, tolerance: float) -> DataFrame:
    """(name, drop, passed) of the metrics that both sides have; a metric that the candidate lost fails."""
    both = baseline.select("name", F.col("value").alias("b")).join(candidate.select("name", F.col("value").alias("c")), "name", "left")
    return both.select("name", F.round(F.col("b") - F.col("c"), 9).alias("drop"), F.coalesce(F.col("b") - F.col("c") <= tolerance, F.lit(False)).alias("passed"))


def members(manifest: DataFrame, archive: DataFrame) -> DataFrame:
    """(path, state): missing, undeclared, changed or same, by full join of digests."""
    both = manifest.select("path", F.col("digest").alias("m")).join(archive.select("path", F.col("digest").alias("a")), "path", "full")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("m").isNull(), "undeclared").when(F.col("a") != F.col("m"), "changed").otherwise("same")
    return both.select("path", state.alias("state"))


def valid_on(rows: DataFrame, periods: DataFrame, key: str, date: str) -> DataFrame:
    """rows with valid: does a period [start, end) of the row's key hold its date? A null end is open."""
    p = periods.groupBy(F.col(key).alias("period_key")).agg(F.collect_list(F.struct("start", "end")).alias("periods"))
    day = F.col(date)
    inside = F.exists("periods", lambda x: (day >= x["start"]) & (x["end"].isNull() | (day < x["end"])))
    got = rows.join(p, F.col(key) == F.col("period_key"), "left").withColumn("valid", F.coalesce(inside, F.lit(False)))
    return got.select(*rows.columns, "valid")


def localise(diagnostics: DataFrame, catalogue: DataFrame) -> DataFrame:
    """diagnostics with message: the catalogue's text for the code, else the code itself."""
    return diagnostics.join(catalogue.select("code", "message"), "code", "left").withColumn("message", F.coalesce("message", "code"))


def execution_mode(pages: DataFrame, run: str) -> DataFrame:
    """(run, mode): live, replay if all pages came from the cache, else mixed-live-replay."""
    got = pages.groupBy(run).agg(F.count("*").alias("n"), F.count_if("cached").alias("hits"))
    return got.select(run, F.when(F.col("hits") == F.col("n"), "replay").when(F.col("hits") > 0, "mixed-live-replay").otherwise("live").alias("mode"))


def readiness(health: DataFrame, group: str) -> DataFrame:
    """(group, ready, unhealthy, degraded): components by state."""
    of = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("component")))), ",")
    got = health.groupBy(group).agg(of("unhealthy").alias("unhealthy"), of("degraded").alias("degraded"))
    return got.select(group, (F.col("unhealthy") == "").alias("ready"), "unhealthy", "degraded")


def authorise(requests: DataFrame, scopes: Column, tenants: Column) -> DataFrame:
    """(request_id, allowed, reason) of requests (tenant, region, needed, write, final, actor_kind)."""
    c = F.col
    missing = F.array_except("needed", scopes)
    reason = (
        F.when(~F.array_contains(tenants, c("tenant")), "tenant.denied").when(F.size(missing) > 0, F.concat(F.lit("scope.missing:"), F.array_join(F.array_sort(missing), "+")))
        .when(c("write") & (c("actor_kind") != "human"), "write.human_required").when(c("final") & (c("actor_kind") != "human"), "final.human_required")
    )
    return requests.select("request_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def first_entities(entities: DataFrame, key: str, order: str) -> DataFrame:
    """The first entity of each key."""
    return entities.groupBy(key).agg(F.min_by(F.struct(*[c for c in entities.columns if c != key]), order).alias("e")).select(key, "e.*")


def live_objects(objects: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return objects.join(tombstones.select(key).distinct(), key, "left_anti")


def merkle_roots(leaves: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, leaves, root): pairwise SHA-256 over the ordered leaf digests; an odd last one is doubled.

    One fold per level over whole frames, so a group's leaves never meet in one task.
    """

    from .components import cut

    place = F.row_number().over(W.partitionBy(group).orderBy(order)) - 1
    level = cut(leaves.select(group, place.alias("i"), F.sha2(value, 256).alias("h")))
    sizes = cut(level.groupBy(group).agg(F.count("*").alias("leaves")))
    most = sizes.agg(F.max("leaves")).first()[0] or 0
    while most > 1:
        pair = level.groupBy(group, F.floor(F.col("i") / 2).alias("i")).agg(F.max_by("h", "i").alias("right"), F.min_by("h", "i").alias("left"), F.count("*").alias("k"))
        alone = level.groupBy(F.col(group).alias("g")).agg(F.max("i").alias("last"))
        done = (F.col("last") == 0) & (F.col("i") == 0)
        level = cut(pair.join(alone, F.col(group) == F.col("g")).select(group, "i", F.when(done, F.col("left")).otherwise(F.sha2(F.concat("left", "right"), 256)).alias("h")))
        most = -(-most // 2)
    return level.join(sizes, group).select(group, "leaves", F.col("h").alias("root"))


def receipt_integrity(records: DataFrame, receipts: DataFrame) -> DataFrame:
    """(receipt_id, problem, records): receipts that records (record_id, receipt_id) name and nobody holds, and those (receipt_id, stated) that state another number of records."""
    found = records.groupBy("receipt_id").agg(F.count("*").alias("records"))
    got = found.join(receipts, "receipt_id", "full").withColumn("records", F.coalesce("records", F.lit(0).cast("long")))
    problem = F.when(F.col("stated").isNull(), "unresolved_receipt").when(F.col("stated") != F.col("records"), "count_mismatch")
    return got.withColumn("problem", problem).where("problem IS NOT NULL").select("receipt_id", "problem", "records")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, rows): keys that must be unique and are not."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def broken_spans(spans: DataFrame, group: str, order: str, start: str, end: str) -> DataFrame:
    """Spans that start before the one before them in their group ends, or end before they start."""
    w = W.partitionBy(group).orderBy(order)
    return spans.withColumn("previous_end", F.lag(end).over(w)).where(f"{start} < previous_end OR {end} < {start}")


def graph_violations(reports: DataFrame, studies: DataFrame, links: DataFrame) -> DataFrame:
    """(object, id, code), each once: what breaks a study graph's rules.

    reports have report_id, title and records (how many they rest on); studies study_id, label and report_ids; links link_id,
    from_id, to_id, confidence and evidence (how many pieces). Reports and studies share one space of identifiers.
    """
    none = F.expr("cast(array() as array<string>)")
    empty = lambda c: F.trim(c) == ""
    given = F.coalesce("report_ids", none)
    rules = {
        "report": {"empty_title": empty("title"), "no_records": F.col("records") == 0},
        "study": {"empty_label": empty("label"), "no_reports": F.size(given) == 0, "duplicate_report": F.size(F.array_distinct(given)) < F.size(given)},
        "link": {"self_reference": F.col("from_id") == F.col("to_id"), "confidence_range": ~F.col("confidence").between(0, 1), "no_evidence": F.col("evidence") == 0},
    }

    def flagged(df, kind, key):
        """The rules that a row breaks, as bits of a column named by its kind."""
        bits = sum((F.when(F.coalesce(rule, F.lit(True)), 1 << i).otherwise(0) for i, rule in enumerate(rules[kind].values())), F.lit(0))
        return df.select(F.col(key).alias("id"), F.lit(kind).alias("object"), *((bits if k == kind else F.lit(0)).alias(k) for k in rules))

    def dealt(df, key):
        """df in as many parts as keep a part to ROWS rows; Spark would join small files of many rows to few large parts."""
        return df.repartition(max(parts(df.sparkSession), -(-df.count() // ROWS)), key)

    def codes(df):
        """Each identifier's codes, once."""
        got = dealt(df, "id").groupBy("id").agg(F.count("*").alias("rows"), F.max("object").alias("object"), *(F.bit_or(k).alias(k) for k in rules))
        named = [F.when(F.col(k).bitwiseAND(1 << i) != 0, F.struct(F.lit(k).alias("object"), F.lit(code).alias("code"))) for k in rules for i, code in enumerate(rules[k])]
        twice = F.when(F.col("rows") > 1, F.struct("object", F.lit("duplicate_identifier").alias("code")))
        return got.select("id", F.explode(F.array_compact(F.array(*named, twice))).alias("x")).select("x.object", "id", "x.code")

    ends = studies.select("study_id", F.explode(F.array_distinct("report_ids")).alias("report_id"))
    unknown = ends.join(dealt(reports.select("report_id"), "report_id"), "report_id", "left_anti").select(F.lit("study").alias("object"), F.col("study_id").alias("id"), F.lit("unknown_report").alias("code")).distinct()
    objects = flagged(reports, "report", "report_id").unionByName(flagged(studies, "study", "study_id"))
    return codes(objects).unionByName(codes(flagged(links, "link", "link_id"))).unionByName(unknown)
