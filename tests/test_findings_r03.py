"""What the findings of round 3 were about: sizes at which the queries failed before."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from evigrain.operators import audit, dedup, living, policy, ranking, screening, study
from evigrain.plans import trees


def test_a_long_queue_of_one_review(spark):
    """the 30,000th turn is beyond 32 bits of milliseconds after the first."""
    rows = spark.range(30_000).selectExpr("1 AS review_id", "id AS seq", "concat('e', id) AS event_id", "timestamp'2024-01-01 00:00:00' AS occurred_at")
    got = audit.reserve(rows, 90_000).agg((F.max("start_ms") - F.min("start_ms")).alias("d")).first().d
    assert got == 29_999 * 90_000


def test_an_address_is_taken_apart_once(spark):
    """the steps that take an address apart are not written out again in each comparison."""
    for judge in (policy.prohibited_address, policy.private_ipv4):
        plan = spark.createDataFrame([("10.0.0.1",)], "ip string").select(judge(F.col("ip")).alias("p"))
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(") < 10
        assert plan.first().p


RECORD = "record_id string, title string, abstract string, authors array<string>, year int, doi string, pmid string, trial string, container string"


def _records(spark, n, seed=0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        title = " ".join(f"w{k}" for k in rng.sample(range(12), rng.choice([1, 8, 9, 10, 10, 11, 11, 12])))
        rows.append((f"r{i:04}", title, None, rng.choice([[], ["Ann One"], ["Two, Bo"]]), rng.choice([None, 2000, 2001, 2002, 2010]), rng.choice([None, None, "10.1/a", "10.1/b"]), None, None, None))
    return rows, spark.createDataFrame(rows, RECORD)


def _fuzzy(rows):
    out = {}
    key = lambda a: None if not a else a[0].split(",")[0].lower() if "," in a[0] else a[0].split()[-1].lower()
    for a, b in itertools.combinations(rows, 2):
        x, y = set(a[1].split()), set(b[1].split())
        score, p, q = len(x & y) / len(x | y), key(a[3]), key(b[3])
        if score >= 0.9 and (a[4] is None or b[4] is None or abs(a[4] - b[4]) <= 1) and (p is None or q is None or p == q):
            out[a[0], b[0]] = score
    return out


def test_matches_of_cells_are_those_of_all_pairs(spark):
    """Cells of copies give the pairs that comparing all records gives."""
    rows, records = _records(spark, 150)
    got = [((r.left_id, r.right_id), r.score) for r in dedup.fuzzy_matches(records).collect()]
    want = _fuzzy(rows)
    assert len(got) == len(want) and dict(got) == want and any(s < 1 for s in want.values())
    exact = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[5] is not None and a[5] == b[5]}
    component = {r.record_id: r.component for r in dedup.members(records).collect()}
    assert all(component[a] == component[b] for a, b in want.keys() | exact)
    unsure = {component[r.left_id] for r in dedup.review_evidence(records).where("review_required").collect()}
    assert unsure == {component[a] for a, _ in want.keys() - exact}


def test_copies_cost_their_number(spark):
    """a title that 20,000 records share makes about 20,000 links, not 200 million."""
    copies = spark.range(20_000).selectExpr("concat('r', lpad(id, 6, '0')) AS record_id", "'one title of many records' AS title", "NULL AS abstract", "array('Ann One') AS authors", "CAST(2000 + id % 3 AS INT) AS year", "NULL AS doi", "NULL AS pmid", "NULL AS trial", "NULL AS container")
    assert dedup.fuzzy_links(copies).count() < 20_100
    assert [r.size for r in dedup.clusters(copies).collect()] == [20_000]


def test_pairs_of_a_cluster_are_dealt_over_blocks(spark):
    """every pair once, whatever the blocks."""
    members = spark.range(40).selectExpr("IF(id < 30, 'a', IF(id < 39, 'b', NULL)) AS cluster", "lpad(id, 2, '0') AS record_id")
    got = sorted((r.left_id, r.right_id) for r in ranking.cluster_pairs(members, 4).collect())
    assert got == sorted((f"{a:02}", f"{b:02}") for lo, hi in ((0, 30), (30, 39)) for a, b in itertools.combinations(range(lo, hi), 2))


def test_metrics_count_pairs_of_a_cluster(spark):
    """2 * 10^11 expected pairs are counted, not listed."""
    expected = spark.range(700_000).selectExpr("IF(id < 600000, 'a', 'b') AS cluster", "id AS record_id")
    observed = spark.createDataFrame([(1, 2), (3, 650_000), (650_001, 650_002)], "left_id long, right_id long")
    n = 600_000 * 599_999 // 2 + 100_000 * 99_999 // 2
    got = ranking.cluster_metrics(expected, observed).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall) == (2, 1, n - 2, 2 / 3, 2 / n)


def test_trees_do_not_pass_through_the_driver(spark):
    """tables of nodes are joined by shuffles; files between steps look small enough to broadcast, their rows are not."""
    given = spark.createDataFrame([("s", "r", None, 0, "term", "x")], "strategy_id string, node string, parent string, ordinal int, op string, text string")
    nodes = given.select(*(F.col(c) if c in given.columns else F.lit(None).cast(t).alias(c) for c, t in (f.strip().split(" ", 1) for f in trees.NODES.split(","))))
    strategies = spark.createDataFrame([("s", "pubmed", None, None, None, None, None)], trees.STRATEGIES)
    for got in (trees.problems(nodes), trees.compile_all(strategies, nodes)):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert trees.compile_all(strategies, nodes).count() == 12


def test_a_text_is_redacted_once(spark):
    """F16: each pattern runs once a text, though the last step names the text three times."""
    texts = spark.createDataFrame([("bearer abc token=x1 a@b.org",)], "text string").select(audit.redact(F.col("text")).alias("t"))
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("bearer") == 1
    assert texts.first().t == "Bearer [REDACTED] token=[REDACTED] [REDACTED_EMAIL]"


def test_cycles_end_the_doubling(spark, monkeypatch):
    """rounds follow the longest chain, not the number of runs that lead into a cycle."""
    runs = spark.range(5_000).selectExpr("id AS run_id", "CASE WHEN id = 0 THEN 4999 WHEN id < 5000 - 40 THEN IF(id % 2 = 0, 0, id - 1) WHEN id > 4960 THEN id - 1 END AS parent_id").withColumn("parent_id", F.when(F.col("run_id") == 0, F.lit(1)).otherwise(F.col("parent_id")))
    calls, cut = [], living.cut
    monkeypatch.setattr(living, "cut", lambda df: calls.append(1) or cut(df))
    got = {r.run_id: (r.ancestors, r.cyclic) for r in living.lineage(runs).collect()}
    assert got == {i: (None, True) if i < 4_960 else (i - 4_960, False) for i in range(5_000)}
    assert len(calls) <= 9


def test_a_conflict_is_seen_without_counting_kinds(spark):
    """decisions are shuffled once, by subject and round; a conflict is two different decisions, null is none."""
    rows = [(s, "r", f"{s}-{i}", i, "human", d) for s, kinds in enumerate(["ab", "aa", "a", ["a", None, "a"], [None, None], ["b", None, "a"]]) for i, d in enumerate(kinds)]
    decisions = spark.createDataFrame([*rows, (1, "r", "1-9", 9, "agent", "b")], "subject_id long, round string, decision_id string, reviewer_id long, reviewer_kind string, decision string")
    asked = [(f"q{s}", s, "r", 99, [r[2] for r in rows if r[0] == s]) for s in range(6)]
    got = screening.resolve(decisions, spark.createDataFrame(asked, "request_id string, subject_id long, round string, adjudicator_id long, decision_ids array<string>"))
    assert [r.rejection for r in got.orderBy("request_id").collect()] == [None, *["no_conflict"] * 4, None]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_a_study_graph_is_grouped_in_parts_of_bounded_size(spark, monkeypatch):
    """as many parts as keep a part to ROWS rows, each identifier's codes once, whatever its rows."""
    links = [(f"l{i % 900}" if i % 50 else None, "a", "a" if i % 9 == 0 else "b", None if i % 31 == 0 else i % 12 / 10, i % 6) for i in range(1000)]
    reports = [("r1", "t", 1), ("r1", " ", 0), ("r2", None, 2), ("s2", "t", 3), (None, "t", 1), (None, "t", 0)]
    studies = [("s1", "x", ["r1", "r1", "r9", "r9"]), ("s2", " ", []), ("s2", "x", None), ("s3", "x", ["r2"])]
    found = {("report", i, c) for i, t, n in reports for c, bad in (("empty_title", t is None or t == " "), ("no_records", n == 0)) if bad}
    found |= {("study", i, c) for i, t, r in studies for c, bad in (("empty_label", t == " "), ("no_reports", not r), ("duplicate_report", len(set(r or [])) < len(r or []))) if bad}
    found |= {("link", i, c) for i, a, b, x, e in links for c, bad in (("self_reference", a == b), ("confidence_range", x is None or x > 1), ("no_evidence", e == 0)) if bad}
    found |= {("link", i, "duplicate_identifier") for i, n in Counter(r[0] for r in links).items() if n > 1}
    found |= {("report", "r1", "duplicate_identifier"), ("report", None, "duplicate_identifier"), ("study", "s2", "duplicate_identifier"), ("study", "s1", "unknown_report")}
    monkeypatch.setattr(study, "ROWS", 100, raising=False)
    got = study.graph_violations(
        spark.createDataFrame(reports, "report_id string, title string, records long"), spark.createDataFrame(studies, "study_id string, label string, report_ids array<string>"),
        spark.createDataFrame(links, "link_id string, from_id string, to_id string, confidence double, evidence long"),
    )
    rows = [(r.object, r.id, r.code) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == found
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and ", 10), REPARTITION_BY_NUM" in plan
