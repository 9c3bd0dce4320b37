"""Registered queries over the given tables, with the DuckDB SQL of each where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import access, audit, dedup, events, living, policy, prisma, ranking, screening, study, validators
from .operators.components import cut
from .plans import derive as D
from .sinks import export

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register a query under its function's name; sql may use the CTEs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            recursive = "RECURSIVE " if any(c.startswith("RECURSIVE ") for c in ctes) else ""
            named = ",\n".join(c.removeprefix("RECURSIVE ") for c in ctes)
            ORACLE_SQL[f.__name__] = f"WITH {recursive}{named}\n{sql}" if ctes else sql
        return f

    return add


# --- SQL forms of the scalar functions
SPLIT = r"regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}\p{{M}}]+')"
LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql_doi(x: str) -> str:
    out = LOWER.format(x=f"trim({x})")
    for p in T.DOI_PREFIXES:
        out = f"regexp_replace({out}, '^({p.replace('.', chr(92) + '.')})+', '')"
    return f"trim({out})"


def sql_title_tokens(x: str) -> str:
    return f"list_distinct(list_filter({SPLIT.format(x=LOWER.format(x=x))}, lambda t: t <> ''))"


def sql_rank_tokens(x: str) -> str:
    return f"list_distinct(list_transform(list_filter({SPLIT.format(x=x)}, lambda t: strlen(t) >= 2), lambda t: lower(t)))"


TOKENS = f"tokens AS (SELECT *, {sql_title_tokens('title')} AS tokens FROM records)"
NORMAL = f"""normal AS (SELECT record_id, {sql_doi('doi')} AS d, {LOWER.format(x='trim(pmid)')} AS p, {LOWER.format(x='trim(trial)')} AS t FROM records)"""
KEYS = """keys AS (
    SELECT record_id, 0 AS priority, d AS key FROM normal WHERE regexp_matches(d, '^10\\.[^\\s]*/[^\\s]*$') UNION ALL
    SELECT record_id, 1, p FROM normal WHERE regexp_matches(p, '^[0-9]+$') UNION ALL SELECT record_id, 2, t FROM normal WHERE t <> '')"""
EXACT = """exact AS (
    SELECT a.record_id AS left_id, b.record_id AS right_id, min(a.priority) AS p FROM keys a JOIN keys b ON a.priority = b.priority AND a.key = b.key AND a.record_id < b.record_id GROUP BY ALL)"""
AUTHOR = "CASE WHEN contains(authors[1], ',') THEN " + LOWER.format(x="trim(split_part(authors[1], ',', 1))") + " ELSE " + LOWER.format(x="list_last(regexp_split_to_array(trim(authors[1]), '\\s+'))") + " END"
FUZZY = f"""f AS (SELECT record_id, year, {AUTHOR} AS author, tokens FROM tokens WHERE len(tokens) > 0),
fuzzy AS (
    SELECT a.record_id AS left_id, b.record_id AS right_id, len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) AS score
    FROM f a JOIN f b ON a.record_id < b.record_id AND len(a.tokens) >= 0.9 * len(b.tokens) AND len(b.tokens) >= 0.9 * len(a.tokens)
    WHERE coalesce(abs(a.year - b.year) <= 1, true) AND coalesce(a.author = b.author, true) AND score >= 0.9)"""
RECORDS = D.RECORDS
METADATA = "CASE WHEN doi IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN pmid IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN abstract IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN len(authors) > 0 THEN 2 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN container IS NOT NULL THEN 1 ELSE 0 END"


# --- duplicates
@query("SELECT left_id, right_id, ['exact_doi', 'exact_pmid', 'exact_trial_registration'][p + 1] AS reason, CAST(1.0 AS DOUBLE) AS score, false AS review_required FROM exact", RECORDS, NORMAL, KEYS, EXACT)
def dedup_exact(spark, sf_dir):
    return dedup.exact_matches(D.records(spark, sf_dir))


@query("SELECT left_id, right_id, 'fuzzy_title_author_year' AS reason, round(score, 10) AS score, true AS review_required FROM fuzzy", RECORDS, TOKENS, FUZZY)
def dedup_fuzzy(spark, sf_dir):
    return dedup.fuzzy_matches(D.records(spark, sf_dir)).withColumn("score", F.round("score", 10))


@query(
    """SELECT left_id, right_id, ['exact_doi', 'exact_pmid', 'exact_trial_registration'][p + 1] AS reason, CAST(1.0 AS DOUBLE) AS score, false AS review_required FROM exact UNION ALL
SELECT left_id, right_id, 'fuzzy_title_author_year', round(score, 10), true FROM fuzzy ANTI JOIN exact USING (left_id, right_id)""", RECORDS, NORMAL, KEYS, EXACT, TOKENS, FUZZY)  # fmt: skip
def dedup_evidence(spark, sf_dir):
    return dedup.matches(D.records(spark, sf_dir)).withColumn("score", F.round("score", 10))


CLUSTERED = """RECURSIVE edges AS (SELECT left_id AS a, right_id AS b FROM exact UNION SELECT left_id, right_id FROM fuzzy UNION SELECT right_id, left_id FROM exact UNION SELECT right_id, left_id FROM fuzzy),
reach AS (SELECT record_id AS n, record_id AS c FROM records UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.n),
members AS (SELECT n AS record_id, min(c) AS component FROM reach GROUP BY n),
clusters AS (
    SELECT component, list(record_id ORDER BY record_id) AS ids, first(record_id ORDER BY s DESC, record_id) AS representative, count(*) AS size
    FROM members JOIN (SELECT record_id, """ + METADATA + """ AS s FROM records) USING (record_id) GROUP BY component)"""
CLUSTER_CTES = (RECORDS, NORMAL, KEYS, EXACT, TOKENS, FUZZY, CLUSTERED)


@query("SELECT 'dup-' || substr(sha256(array_to_string(ids, chr(10))), 1, 16) AS cluster_id, representative, size, array_to_string(ids, ',') AS record_ids FROM clusters", *CLUSTER_CTES)
def dedup_cluster(spark, sf_dir):
    return dedup.clusters(D.records(spark, sf_dir)).withColumn("record_ids", F.array_join("record_ids", ","))


@query("SELECT representative AS record_id, size FROM clusters WHERE size > 1", *CLUSTER_CTES)
def representative(spark, sf_dir):
    return dedup.clusters(D.records(spark, sf_dir)).where("size > 1").select(F.col("representative").alias("record_id"), "size")


KEYED_DOI = LOWER.format(x="trim(doi)")
for _p in T.KEYED_PREFIXES:
    KEYED_DOI = f"regexp_replace({KEYED_DOI}, '^{_p.replace('.', chr(92) + '.')}', '')"
KEYED = f"""keyed AS (
    SELECT record_id, nullif(regexp_replace({KEYED_DOI}, '[. ]+$', ''), '') AS d, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')) AS t FROM records),
k AS (SELECT record_id, CASE WHEN d IS NOT NULL THEN 'doi' ELSE 'title' END AS basis, coalesce(d, t) AS normalised_value FROM keyed),
w AS (SELECT *, min(record_id) OVER (PARTITION BY basis, normalised_value) AS canonical_record_id FROM k)"""


@query("SELECT canonical_record_id, record_id AS duplicate_record_id, basis, normalised_value FROM w WHERE record_id <> canonical_record_id", RECORDS, KEYED)
def dedup_slice_keyed(spark, sf_dir):
    return dedup.keyed_duplicates(D.records(spark, sf_dir))


@query(f"SELECT record_id, {sql_doi('doi')} AS doi, regexp_matches({sql_doi('doi')}, '^10\\.[^\\s]*/[^\\s]*$') AS valid, {LOWER.format(x='trim(trial)')} AS trial FROM records", RECORDS)
def normalise_identifiers(spark, sf_dir):
    doi = T.normalise_doi(F.col("doi"))
    return D.records(spark, sf_dir).select("record_id", doi.alias("doi"), T.valid_doi(doi).alias("valid"), T.normalise_trimmed(F.col("trial")).alias("trial"))


@query("SELECT record_id, len(tokens) AS tokens, array_to_string(list_sort(tokens), ' ') AS sorted_tokens FROM tokens", RECORDS, TOKENS)
def title_tokens(spark, sf_dir):
    t = T.title_tokens(F.col("title"))
    return D.records(spark, sf_dir).select("record_id", F.size(t).cast("long").alias("tokens"), F.array_join(F.array_sort(t), " ").alias("sorted_tokens"))


@query(f"SELECT record_id, {METADATA} AS score, {AUTHOR} AS author FROM records", RECORDS)
def metadata_score(spark, sf_dir):
    s = T.metadata_score(*(F.col(c) for c in ("doi", "pmid", "abstract", "authors", "year", "container")))
    return D.records(spark, sf_dir).select("record_id", s.alias("score"), T.author_key(F.get("authors", F.lit(0))).alias("author"))


# --- ranking and metrics
TERMS = ["thion", "the", "ende", "que", "en"]
RANKED = f"""q AS (SELECT {sql_rank_tokens("'" + ' '.join(TERMS) + "'")} AS q),
parts AS (
    SELECT record_id, len(list_intersect(q, {sql_rank_tokens('title')})) / len(q) AS title_overlap, len(list_intersect(q, {sql_rank_tokens("coalesce(abstract, '')")})) / len(q) AS abstract_overlap,
        len(list_intersect(q, {sql_rank_tokens("array_to_string(subjects, ' ')")})) / len(q) AS subject_overlap
    FROM records, q),
ranked AS (SELECT record_id, round(title_overlap * 0.55 + abstract_overlap * 0.30 + subject_overlap * 0.15, 10) AS score, title_overlap, abstract_overlap, subject_overlap FROM parts)"""


@query("SELECT * FROM ranked", RECORDS, RANKED)
def lexical_score(spark, sf_dir):
    return ranking.scores(D.records(spark, sf_dir), TERMS)


@query("SELECT record_id, score FROM ranked ORDER BY score DESC, record_id LIMIT 25", RECORDS, RANKED)
def topk_rank(spark, sf_dir):
    return ranking.top(ranking.scores(D.records(spark, sf_dir), TERMS), 25).select("record_id", "score")


@query(
    """SELECT *, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity FROM (
    SELECT count(*) FILTER (score >= 0.3 AND r) AS tp, count(*) FILTER (score >= 0.3 AND NOT r) AS fp, count(*) FILTER (score < 0.3 AND NOT r) AS tn, count(*) FILTER (score < 0.3 AND r) AS fn
    FROM (SELECT score, n % 3 = 0 AS r FROM ranked JOIN records USING (record_id)))""", RECORDS, RANKED)  # fmt: skip
def calibration_counts(spark, sf_dir):
    r = D.records(spark, sf_dir)
    got = ranking.calibration(ranking.scores(r, TERMS), r.where("n % 3 = 0").select("record_id"), 0.3)
    return got.toDF("tp", "fp", "tn", "fn", "sensitivity", "specificity")


@query(
    """SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (
    SELECT count(*) FILTER (e AND o) AS tp, count(*) FILTER (NOT e) AS fp, count(*) FILTER (NOT o) AS fn FROM (
        SELECT n % 4 IN (0, 1) AS e, n % 4 IN (1, 2) AS o FROM records) WHERE e OR o)""", RECORDS)  # fmt: skip
def binary_metrics(spark, sf_dir):
    r = D.records(spark, sf_dir)
    return ranking.set_metrics(r.where("n % 4 IN (0, 1)"), r.where("n % 4 IN (1, 2)"), ["record_id"])


@query(
    """SELECT a.record_id AS left_id, b.record_id AS right_id FROM members a JOIN members b ON a.component = b.component AND a.record_id < b.record_id""", *CLUSTER_CTES)  # fmt: skip
def dedup_pairs(spark, sf_dir):
    return ranking.cluster_pairs(cut(dedup.members(D.records(spark, sf_dir)).select(F.col("component").alias("cluster"), "record_id")))


@query(
    """SELECT count(t.record_id) / nullif(count(*), 0) AS recall, count(*) AS relevant FROM (SELECT record_id FROM records WHERE n % 5 = 0)
LEFT JOIN (SELECT record_id FROM ranked ORDER BY score DESC, record_id LIMIT 50) t USING (record_id)""", RECORDS, RANKED)  # fmt: skip
def recall_at_k(spark, sf_dir):
    r = D.records(spark, sf_dir)
    return ranking.recall_at(ranking.scores(r, TERMS), r.where("n % 5 = 0"), 50)


# --- screening
STATUS = """counted AS (
    SELECT subject_id, round, count(*) FILTER (reviewer_kind = 'human') AS humans, count(DISTINCT decision) FILTER (reviewer_kind = 'human') AS kinds, min(decision) FILTER (reviewer_kind = 'human') AS one
    FROM decisions GROUP BY subject_id, round),
statuses AS (
    SELECT subject_id, round, humans, CASE WHEN resolved IS NOT NULL THEN 'resolved' WHEN humans < 2 THEN 'pending' WHEN kinds = 1 THEN 'consensus' ELSE 'conflict' END AS status, resolved, one
    FROM counted LEFT JOIN resolutions USING (subject_id, round))"""


@query("SELECT subject_id, round, humans, status, CASE status WHEN 'resolved' THEN resolved WHEN 'consensus' THEN one END AS outcome FROM statuses", D.DECISIONS, D.RESOLUTIONS, STATUS)
def screening_status(spark, sf_dir):
    return screening.status(D.decisions(spark, sf_dir), D.resolutions(spark, sf_dir))


@query("SELECT round, status, count(*) AS subjects FROM statuses GROUP BY ALL", D.DECISIONS, D.RESOLUTIONS, STATUS)
def screening_summary(spark, sf_dir):
    return screening.status(D.decisions(spark, sf_dir), D.resolutions(spark, sf_dir)).groupBy("round", "status").agg(F.count("*").alias("subjects"))


ADMIT = """w AS (SELECT *, CASE WHEN decision = 'exclude' AND exclusion_reason IS NULL THEN 'missing_exclusion_reason' WHEN decision <> 'exclude' AND exclusion_reason IS NOT NULL THEN 'unexpected_exclusion_reason'
        WHEN NOT confidence BETWEEN 0 AND 1 THEN 'invalid_confidence' WHEN reviewer_kind = 'agent' AND decision = 'exclude' THEN 'agent_exclusion_denied' END AS wrong FROM decisions),
x AS (SELECT *, row_number() OVER (PARTITION BY decision_id, wrong IS NULL ORDER BY decided_at, decision_id) AS same FROM w),
y AS (SELECT *, wrong IS NULL AND same = 1 AS ok FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY subject_id, round, reviewer_id, ok ORDER BY decided_at, decision_id) AS turn FROM y),
v AS (SELECT *, ok AND turn = 1 AND reviewer_kind = 'human' AS counts FROM z),
u AS (SELECT *, sum(CAST(counts AS INT)) OVER (PARTITION BY subject_id, round ORDER BY decided_at, decision_id) AS humans FROM v),
r AS (SELECT decision_id, coalesce(wrong, CASE WHEN same > 1 THEN 'duplicate_decision_id' WHEN turn > 1 THEN 'duplicate_reviewer' WHEN counts AND humans > 2 THEN 'independent_review_complete' END) AS rejection FROM u)"""


@query("SELECT decision_id, rejection IS NULL AS admitted, rejection FROM r", D.DECISIONS, ADMIT)
def screening_admit(spark, sf_dir):
    return screening.admit(D.decisions(spark, sf_dir))


@query("SELECT a.decision_id AS agent_decision_id, h.decision_id AS human_decision_id FROM decisions a JOIN decisions h USING (subject_id, round) WHERE a.reviewer_kind = 'agent' AND h.reviewer_kind = 'human' AND a.decision = 'exclude' AND h.decision = 'exclude'", D.DECISIONS)
def confirm_agent_exclusion(spark, sf_dir):
    return screening.confirmed_agent_exclusions(D.decisions(spark, sf_dir))


# --- living reviews and discovery
@query(
    """SELECT * FROM (
    SELECT record_id, CASE WHEN b.body IS NULL THEN 'added' WHEN a.body IS NULL THEN 'missing_from_source' WHEN a.body <> b.body THEN 'updated' END AS kind, sha256(b.body) AS before_digest, sha256(a.body) AS after_digest
    FROM before b FULL JOIN after a USING (record_id)) WHERE kind IS NOT NULL""", D.SNAPSHOTS)  # fmt: skip
def living_diff(spark, sf_dir):
    return living.diff(*D.snapshots(spark, sf_dir))


BFS = """RECURSIVE seeds AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 50 = 0),
walk AS (SELECT node, 0 AS depth FROM seeds UNION SELECT c.target, w.depth + 1 FROM walk w JOIN citations c ON c.source = w.node WHERE w.depth < 2),
found AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""


def _candidates(spark, sf_dir, most=None):
    seeds = D.table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("node"))
    return living.candidates(D.citations(spark, sf_dir), seeds, 2, most).select("node", "depth")


@query("SELECT node, depth FROM found WHERE depth > 0", D.CITATIONS, BFS)
def discovery_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query("SELECT node, depth FROM found WHERE depth > 0 ORDER BY depth, node LIMIT 100", D.CITATIONS, BFS)
def topk_discovery(spark, sf_dir):
    return _candidates(spark, sf_dir, 100)


PARENTS = "RECURSIVE runs AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 16 <> 0 THEN o_orderkey - 1 END AS parent_id FROM orders), up AS (SELECT run_id AS start, parent_id, 0 AS n FROM runs UNION ALL SELECT u.start, r.parent_id, u.n + 1 FROM up u JOIN runs r ON r.run_id = u.parent_id)"


@query("SELECT start AS run_id, max(n) AS ancestors FROM up GROUP BY start", PARENTS)
def lineage_depth(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 16 != 0, F.col("o_orderkey") - 1).alias("parent_id"))
    return living.lineage(o).select("run_id", "ancestors")


UPDATES = """updates AS (SELECT o_orderkey AS run_id, o_orderkey // 64 AS review_id, CASE WHEN o_orderkey % 160 = 0 THEN o_orderkey + 5 WHEN o_orderkey % 64 = 48 THEN o_orderkey - 60 WHEN o_orderkey % 48 = 16 THEN -o_orderkey WHEN o_orderkey % 16 <> 0 THEN o_orderkey - 1 END AS parent_id,
    CASE o_orderkey % 7 WHEN 0 THEN o_orderkey - 3 WHEN 1 THEN o_orderkey + 1 WHEN 2 THEN -1 WHEN 3 THEN o_orderkey - 6 END AS supersedes_id, o_orderstatus = 'F' AS completed FROM orders)"""
REACHED = "RECURSIVE reached AS (SELECT run_id, parent_id AS node FROM updates WHERE parent_id IS NOT NULL UNION SELECT r.run_id, u.parent_id FROM reached r JOIN updates u ON u.run_id = r.node WHERE u.parent_id IS NOT NULL)"
LOOPS = "loops AS (SELECT DISTINCT r.run_id FROM reached r JOIN reached c ON c.run_id = r.node AND c.node = r.node)"


def _updates(spark, sf_dir):
    k = F.col("o_orderkey")
    parent = F.when(k % 160 == 0, k + 5).when(k % 64 == 48, k - 60).when(k % 48 == 16, -k).when(k % 16 != 0, k - 1)
    over = F.when(k % 7 == 0, k - 3).when(k % 7 == 1, k + 1).when(k % 7 == 2, -1).when(k % 7 == 3, k - 6)
    return D.table(spark, sf_dir, "orders").select(k.alias("run_id"), F.floor(k / 64).alias("review_id"), parent.alias("parent_id"), over.alias("supersedes_id"), (F.col("o_orderstatus") == "F").alias("completed"))


@query("SELECT u.run_id, u.supersedes_id AS candidate FROM updates u JOIN reached r ON r.run_id = u.run_id AND r.node = u.supersedes_id WHERE u.run_id NOT IN (FROM loops) AND u.supersedes_id IN (SELECT run_id FROM updates)", UPDATES, REACHED, LOOPS)
def ancestor_of(spark, sf_dir):
    runs = _updates(spark, sf_dir)
    return living.ancestor_pairs(runs.select("run_id", F.col("supersedes_id").alias("candidate")), runs)


@query(
    """SELECT run_id, 'unknown_parent' AS code FROM updates WHERE parent_id NOT IN (SELECT run_id FROM updates) UNION SELECT u.run_id, 'cross_review_parent' FROM updates u JOIN updates p ON p.run_id = u.parent_id WHERE p.review_id <> u.review_id
    UNION SELECT run_id, 'unknown_superseded' FROM updates WHERE completed AND supersedes_id NOT IN (SELECT run_id FROM updates) UNION SELECT u.run_id, 'cross_review_superseded' FROM updates u JOIN updates p ON p.run_id = u.supersedes_id WHERE u.completed AND p.review_id <> u.review_id
    UNION SELECT u.run_id, 'invalid_supersession' FROM updates u JOIN updates p ON p.run_id = u.supersedes_id WHERE u.completed AND p.review_id = u.review_id AND u.run_id NOT IN (FROM loops) AND NOT EXISTS (SELECT 1 FROM reached r WHERE r.run_id = u.run_id AND r.node = u.supersedes_id)
    UNION SELECT run_id, 'lineage_cycle' FROM loops UNION SELECT run_id, 'duplicate_run' FROM updates WHERE run_id % 50 = 7""", UPDATES, REACHED, LOOPS)  # fmt: skip
def lineage_validate(spark, sf_dir):
    """Update runs over orders; some name unknown or foreign parents, some chains lead into a cycle, one run in fifty is listed twice."""
    runs = _updates(spark, sf_dir)
    return living.lineage_violations(runs.unionByName(runs.where("run_id % 50 = 7")))


# --- audit
CHAIN = r"""RECURSIVE e AS (SELECT *, event_id || '|' || event_type || '|' || coalesce(payload, '') AS body, row_number() OVER (PARTITION BY review_id ORDER BY seq) AS k FROM audit_events),
chain AS (
    SELECT review_id, k, event_id, 'GENESIS' AS previous_hash, sha256('GENESIS' || chr(10) || body) AS event_hash FROM e WHERE k = 1 UNION ALL
    SELECT e.review_id, e.k, e.event_id, c.event_hash, sha256(c.event_hash || chr(10) || e.body) FROM chain c JOIN e ON e.review_id = c.review_id AND e.k = c.k + 1)"""


@query("SELECT event_id, previous_hash, event_hash FROM chain", D.AUDIT_EVENTS, CHAIN)
def audit_append_hash(spark, sf_dir):
    return audit.append_hashes(D.audit_events(spark, sf_dir)).select("event_id", "previous_hash", "event_hash")


TAMPERED = r"""tampered AS (SELECT c.review_id, c.k, e.seq, e.body, CASE WHEN e.seq % 101 = 7 THEN 'ev-0' ELSE c.event_id END AS event_id,
    CASE WHEN e.seq % 97 = 3 THEN 'GENESIS' ELSE c.previous_hash END AS previous_hash, CASE WHEN e.seq % 89 = 5 THEN sha256('x') ELSE c.event_hash END AS event_hash
    FROM chain c JOIN e USING (review_id, k) WHERE e.seq % 83 <> 2),
judged AS (SELECT review_id, k, event_hash, previous_hash <> lag(event_hash, 1, 'GENESIS') OVER (PARTITION BY review_id ORDER BY seq) OR event_hash <> sha256(previous_hash || chr(10) || body)
    OR row_number() OVER (PARTITION BY review_id, event_id ORDER BY seq) > 1 AS bad FROM tampered)"""


@query("SELECT review_id, count(*) AS events, max_by(event_hash, k) AS head, count(*) FILTER (bad) AS broken FROM judged GROUP BY review_id", D.AUDIT_EVENTS, CHAIN, TAMPERED)
def audit_chain_verify(spark, sf_dir):
    """Chains with changed hashes, wrong links, repeated ids and missing events."""
    c, seq = audit.append_hashes(D.audit_events(spark, sf_dir)), F.col("seq")
    c = c.where(seq % 83 != 2).withColumns({
        "event_id": F.when(seq % 101 == 7, "ev-0").otherwise(F.col("event_id")), "previous_hash": F.when(seq % 97 == 3, audit.GENESIS).otherwise(F.col("previous_hash")),
        "event_hash": F.when(seq % 89 == 5, F.sha2(F.lit("x"), 256)).otherwise(F.col("event_hash")),
    })
    return audit.verify_chain(c)


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY review_id ORDER BY seq) AS predecessor FROM audit_events QUALIFY predecessor IS NOT NULL", D.AUDIT_EVENTS)
def prov_predecessor(spark, sf_dir):
    return audit.predecessors(audit.append_hashes(D.audit_events(spark, sf_dir)))


@query(
    """SELECT review_id, count(*) AS source_event_count, max_by(event_id, seq) AS last_event_id, count(*) FILTER (event_type = 'purchase' AND actor_kind = 'human') AS final_decisions,
    count(*) FILTER (event_type = 'purchase' AND actor_kind <> 'human') AS rejected_final, count(*) FILTER (event_type = 'view') AS advisory, max_by(event_type, seq) AS status, count(DISTINCT event_type) AS event_types
FROM audit_events GROUP BY review_id""", D.AUDIT_EVENTS)  # fmt: skip
def review_reduce(spark, sf_dir):
    return audit.reduce_reviews(D.audit_events(spark, sf_dir))


@query("SELECT review_id, event_type, count(*) AS n FROM audit_events GROUP BY ALL", D.AUDIT_EVENTS)
def event_type_counts(spark, sf_dir):
    return audit.type_counts(D.audit_events(spark, sf_dir))


@query("SELECT review_id, actor_id, event_id, value FROM audit_events WHERE event_type = 'purchase' AND actor_kind = 'human' QUALIFY row_number() OVER (PARTITION BY review_id, actor_id ORDER BY seq DESC) = 1", D.AUDIT_EVENTS)
def latest_final_decision(spark, sf_dir):
    return audit.latest_final_decision(D.audit_events(spark, sf_dir))


@query("SELECT event_id, count(*) OVER (PARTITION BY actor_id ORDER BY epoch_us(occurred_at) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS before FROM audit_events", D.AUDIT_EVENTS)
def rate_window(spark, sf_dir):
    return audit.trailing_count(D.audit_events(spark, sf_dir), 86_400)


@query("SELECT event_id, row_number() OVER (PARTITION BY actor_id, payload ORDER BY seq) > 1 AS replay FROM audit_events", D.AUDIT_EVENTS)
def replay_first_seen(spark, sf_dir):
    return audit.first_seen(D.audit_events(spark, sf_dir), ["actor_id", "payload"])


@query(
    """SELECT event_id, CAST(max(ms - k * 90000) OVER (PARTITION BY review_id ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) + k * 90000 AS BIGINT) AS start_ms FROM (
    SELECT event_id, review_id, seq, ms, row_number() OVER (PARTITION BY review_id ORDER BY ms, seq) - 1 AS k FROM (SELECT *, epoch_us(occurred_at) // 1000 AS ms FROM audit_events))""", D.AUDIT_EVENTS)  # fmt: skip
def min_interval_reserve(spark, sf_dir):
    return audit.reserve(D.audit_events(spark, sf_dir), 90_000)


@query("SELECT review_id, sha256(string_agg(sha256(payload), chr(10) ORDER BY seq)) AS digest FROM audit_events GROUP BY review_id", D.AUDIT_EVENTS)
def result_digest(spark, sf_dir):
    return audit.result_digest(D.audit_events(spark, sf_dir), "review_id", "seq", F.col("payload"))


# --- flow diagrams
@query("SELECT review_id, databases + registers + other AS identified, duplicates + automation + other_removed AS removed, screened, sought, assessed, ft_excluded, reports, studies FROM flows", D.FLOWS)
def prisma_totals(spark, sf_dir):
    return prisma.totals(D.flows(spark, sf_dir))


@query(
    """SELECT review_id, array_to_string(list_filter([CASE WHEN duplicates + automation + other_removed > databases + registers + other THEN 'removed_exceeds_identified' END,
    CASE WHEN screened <> databases + registers + other - duplicates - automation - other_removed THEN 'records_screened' END, CASE WHEN excluded > screened THEN 'excluded_exceeds_screened' END,
    CASE WHEN sought <> screened - excluded THEN 'reports_sought' END, CASE WHEN not_retrieved > sought THEN 'not_retrieved_exceeds_sought' END, CASE WHEN assessed <> sought - not_retrieved THEN 'reports_assessed' END,
    CASE WHEN assessed <> ft_excluded + reports THEN 'reports_assessed_outcomes' END, CASE WHEN studies > reports THEN 'studies_exceed_reports' END], lambda x: x IS NOT NULL), ',') AS codes FROM flows""", D.FLOWS)  # fmt: skip
def prisma_validate(spark, sf_dir):
    return prisma.violations(D.flows(spark, sf_dir))


@query(
    """SELECT review_id, CASE WHEN f.screened = databases + registers + other - duplicates - automation - other_removed AND duplicates + automation + other_removed <= databases + registers + other
        AND excluded <= screened AND sought = screened - excluded AND not_retrieved <= sought AND assessed = sought - not_retrieved AND assessed = ft_excluded + reports AND studies <= reports
    THEN 'flowchart TB' || chr(10) || '  databases["In databases: ' || databases || '"]' || chr(10) || '  registers["In registers: ' || registers || '"]' || chr(10) || '  elsewhere["By other ways: ' || other || '"]' || chr(10)
        || '  found["Found in all: ' || (databases + registers + other) || '"]' || chr(10)
        || '  removed["Duplicates: ' || duplicates || '<br/>Removed by automation: ' || automation || '<br/>Removed for other reasons: ' || other_removed || '"]' || chr(10)
        || '  screened["Screened: ' || screened || '"]' || chr(10) || '  rejected["Excluded by title or abstract: ' || excluded || '"]' || chr(10) || '  sought["Reports sought: ' || sought || '"]' || chr(10)
        || '  missing["Reports not obtained: ' || not_retrieved || '"]' || chr(10) || '  read["Reports read in full: ' || assessed || '"]' || chr(10) || '  refused["Excluded after reading<br/>' || coalesce(listed, 'none') || '"]' || chr(10)
        || '  kept["Studies included: ' || studies || '<br/>Reports of these: ' || reports || '"]' || chr(10)
        || '  databases --> found' || chr(10) || '  registers --> found' || chr(10) || '  elsewhere --> found' || chr(10) || '  found --> removed' || chr(10) || '  removed --> screened' || chr(10)
        || '  screened --> rejected' || chr(10) || '  screened --> sought' || chr(10) || '  sought --> missing' || chr(10) || '  sought --> read' || chr(10) || '  read --> refused' || chr(10) || '  read --> kept' || chr(10) END AS diagram
    FROM flows f LEFT JOIN (SELECT review_id, string_agg(CASE reason_id WHEN 0 THEN 'wrong &lt;population&gt;' WHEN 1 THEN 'no \'\'control\'\' &amp; arm' ELSE 'other' END || ': ' || count, '<br/>' ORDER BY reason_id) AS listed FROM exclusion_reasons GROUP BY 1) USING (review_id)""", D.FLOWS, D.EXCLUSION_REASONS)  # fmt: skip
def snk_mermaid(spark, sf_dir):
    return prisma.diagram(D.flows(spark, sf_dir), D.exclusion_reasons(spark, sf_dir))


DOMAIN_SQL = "['" + "', '".join(prisma.DOMAINS) + "']"


@query(
    f"""SELECT review_id, CASE WHEN count(DISTINCT element) < 6 THEN 'incomplete_domain_evidence' WHEN count(*) FILTER (severity IN ('major', 'critical') AND NOT resolved) > 0 THEN 'unresolved_material_findings' ELSE 'evidence_linked' END AS state FROM (
    SELECT o_custkey AS review_id, {DOMAIN_SQL}[l_linenumber % 6 + 1] AS element, CASE WHEN l_quantity > 49 THEN 'critical' WHEN l_quantity > 47 THEN 'major' ELSE 'minor' END AS severity, l_returnflag <> 'N' AS resolved
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY review_id""")  # fmt: skip
def press_state(spark, sf_dir):
    t = D.table(spark, sf_dir, "lineitem").join(D.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    element = F.element_at(F.array(*map(F.lit, prisma.DOMAINS)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    severity = F.when(F.col("l_quantity") > 49, "critical").when(F.col("l_quantity") > 47, "major").otherwise("minor")
    return prisma.peer_review_state(t.select(F.col("o_custkey").alias("review_id"), element.alias("element"), severity.alias("severity"), (F.col("l_returnflag") != "N").alias("resolved")))


# --- policy
@query(
    """SELECT record_id, array_to_string(list_filter([CASE WHEN trim(title) = '' THEN 'title.empty' END, CASE WHEN NOT year BETWEEN -10000 AND 30000 THEN 'year.range' END,
    CASE WHEN NOT regexp_matches(d, '^10\\.[^\\s]*/[^\\s]*$') THEN 'doi.invalid' END], lambda x: x IS NOT NULL), ',') AS codes FROM records JOIN normal USING (record_id)""", RECORDS, NORMAL)  # fmt: skip
def val_record(spark, sf_dir):
    return policy.record_violations(D.records(spark, sf_dir))


MARKS = [("instruction_like", "idiot"), ("instruction_like", "the "), ("secret_request", "license"), ("active_markup", "<script"), ("active_markup", "http:"), ("tool_invocation", "e-mail")]
MARK_SQL = "marks(i, category, marker) AS (VALUES " + ", ".join(f"({i}, '{c}', '{m}')" for i, (c, m) in enumerate(MARKS)) + ")"


@query(f"SELECT 'content-' || doc_id || '-' || i AS finding_id, doc_id AS subject_id, category, marker FROM documents, marks WHERE contains({LOWER.format(x='text')}, marker)", MARK_SQL)
def inspect_content(spark, sf_dir):
    return policy.inspect(D.table(spark, sf_dir, "documents"), "doc_id", "text", MARKS)


POLICY = {"deployment_modes": ["local", "hosted_single_tenant", "hosted_multi_tenant"], "classifications": ["public_metadata", "confidential", "sensitive_personal_data"], "maximum_retention_days": 40, "permitted_regions": ["EU", "UK"], "full_text": True}
REQUESTS = """requests AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS request_id, ['public_metadata', 'confidential', 'restricted_full_text', 'sensitive_personal_data'][l_orderkey % 4 + 1] AS classification,
    ['local', 'hosted_multi_tenant', 'air_gapped'][l_suppkey % 3 + 1] AS deployment_mode, ['export', 'telemetry', 'full_text_persistence', 'external_model_processing', 'storage'][l_partkey % 5 + 1] AS operation,
    CAST(l_quantity AS INT) AS retention_days, l_returnflag = 'A' AS cross_border, l_linestatus = 'F' AS dry_run, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'EU' WHEN 2 THEN 'UK' ELSE 'US' END AS region FROM lineitem),
judged AS (SELECT request_id, classification IN ('confidential', 'restricted_full_text', 'sensitive_personal_data') AS s, list_filter([
    CASE WHEN deployment_mode = 'air_gapped' THEN 'governance.deployment_mode.denied' END, CASE WHEN classification = 'restricted_full_text' THEN 'governance.classification.denied' END,
    CASE WHEN retention_days > 40 THEN 'governance.retention.exceeds_policy' END, CASE WHEN operation = 'telemetry' THEN 'governance.telemetry.denied' END, CASE WHEN operation = 'external_model_processing' THEN 'governance.external_model.denied' END,
    CASE WHEN cross_border THEN 'governance.cross_border_transfer.denied' END, CASE WHEN classification <> 'public_metadata' AND NOT dry_run THEN 'governance.human_approval.not_recorded' END,
    CASE WHEN deployment_mode = 'hosted_multi_tenant' AND classification <> 'public_metadata' THEN 'governance.multi_tenant.isolation_unproven' END,
    CASE WHEN operation = 'export' AND classification <> 'public_metadata' AND NOT dry_run THEN 'governance.export.approval_not_recorded' END,
    CASE WHEN region = 'US' THEN 'governance.region.denied' END, CASE WHEN region IS NULL THEN 'governance.region.required' END], lambda x: x IS NOT NULL) AS b,
    list_filter([CASE WHEN classification = 'sensitive_personal_data' THEN 'governance.sensitive_data.manual_review' END, CASE WHEN dry_run THEN 'governance.dry_run.no_effects' END], lambda x: x IS NOT NULL) AS w FROM requests)"""


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


@query("SELECT request_id, len(b) = 0 AS permitted, array_to_string(b, ',') AS blockers, array_to_string(w, ',') AS warnings, len(b) > 0 OR s AS human_approval_required FROM judged", REQUESTS)
def governance_evaluate(spark, sf_dir):
    region = F.when(F.col("l_linenumber") % 4 == 1, "EU").when(F.col("l_linenumber") % 4 == 2, "UK").when(F.col("l_linenumber") % 4 == 3, "US")
    requests = D.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("request_id"), _pick(["public_metadata", "confidential", "restricted_full_text", "sensitive_personal_data"], F.col("l_orderkey") % 4).alias("classification"),
        _pick(["local", "hosted_multi_tenant", "air_gapped"], F.col("l_suppkey") % 3).alias("deployment_mode"), _pick(["export", "telemetry", "full_text_persistence", "external_model_processing", "storage"], F.col("l_partkey") % 5).alias("operation"),
        F.col("l_quantity").cast("int").alias("retention_days"), (F.col("l_returnflag") == "A").alias("cross_border"), (F.col("l_linestatus") == "F").alias("dry_run"), region.alias("region"),
    )
    return policy.evaluate_handling(requests, POLICY)


@query(
    """SELECT page_id, reason IS NULL AS permitted, reason FROM (
    SELECT page_id, CASE WHEN NOT starts_with(lower(url), 'https://') THEN 'scheme_not_https' WHEN lower(regexp_extract(url, '^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) NOT IN ('blog.tionble.example.com', 'tionsh.example.net') THEN 'host_not_allowlisted' END AS reason FROM pages)""")  # fmt: skip
def authorise_endpoint(spark, sf_dir):
    return policy.authorise_endpoint(D.table(spark, sf_dir, "pages"), "url", ["blog.tionble.example.com", "tionsh.example.net"]).select("page_id", "permitted", "reason")


NETS_SQL = " OR ".join(f"n BETWEEN {sum(int(p) << (24 - 8 * i) for i, p in enumerate(net.split('.')))} AND {sum(int(p) << (24 - 8 * i) for i, p in enumerate(net.split('.'))) + (1 << (32 - bits)) - 1}" for net, bits in policy.PRIVATE_NETS)


@query(f"SELECT ip, {NETS_SQL} AS prohibited FROM (SELECT DISTINCT (o_orderkey % 256) || '.' || (o_custkey % 256) || '.0.' || (o_orderkey % 7) AS ip, (o_orderkey % 256) * 16777216 + (o_custkey % 256) * 65536 + o_orderkey % 7 AS n FROM orders)")
def ip_prohibited(spark, sf_dir):
    ip = F.concat_ws(".", F.col("o_orderkey") % 256, F.col("o_custkey") % 256, F.lit(0), F.col("o_orderkey") % 7)
    return D.table(spark, sf_dir, "orders").select(ip.alias("ip")).distinct().withColumn("prohibited", policy.private_ipv4(F.col("ip")))


@query("SELECT event_id, CAST(least(100 * pow(2.0, event_id % 9), 5000.0) AS BIGINT) AS delay_ms FROM events")
def retry_delay(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select("event_id", policy.retry_delay(F.col("event_id") % 9 + 1, 100, 5000).alias("delay_ms"))


EDGES = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view")]
EDGE_SQL = "('" + "', '".join(f"{a}>{b}" for a, b in EDGES) + "')"


@query(f"SELECT user_id, count(b) AS steps, count(*) FILTER (b <> event_type AND b || '>' || event_type NOT IN {EDGE_SQL}) AS broken FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY user_id")
def trace_verify(spark, sf_dir):
    return policy.transitions(D.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", EDGES)


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g'), 'bearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'gi'), '(api[_-]?key|token|password|secret)(\\s*[:=]\\s*)[^\\s,;]+', '\\1\\2[REDACTED]', 'gi') AS text FROM documents".replace("\\\\", "\\"))
def redact_text(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", audit.redact(F.col("text")).alias("text"))


# --- sinks
LINE = "concat('{tag}', {x})"


def _sql_lines(*parts: str) -> str:
    return f"array_to_string(list_filter(flatten([{', '.join(parts)}]), lambda x: x IS NOT NULL), chr(10))"


_one = lambda tag, x: f"['{tag}' || {x}]"
_many = lambda tag, x: f"list_transform({x}, lambda v: '{tag}' || v)"
RIS_KIND = "coalesce(map_extract(map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.RIS_TYPES.items()) + "}, kind)[1], 'GEN')"


@query("SELECT record_id, " + _sql_lines(_one("TY  - ", RIS_KIND), _one("ID  - ", "record_id"), _one("TI  - ", "title"), _many("AU  - ", "authors"), _one("JO  - ", "container"), _one("PY  - ", "CAST(year AS VARCHAR)"), _one("AB  - ", "abstract"), _one("DO  - ", "doi"), "['ER  - ']") + " AS ris FROM records", RECORDS)
def snk_ris(spark, sf_dir):
    return export.ris(D.records(spark, sf_dir))


@query("SELECT record_id, " + _sql_lines(_one("PMID- ", "pmid"), _one("TI  - ", "title"), _many("FAU - ", "authors"), _one("JT  - ", "container"), _one("DP  - ", "CAST(year AS VARCHAR)"), _one("AB  - ", "abstract"), _one("LID - ", "doi || ' [doi]'")) + " AS nbib FROM records", RECORDS)
def snk_nbib(spark, sf_dir):
    return export.nbib(D.records(spark, sf_dir))


_q = lambda x: f"'\"' || replace(coalesce({x}, ''), '\"', '\"\"') || '\"'"


@query("SELECT record_id, " + " || ',' || ".join(map(_q, ["record_id", "CAST(n AS VARCHAR)", "title", "array_to_string(authors, '; ')", "CAST(year AS VARCHAR)", "doi", "pmid", "container"])) + " AS line FROM records", RECORDS)
def snk_csv(spark, sf_dir):
    return export.csv(D.records(spark, sf_dir))


@query()
def snk_csl(spark, sf_dir):
    return export.csl(D.records(spark, sf_dir))


@query()
def snk_jsonl(spark, sf_dir):
    return export.jsonl(D.records(spark, sf_dir))


@query("SELECT 'csv' AS format, count(*) AS records_read, bit_xor(CAST(('0x' || substr(md5(record_id), 1, 12)) AS BIGINT)) AS digest_read, count(*) FILTER (n % 3 <> 0) AS records_written, bit_xor(CAST(('0x' || substr(md5(record_id), 1, 12)) AS BIGINT)) FILTER (n % 3 <> 0) AS digest_written, true AS bounded FROM records", RECORDS)
def snk_conversion_receipt(spark, sf_dir):
    r = D.records(spark, sf_dir)
    return export.receipt(r, r.where("n % 3 != 0"), "csv")


# --- sources: texts that the sinks render from the given tables are read again
def _files(rendered: DataFrame, column: str, per: int = 20) -> DataFrame:
    """Texts of several records each, as files hold them."""
    n = F.regexp_extract("record_id", "[0-9]+", 0).cast("long")
    parts = rendered.select(F.floor(n / per).alias("file"), n.alias("n"), column).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", column))).alias("p"))
    return parts.select("file", F.concat(F.array_join(F.transform("p", lambda x: x[column]), "\n\n"), F.lit("\n")).alias("text"))


SHOWN = "'{ns}-' || substr(sha256({native}), 1, 16) AS record_id, title, len(authors) AS authors, container, year"


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("record_id", "title", F.size("authors").cast("long").alias("authors"), "container", "year", *more)


CLEAN = "clean AS (SELECT *, trim(title) AS t FROM records WHERE NOT contains(coalesce(abstract, ''), chr(10)))"


@query("SELECT 'ris-' || substr(sha256(record_id), 1, 16) AS record_id, trim(title) AS title, len(authors) AS authors, container, year, CASE WHEN doi LIKE 'https%' THEN replace(doi, 'https://doi.org/', '') WHEN doi LIKE '10.%' THEN doi END AS doi, kind FROM (SELECT * REPLACE (coalesce(map_extract(map {'journal_article': 'journal_article', 'conference': 'conference', 'thesis': 'thesis', 'report': 'report', 'dataset': 'data'}, kind)[1], 'gen') AS kind) FROM clean)", RECORDS, CLEAN)
def src_ris(spark, sf_dir):
    from .sources import tagged

    r = D.records(spark, sf_dir).where(~F.contains(F.coalesce("abstract", F.lit("")), F.lit("\n")))
    got = tagged.tagged(_files(export.ris(r), "ris"), "file", "text", "ris")
    return got.where(F.col("title") != tagged.UNTITLED).select("record_id", "title", F.size("authors").cast("long").alias("authors"), "container", "year", "doi", "kind")


@query("SELECT CAST(n AS VARCHAR) AS native, trim(title) AS title, len(authors) AS authors, container, year FROM clean", RECORDS, CLEAN)
def src_nbib(spark, sf_dir):
    from .sources import tagged

    r = D.records(spark, sf_dir).where(~F.contains(F.coalesce("abstract", F.lit("")), F.lit("\n"))).withColumn("pmid", F.col("n").cast("string"))
    got = tagged.tagged(_files(export.nbib(r), "nbib"), "file", "text", "nbib")
    return got.select(F.col("native_id").alias("native"), "title", F.size("authors").cast("long").alias("authors"), "container", "year")


ONE_LINE = "sha256(trim(regexp_replace(abstract, '[\\r\\n]+', ' ', 'g'))) AS abstract_sha256"


@query(f"SELECT 'ris-' || substr(sha256(record_id), 1, 16) AS record_id, trim(title) AS title, len(authors) AS authors, container, year, {ONE_LINE} FROM records", RECORDS)
def src_ris_all(spark, sf_dir):
    """The round trip of all records, those with abstracts of several lines too."""
    from .sources import tagged

    got = tagged.tagged(_files(export.ris(export.one_line(D.records(spark, sf_dir))), "ris"), "file", "text", "ris")
    return _shown(got.where(F.col("title") != tagged.UNTITLED).withColumn("abstract_sha256", F.sha2("abstract", 256)), "abstract_sha256")


@query(f"SELECT CAST(n AS VARCHAR) AS native, trim(title) AS title, len(authors) AS authors, container, year, {ONE_LINE} FROM records", RECORDS)
def src_nbib_all(spark, sf_dir):
    """The round trip of all records, those with abstracts of several lines too."""
    from .sources import tagged

    r = export.one_line(D.records(spark, sf_dir)).withColumn("pmid", F.col("n").cast("string"))
    got = tagged.tagged(_files(export.nbib(r), "nbib"), "file", "text", "nbib")
    return got.select(F.col("native_id").alias("native"), "title", F.size("authors").cast("long").alias("authors"), "container", "year", F.sha2("abstract", 256).alias("abstract_sha256"))


@query("SELECT 'csl-' || substr(sha256(record_id), 1, 16) AS record_id, title, container, year, doi FROM records", RECORDS)
def src_csl_json(spark, sf_dir):
    from .sources import tagged

    lines = export.csl(D.records(spark, sf_dir))
    n = F.regexp_extract("record_id", "[0-9]+", 0).cast("long")
    files = lines.groupBy(F.floor(n / 20).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("csl")), ","), F.lit("]")).alias("text"))
    return tagged.csl(files, "file", "text").select("record_id", "title", "container", "year", "doi")


@query("SELECT record_id, title, year, false AS error FROM records", RECORDS)
def src_jsonl(spark, sf_dir):
    from .sources import tagged

    files = _files(export.jsonl(D.records(spark, sf_dir)), "line")
    got = tagged.json_lines(files, "file", "text", "record_id string, title string, year int")
    return got.select("record.record_id", "record.title", "record.year", "error")


def _page(r: DataFrame, item) -> DataFrame:
    return r.groupBy(F.floor(F.col("n") / 25).alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items"))


@query("SELECT 'openalex-W' || n AS record_id, title, container, year, CASE WHEN doi LIKE 'https://doi.org/%' THEN replace(doi, 'https://doi.org/', '') ELSE doi END AS doi, len(authors) AS authors, language FROM records", RECORDS)
def src_openalex(spark, sf_dir):
    from .sources import tagged

    item = F.struct(F.concat(F.lit("W"), "n").alias("id"), "doi", F.col("title").alias("display_name"), F.col("year").alias("publication_year"), "language", F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.struct(F.struct(F.col("container").alias("display_name")).alias("source")).alias("primary_location"))
    pages = _page(D.records(spark, sf_dir), item).select("page", F.to_json(F.struct(F.col("items").alias("results"))).alias("payload"))
    return tagged.openalex(pages, "page", "payload").select("record_id", "title", "container", "year", "doi", F.size("authors").cast("long").alias("authors"), F.get("languages", F.lit(0)).alias("language"))


@query("SELECT 'crossref-' || doi AS record_id, title, container, year, len(authors) AS authors FROM records WHERE doi IS NOT NULL", RECORDS)
def src_crossref(spark, sf_dir):
    from .sources import tagged

    item = F.struct(F.col("doi").alias("DOI"), F.lit("journal-article").alias("type"), F.array("title").alias("title"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("author"), F.array("container").alias("container-title"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"))
    pages = _page(D.records(spark, sf_dir).where("doi IS NOT NULL"), item).select("page", F.to_json(F.struct(F.struct("items").alias("message"))).alias("payload"))
    return tagged.crossref(pages, "page", "payload").select("record_id", "title", "container", "year", F.size("authors").cast("long").alias("authors"))


@query("SELECT 'pubmed-' || n AS record_id, title, container, year, doi, len(authors) AS authors FROM records", RECORDS)
def src_pubmed(spark, sf_dir):
    from .sources import tagged

    uid = F.col("n").cast("string")
    ids = F.array(F.struct(F.lit("pubmed").alias("idtype"), uid.alias("value")), F.struct(F.lit("doi").alias("idtype"), F.col("doi").alias("value")))
    item = F.struct("title", F.col("container").alias("fulljournalname"), F.concat(F.col("year").cast("string"), F.lit(" Jan")).alias("pubdate"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), ids.alias("articleids"))
    got = D.records(spark, sf_dir).select("n", uid.alias("uid"), F.to_json(item).alias("item")).groupBy(F.floor(F.col("n") / 25).alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", "uid", "item"))).alias("x"))
    uids = F.array_join(F.transform("x", lambda x: F.concat(F.lit('"'), x["uid"], F.lit('"'))), ",")
    items = F.array_join(F.transform("x", lambda x: F.concat(F.lit('"'), x["uid"], F.lit('":'), x["item"])), ",")
    pages = got.select("page", F.concat(F.lit('{"result":{"uids":['), uids, F.lit("],"), items, F.lit("}}")).alias("payload"))
    return tagged.pubmed(pages, "page", "payload").select("record_id", "title", "container", "year", "doi", F.size("authors").cast("long").alias("authors"))


@query(
    """SELECT provider, page, records, CAST(least(records, 120 - before) AS BIGINT) AS taken FROM (SELECT *, coalesce(sum(records) OVER (PARTITION BY provider ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT l_suppkey AS provider, l_linenumber AS page, count(*) AS records FROM lineitem GROUP BY ALL)) WHERE page <= 5 AND before < 120""")  # fmt: skip
def src_bounded_paging(spark, sf_dir):
    from .sources import tagged

    pages = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("provider"), F.col("l_linenumber").alias("page")).agg(F.count("*").alias("records"))
    return tagged.bounded(pages, "provider", "page", "records", 5, 120)


# --- search strategies
def _strategy():
    from .plans.search import And, Near, Not, Or, Strategy, Term

    tree = And((Or((Term("the", ("title_abstract",)), Term("que", ("abstract",)))), Not(Near(Term("th", ("abstract",), truncation=True), Term("the", ("abstract",)), 3), Term("src1", ("keyword",)))))
    return Strategy("s1", "pubmed", tree, from_year=1995, languages=("en", "fr"))


WORDS_SQL = "list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda t: t <> '')"
MATCH = f"""w AS (SELECT record_id, year, language, {WORDS_SQL.format(x='title')} AS tw, {WORDS_SQL.format(x='abstract')} AS aw, {WORDS_SQL.format(x="array_to_string(subjects, ' ')")} AS sw FROM records),
m AS (SELECT record_id, list_contains(tw, 'the') OR list_contains(aw, 'the') OR list_contains(aw, 'que') AS a, list_contains(sw, 'src1') AS c,
    len(list_filter(range(1, len(aw) + 1), lambda i: starts_with(aw[i], 'th') AND (list_contains(aw[greatest(i - 3, 1):i - 1], 'the') OR list_contains(aw[i + 1:i + 3], 'the')))) > 0 AS b FROM w WHERE year >= 1995 AND language IN ('en', 'fr'))"""


@query("SELECT record_id FROM m WHERE a AND b AND NOT c", RECORDS, MATCH)
def match_records(spark, sf_dir):
    from .plans.search import match_records

    return match_records(D.records(spark, sf_dir), _strategy()).select("record_id")


@query("SELECT doc_id, line, CAST(start_byte AS BIGINT) AS start_byte, CAST(end_byte AS BIGINT) AS end_byte FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS c, unnest(list_transform(range(0, len(p)), lambda i: coalesce(list_sum(list_transform(p[1:i], lambda x: strlen(x) + 1)), 0))) AS start_byte, start_byte + strlen(c) AS end_byte FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(c) <> ''")
def src_native_lines(spark, sf_dir):
    from .plans.search import native_lines

    return native_lines(D.table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line", "start_byte", "end_byte")


def _part_trees(spark, sf_dir):
    """One tree a part: its first word near its last one, and its type as a heading."""
    p = D.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("strategy_id"), F.split("p_name", " ").alias("w"), "p_type", F.col("p_size").cast("int").alias("size"))
    size = F.col("size")

    def node(name, parent, ordinal, op, **more):
        place = [F.lit(name).alias("node"), F.lit(parent).cast("string").alias("parent"), F.lit(ordinal).alias("ordinal"), F.lit(op).alias("op")]
        return F.struct(*place, *(more.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _NODE.items()))

    made = F.array(
        node("all", None, 0, "and"), node("near", "all", 0, "proximity", distance=size % 5 + 1, ordered=size % 2 == 0), node("first", "near", 0, "term", text=F.col("w")[0], fields=F.array(F.lit("title"))),
        node("last", "near", 1, "term", text=F.element_at("w", -1), fields=F.array(F.lit("title_abstract")), truncation=F.lit(True)), node("type", "all", 1, "term", text=F.col("p_type"), vocabulary=F.lit("mesh"), explode=size % 3 == 0),
    )
    none = F.array().cast("array<string>")
    strategies = p.select("strategy_id", F.lit("pubmed").alias("dialect"), (1900 + size).alias("from_year"), F.lit(None).cast("int").alias("to_year"), *(none.alias(c) for c in ("languages", "publication_types", "filters")))
    return strategies, p.select("strategy_id", F.explode(made).alias("n")).select("strategy_id", "n.*")


_NODE = {"text": "string", "fields": "array<string>", "vocabulary": "string", "explode": "boolean", "phrase": "boolean", "truncation": "boolean", "distance": "int", "ordered": "boolean"}
#: dialect, title, title and abstract, their warnings, proximity and its warnings (any order, in order), heading plain and exploded, its warning.
DIALECT_FORMS = """forms(d, t, ta, tw, taw, near, strict, nw, sw, h, hx, hw) AS (VALUES
    ('pubmed', '{}[Title]', '{}[Title/Abstract]', NULL, NULL, 'AND', 'AND', 'translation.pubmed.proximity_review', 'translation.pubmed.proximity_review', '"{}"[MeSH Terms:noexp]', '"{}"[MeSH Terms]', NULL),
    ('ovid_medline', '{}.ti.', '{}.ti,ab.', NULL, NULL, 'adj#', 'adj#', NULL, 'translation.proximity.order_degraded', '{}/', 'exp {}/', NULL),
    ('psycinfo_ovid', '{}.ti.', '{}.ti,ab.', NULL, NULL, 'adj#', 'adj#', NULL, 'translation.proximity.order_degraded', '{}/', 'exp {}/', 'translation.controlled_vocabulary.system_mismatch'),
    ('embase', '{}:ti', '{}:ti,ab', NULL, NULL, 'NEAR/#', 'NEAR/#', NULL, 'translation.proximity.order_degraded', '''{}''/de', '''{}''/exp', 'translation.controlled_vocabulary.system_mismatch'),
    ('web_of_science', 'TI=({})', 'TS=({})', NULL, 'translation.field.degraded', 'NEAR/#', 'NEAR/#', NULL, 'translation.proximity.order_degraded', '"{}"', '"{}"', 'translation.controlled_vocabulary.degraded'),
    ('scopus', 'TITLE({})', 'TITLE-ABS-KEY({})', NULL, NULL, 'W/#', 'PRE/#', NULL, NULL, '"{}"', '"{}"', 'translation.controlled_vocabulary.degraded'),
    ('cinahl_ebsco', 'TI {}', '(TI {} OR AB {})', NULL, NULL, 'N#', 'W#', NULL, NULL, 'MH "{}"', 'MH "{}+"', NULL),
    ('generic_boolean', '{}', '{}', 'translation.field.degraded', NULL, 'NEAR/#', 'NEAR/#', 'translation.proximity.generic', 'translation.proximity.generic', '"{}"', '"{}"', 'translation.controlled_vocabulary.degraded'),
    ('europe_pmc', 'TITLE:{}', '(TITLE:{} OR ABSTRACT:{})', NULL, NULL, 'AND', 'AND', 'translation.europe_pmc.proximity_degraded', 'translation.europe_pmc.proximity_degraded', 'MESH:"{}"', 'MESH:"{}"', NULL),
    ('crossref', '{}', '{}', 'translation.field.degraded', NULL, 'AND', 'AND', 'translation.proximity.lossy', 'translation.proximity.lossy', '"{}"', '"{}"', 'translation.controlled_vocabulary.degraded'),
    ('openalex', '{}', '{}', 'translation.field.degraded', NULL, 'AND', 'AND', 'translation.proximity.lossy', 'translation.proximity.lossy', '"{}"', '"{}"', 'translation.controlled_vocabulary.degraded'),
    ('clinical_trials_gov', '{}', '{}', 'translation.field.degraded', NULL, 'AND', 'AND', 'translation.proximity.lossy', 'translation.proximity.lossy', '"{}"', '"{}"', 'translation.controlled_vocabulary.degraded'))"""


@query(
    r"""SELECT p_partkey, d AS dialect, query, CASE WHEN warnings = '' THEN 'exact' WHEN regexp_matches(warnings, '\.lossy|degraded|\.generic|\.manual|\.fallback|[._]review|target_differs') THEN 'degraded' ELSE 'approximate' END AS fidelity, warnings FROM (
    SELECT p_partkey, d, '((' || replace(t, '{}', string_split(p_name, ' ')[1]) || ' ' || replace(CASE WHEN p_size % 2 = 0 THEN strict ELSE near END, '#', CAST(p_size % 5 + 1 AS VARCHAR)) || ' ' || replace(ta, '{}', string_split(p_name, ' ')[-1] || '*') || ') AND '
        || replace(CASE WHEN p_size % 3 = 0 THEN hx ELSE h END, '{}', p_type) || ')' || CASE WHEN d = 'pubmed' THEN ' AND ("' || (1900 + p_size) || '"[Date - Publication] : "3000"[Date - Publication])' ELSE '' END AS query,
        concat_ws(',', CASE WHEN d <> 'pubmed' THEN 'translation.target_differs_from_declared_dialect' END, tw, taw, CASE WHEN p_size % 2 = 0 THEN sw ELSE nw END, hw, CASE WHEN d <> 'pubmed' THEN 'translation.date_limit.manual' END) AS warnings FROM part, forms)""", DIALECT_FORMS)  # fmt: skip
def compile_strategies(spark, sf_dir):
    """One strategy per part and dialect: its title words, and the part's type as heading, rendered for every dialect."""
    from .plans import trees

    got = trees.compile_all(*_part_trees(spark, sf_dir))
    return got.select(F.col("strategy_id").cast("long").alias("p_partkey"), F.col("target").alias("dialect"), "query", "fidelity", F.array_join("warnings", ",").alias("warnings"))


@query(
    """SELECT DISTINCT s AS strategy_id, node, unnest(list_filter([CASE WHEN same > 1 THEN 'node.duplicate' END, CASE WHEN parent = '9' THEN 'node.orphan' END, CASE WHEN op IN ('and', 'or') AND kids < 2 THEN 'children.fewer_than_two' END,
        CASE WHEN op = 'proximity' AND kids <> 2 THEN 'children.not_two' END, CASE WHEN places < kids THEN 'children.repeated_ordinal' END, CASE WHEN op = 'proximity' AND kids = 2 AND places = 2 THEN 'children.ordinals' END,
        CASE WHEN op = 'term' AND kids > 0 THEN 'term.children' END, CASE WHEN op = 'proximity' AND distance < 1 THEN 'proximity.distance' END, CASE WHEN op = 'term' AND text = '' THEN 'term.empty' END], lambda x: x IS NOT NULL)) AS problem FROM judged
UNION ALL SELECT s, NULL, CASE WHEN roots = 0 THEN 'root.none' ELSE 'root.several' END FROM roots WHERE roots <> 1
UNION ALL SELECT s, node, 'node.unreached' FROM plain ANTI JOIN reach USING (s, node)""",
    """RECURSIVE nodes AS MATERIALIZED (
    SELECT CAST(l_orderkey AS VARCHAR) AS s, CAST(l_linenumber AS VARCHAR) AS node, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 AND l_orderkey % 11 = 5 THEN '4' WHEN l_linenumber = 3 AND l_orderkey % 11 = 7 THEN '9' ELSE CAST(l_linenumber // 2 AS VARCHAR) END AS parent,
        l_linenumber AS ordinal, CASE l_returnflag WHEN 'A' THEN 'and' WHEN 'N' THEN 'term' ELSE 'proximity' END AS op, CAST(l_quantity AS INT) % 3 AS distance, CASE WHEN l_linestatus = 'F' THEN '' ELSE 'x' END AS text FROM lineitem)""",
    "known AS (SELECT DISTINCT s, node FROM nodes)",
    "children AS (SELECT s, parent AS node, count(*) AS kids, count(DISTINCT ordinal) AS places FROM nodes WHERE parent IS NOT NULL GROUP BY 1, 2)",
    "judged AS (SELECT n.*, count(*) OVER (PARTITION BY s, node) AS same, coalesce(kids, 0) AS kids, coalesce(places, 0) AS places FROM (SELECT n.* REPLACE (CASE WHEN parent IS NOT NULL AND k.s IS NULL THEN '9' ELSE parent END AS parent) FROM nodes n LEFT JOIN known k ON k.s = n.s AND k.node = n.parent) n LEFT JOIN children USING (s, node))",
    "roots AS (SELECT s, count(*) FILTER (parent IS NULL) AS roots FROM nodes GROUP BY s)",
    "plain AS (SELECT n.* FROM nodes n WHERE s NOT IN (SELECT s FROM judged WHERE same > 1 OR parent = '9') AND s NOT IN (SELECT s FROM roots WHERE roots > 1))",
    "reach AS (SELECT s, node FROM plain WHERE parent IS NULL UNION SELECT p.s, p.node FROM plain p JOIN reach r ON r.s = p.s AND r.node = p.parent)",
)
def tree_problems(spark, sf_dir):
    """Trees made of line items, many of them broken: orphans, cycles, repeated nodes, wrong numbers of children."""
    from .plans import trees

    li, o, n = D.table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), F.col("l_linenumber")
    parent = F.when(n == 1, F.lit(None)).when((n == 2) & (o % 11 == 5), "4").when((n == 3) & (o % 11 == 7), "9").otherwise(F.floor(n / 2).cast("string"))
    op = F.when(F.col("l_returnflag") == "A", "and").when(F.col("l_returnflag") == "N", "term").otherwise("proximity")
    values = {"strategy_id": o, "node": n, "parent": parent, "ordinal": n, "op": op, "text": F.when(F.col("l_linestatus") == "F", "").otherwise("x"), "distance": F.col("l_quantity").cast("int") % 3}
    kinds = {"strategy_id": "string", "node": "string", "parent": "string", "ordinal": "int", "op": "string"} | _NODE
    return trees.problems(li.select(*(values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items())))


# --- study graphs, gates and evidence tables


def _graph(spark, sf_dir):
    """Reports are parts, studies suppliers, links line items with odd ends."""
    reports = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("report_id"))
    studies = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("study_id"))
    t = D.table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    links = t.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("link_id"), (F.col("l_partkey") + F.when(F.col("l_orderkey") % 50 == 0, 10_000_000).otherwise(0)).alias("report_id"), (F.col("l_suppkey") + F.when(F.col("l_orderkey") % 70 == 0, 10_000_000).otherwise(0)).alias("study_id"))
    return reports, studies, links


GRAPH = """links AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) AS link_id, l_partkey + CASE WHEN l_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS report_id,
    l_suppkey + CASE WHEN l_orderkey % 70 = 0 THEN 10000000 ELSE 0 END AS study_id FROM lineitem WHERE l_linenumber = 1)"""


@query("SELECT link_id, 'report_id' AS \"end\" FROM links WHERE report_id NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT link_id, 'study_id' FROM links WHERE study_id NOT IN (SELECT s_suppkey FROM supplier)", GRAPH)
def graph_ref_integrity(spark, sf_dir):
    reports, studies, links = _graph(spark, sf_dir)
    return study.dangling_links(links, reports, studies)


@query("SELECT p_partkey AS report_id FROM part WHERE p_partkey NOT IN (SELECT report_id FROM links)", GRAPH)
def unlinked_reports(spark, sf_dir):
    reports, _, links = _graph(spark, sf_dir)
    return study.unlinked_reports(reports, links)


@query("SELECT s_suppkey AS study_id, count(DISTINCT report_id) AS reports FROM supplier LEFT JOIN links ON study_id = s_suppkey GROUP BY s_suppkey", GRAPH)
def reports_per_study(spark, sf_dir):
    _, studies, links = _graph(spark, sf_dir)
    return study.reports_per_study(studies, links)


@query("SELECT p_partkey AS report_id, coalesce(o, 'not_attempted') AS outcome FROM part LEFT JOIN (SELECT l_partkey, max_by(l_returnflag, l_orderkey * 10 + l_linenumber) AS o FROM (SELECT l_partkey, l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) GROUP BY l_partkey) ON l_partkey = p_partkey")
def retrieval_latest(spark, sf_dir):
    t = D.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_partkey").alias("report_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("turn")).agg(F.min("l_returnflag").alias("outcome"))
    return study.latest_attempt(_graph(spark, sf_dir)[0], t)


SEEDS = """seeds AS (SELECT DISTINCT o_custkey % 20 AS strategy, o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0), got AS (SELECT DISTINCT o_custkey % 20 AS strategy, o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0),
recalls AS (SELECT strategy, count(*) AS total, count(g.k) AS found, count(g.k) / count(*) AS recall FROM seeds LEFT JOIN got g USING (strategy, k) GROUP BY strategy)"""


def _recall(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("strategy"), F.col("o_orderkey").alias("k"))
    return study.seed_recall(o.where("k % 3 = 0"), o.where("k % 7 != 0"), "strategy", "k")


@query("SELECT * FROM recalls", SEEDS)
def seed_recall(spark, sf_dir):
    return _recall(spark, sf_dir)


@query("SELECT strategy, coalesce(u, 0) AS unresolved, recall, coalesce(u, 0) = 0 AND recall >= 0.85 AS ready FROM recalls LEFT JOIN (SELECT o_custkey % 20 AS strategy, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 499000) AS u FROM orders GROUP BY ALL) USING (strategy)", SEEDS)
def search_validation(spark, sf_dir):
    findings = D.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("strategy"), (F.col("o_orderstatus") == "F").alias("resolved"), F.when(F.col("o_totalprice") > 499000, "major").otherwise("minor").alias("severity"))
    return study.validation_ready(findings, _recall(spark, sf_dir), "strategy", 0.85)


@query("SELECT b.event_type AS name, round(b.v - c.v, 9) AS drop, coalesce(b.v - c.v <= 0.5, false) AS passed FROM (SELECT event_type, round(avg(value), 6) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL) b LEFT JOIN (SELECT event_type, round(avg(value), 6) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL) c USING (event_type)")
def regression_gate(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    side = lambda r: e.where(f"event_id % 2 = {r}").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("value"))
    return study.regressions(side(0), side(1), 0.5)


@query("SELECT * FROM (SELECT doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'undeclared' WHEN doc_id % 19 = 0 THEN 'changed' ELSE 'same' END AS state FROM documents WHERE NOT (doc_id % 13 = 0 AND doc_id % 17 = 0))")
def bundle_members(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("digest"))
    return study.members(d.where("path % 17 != 0"), d.where("path % 13 != 0").withColumn("digest", F.when(F.col("path") % 19 == 0, F.lit("other")).otherwise(F.col("digest"))))


@query("SELECT o_orderkey AS id, o_custkey AS k, o_orderdate >= TIMESTAMP '1995-01-01' AND (o_custkey % 3 = 0 OR o_orderdate < TIMESTAMP '1998-01-01') AND c_custkey IS NOT NULL AS valid FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0")
def validity_interval(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"))
    until = F.when(F.col("c_custkey") % 3 != 0, F.lit("1998-01-01").cast("timestamp_ntz"))
    periods = D.table(spark, sf_dir, "customer").where("c_custkey % 5 != 0").select(F.col("c_custkey").alias("k"), F.lit("1995-01-01").cast("timestamp_ntz").alias("start"), until.alias("end"))
    return study.valid_on(rows, periods, "k", "d").select("id", "k", "valid")


@query("SELECT event_id, event_type AS code, CASE event_type WHEN 'error' THEN 'Something failed' WHEN 'view' THEN 'Seen' ELSE event_type END AS message FROM events")
def localise(spark, sf_dir):
    catalogue = spark.createDataFrame([("error", "Something failed"), ("view", "Seen")], "code string, message string")
    return study.localise(D.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("code")), catalogue).select("event_id", "code", "message")


@query("SELECT user_id, CASE WHEN bool_and(value > 3) THEN 'replay' WHEN bool_or(value > 3) THEN 'mixed-live-replay' ELSE 'live' END AS mode FROM events GROUP BY user_id")
def execution_mode(spark, sf_dir):
    return study.execution_mode(D.table(spark, sf_dir, "events").select("user_id", (F.col("value") > 3).alias("cached")), "user_id")


@query("SELECT c_nationkey, count(*) FILTER (c_acctbal < -900) = 0 AS ready, coalesce(string_agg(c_name, ',' ORDER BY c_name) FILTER (c_acctbal < -900), '') AS unhealthy, coalesce(string_agg(c_name, ',' ORDER BY c_name) FILTER (c_acctbal BETWEEN -900 AND -500), '') AS degraded FROM customer GROUP BY c_nationkey")
def readiness(spark, sf_dir):
    state = F.when(F.col("c_acctbal") < -900, "unhealthy").when(F.col("c_acctbal") <= -500, "degraded").otherwise("healthy")
    return study.readiness(D.table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_name").alias("component"), state.alias("state")), "c_nationkey")


@query(
    """SELECT request_id, reason IS NULL AS allowed, reason FROM (SELECT event_id AS request_id, CASE WHEN user_id % 6 NOT IN (0, 1, 2, 3) THEN 'tenant.denied' WHEN event_type = 'error' THEN 'scope.missing:admin+audit' WHEN event_type = 'signup' THEN 'scope.missing:admin'
    WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'write.human_required' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'final.human_required' END AS reason FROM events)""")  # fmt: skip
def access_authorise(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    needed = F.when(F.col("event_type") == "error", F.array(F.lit("audit"), F.lit("admin"))).when(F.col("event_type") == "signup", F.array(F.lit("admin"), F.lit("read"))).otherwise(F.array(F.lit("read")))
    requests = e.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 6).alias("tenant"), needed.alias("needed"), (F.col("event_type") == "purchase").alias("write"), (F.col("event_type") == "click").alias("final"), F.when(F.col("event_id") % 4 == 0, "agent").otherwise("human").alias("actor_kind"))
    return study.authorise(requests, F.array(F.lit("read"), F.lit("write")), F.array(*(F.lit(i).cast("long") for i in range(4))))


@query("SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS turn FROM lineitem GROUP BY l_partkey")
def set_distinct_first(spark, sf_dir):
    t = D.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("turn"), "l_shipdate")
    return study.first_entities(t, "id", "turn").select("id", "turn")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def tombstone_view(spark, sf_dir):
    gone = D.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return study.live_objects(D.table(spark, sf_dir, "part"), gone, "p_partkey").select("p_partkey", "p_name")


MERKLE = """RECURSIVE leaf AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, sha256(o_orderstatus || o_orderkey) AS h FROM orders),
tree AS (SELECT g, 0 AS depth, list(h ORDER BY i) AS hs, count(*) AS leaves FROM leaf GROUP BY g UNION ALL
    SELECT g, depth + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], hs[2 * i + 1]))), leaves FROM tree WHERE len(hs) > 1)"""


@query("SELECT g AS o_custkey, leaves, hs[1] AS root FROM tree WHERE len(hs) = 1", MERKLE)
def merkle_root(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").withColumn("leaf", F.concat("o_orderstatus", F.col("o_orderkey").cast("string")))
    return study.merkle_roots(o, "o_custkey", "o_orderkey", "leaf")


@query("SELECT doc_id, CASE WHEN n = '' THEN 'missing' WHEN n IN ('none', 'not applicable') THEN 'not_applicable' ELSE 'complete' END AS status FROM (SELECT doc_id, coalesce(CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'none' WHEN 2 THEN 'not applicable' WHEN 3 THEN lower(trim(source)) END, '') AS n FROM documents)")
def prisma_s_ledger(spark, sf_dir):
    note = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 5 == 1, " None").when(F.col("doc_id") % 5 == 2, "Not Applicable").when(F.col("doc_id") % 5 == 3, F.col("source"))
    return D.table(spark, sf_dir, "documents").select("doc_id", prisma.ledger_status(note).alias("status"))


@query("SELECT o_orderkey AS id, CASE WHEN NOT u AND p IS NOT NULL THEN 'unexpected_update_lineage' WHEN u AND p IS NULL THEN 'missing_update_lineage' WHEN u AND p = o_orderkey THEN 'self_referential_update_lineage' END AS violation FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS u, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 END AS p FROM orders)")
def prisma_variant(spark, sf_dir):
    k = F.col("o_orderkey")
    prior = F.when(k % 3 == 0, k).when(k % 3 == 1, k - 1).cast("string")
    return D.table(spark, sf_dir, "orders").select(k.alias("id"), prisma.variant_violation(k % 2 == 0, prior, k.cast("string")).alias("violation"))


# --- contract validators: each over rows that a table gives by plain expressions, which both engines read alike
CONTRACT_ROWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "policy": ("customer", "c_custkey", {"budget": "c_custkey % 9 - 1", "total_budget": "c_custkey % 7", "cache": "c_custkey % 2 = 0", "replay": "c_custkey % 3 = 0", "retries": "c_custkey % 5 - 1"}),
    "page": ("orders", "o_orderkey", {"cursor_text": "CASE WHEN o_orderkey % 4 = 0 THEN ' ' WHEN o_orderkey % 4 = 1 THEN 'c' END", "records": "o_custkey % 30", "page_size": "o_orderkey % 40", "total_available": "o_orderkey % 50"}),
    "receipt": ("part", "p_partkey", {"written": "p_size", "rejected": "p_partkey % 3", "received": "p_size + p_partkey % 4", "digest": "sha2hex", "pages": "p_partkey % 5"}),
    "living_run": ("orders", "o_orderkey", {"completed": "o_orderstatus = 'F'", "status": "CASE WHEN o_orderkey % 5 < 3 THEN 'completed' ELSE 'running' END", "parent_id": "CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey ELSE o_orderkey - 1 END", "run_id": "o_orderkey", "changes": "o_custkey % 3", "released": "o_orderkey % 2 = 0"}),
    "discovery_run": ("orders", "o_orderkey", {"maximum_depth": "o_orderkey % 4", "maximum_records": "o_custkey % 5", "source": "o_custkey % 20", "target": "o_orderkey % 20", "human_release": "o_orderkey % 9 <> 0"}),
    "calibration": ("supplier", "s_suppkey", {"threshold": "s_acctbal / 8000", "approved": "s_suppkey % 2 = 0", "approver": "CASE WHEN s_suppkey % 3 = 0 THEN s_name END", "sensitivity": "s_suppkey % 10", "minimum": "5", "auto_exclusion_prohibited": "s_suppkey % 7 <> 0"}),
    "benchmark_report": ("events", "event_id", {"low": "event_id % 10", "high": "event_id % 12", "n": "event_id % 4"}),
    "envelope": ("customer", "c_custkey", {"network": "c_custkey % 2 = 0", "hosts": "c_custkey % 3", "approver": "CASE WHEN c_custkey % 5 > 1 THEN c_name END"}),
    "document_evidence": ("documents", "doc_id", {"start_at": "doc_id % 700", "end_at": "doc_id % 900", "size": "n_chars", "confidence": "(doc_id % 13) - 1", "canonical_write": "doc_id % 17 = 0"}),
    "diagnostic": ("part", "p_partkey", {"code": "replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '..' ELSE '.' END)", "column_no": "CASE WHEN p_partkey % 4 = 0 THEN 3 END", "line_no": "CASE WHEN p_partkey % 5 > 1 THEN p_partkey % 5 - 2 END", "blocking": "p_size > 25", "severity": "CASE WHEN p_size > 30 THEN 'error' ELSE 'warning' END"}),
    "governance_policy": ("supplier", "s_suppkey", {"retention_days": "s_suppkey % 30", "region": "CASE WHEN s_suppkey % 3 = 0 THEN 'eu' ELSE 'EU' END", "permitted": "s_suppkey % 4 = 0", "blockers": "s_suppkey % 3"}),
    "lifecycle_request": ("lineitem", "l_orderkey", {"preview": "l_linestatus = 'F'", "approval": "CASE WHEN l_linenumber > 3 THEN l_partkey END", "action": "CASE l_returnflag WHEN 'A' THEN 'delete' WHEN 'N' THEN 'export' ELSE 'retain' END", "retention": "CASE WHEN l_suppkey % 2 = 0 THEN 30 END", "targets": "l_quantity % 4"}),
    "licensed": ("pages", "page_id", {"host": "regexp_host", "raw_persisted": "page_id % 11 = 0", "env": "CASE WHEN page_id % 5 = 0 THEN 'api_key' ELSE 'API_KEY' END"}),
    "component": ("part", "p_partkey", {"digest": "sha2hex", "memory": "p_size - 2", "hosts": "p_partkey % 3", "network": "p_partkey % 2 = 0"}),
    "amendment": ("orders", "o_orderkey", {"new_version": "o_orderkey % 3", "old_version": "o_custkey % 3", "decided": "o_orderstatus = 'F'", "decider": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END"}),
    "standard_assessment": ("lineitem", "l_orderkey", {"state": "CASE l_returnflag WHEN 'A' THEN 'met' WHEN 'N' THEN 'partial' ELSE 'not_applicable' END", "evidence": "l_linenumber % 3", "note": "CASE WHEN l_partkey % 6 = 0 THEN '  ' ELSE 'x' END"}),
    "named_filter": ("orders", "o_orderkey", {"effective": "o_orderkey % 100", "expires": "o_custkey % 150", "redistribution": "o_orderkey % 8 <> 0", "today": "60"}),
    "plan": ("customer", "c_custkey", {"sources": "c_custkey % 4", "peer_review": "c_custkey % 3 <> 0"}),
    "parity": ("supplier", "s_suppkey", {"equivalent": "s_suppkey % 2 = 0", "approved": "s_suppkey % 3 = 0", "cutover": "s_suppkey % 5 = 0", "blockers": "s_suppkey % 4"}),
    "backup": ("nation", "n_nationkey", {"encrypted": "n_nationkey % 3 <> 0", "permitted": "n_nationkey % 2 = 0", "restored_at": "CASE WHEN n_nationkey % 5 = 0 THEN n_name END"}),
}
#: The two expressions that the engines spell differently: Spark, DuckDB.
SPELLED = {"sha2hex": ("CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE sha2(p_name, 256) END", "CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE sha256(p_name) END"), "regexp_host": (r"regexp_extract(url, '://([^/]*)', 1)", r"regexp_extract(url, '://([^/]*)', 1)")}


def _add_validator(contract: str, source: str, key: str, columns: dict[str, str]) -> None:

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = D.table(spark, sf_dir, source).selectExpr("*", *(f"{SPELLED.get(x, (x,))[0]} AS {name}" for name, x in columns.items()))
        return validators.violations(rows, key, contract)

    shown = ", ".join(f"{SPELLED.get(x, (x, x))[1]} AS {name}" for name, x in columns.items())
    QUERIES[f"val_{contract}"] = run
    ORACLE_SQL[f"val_{contract}"] = validators.sql(contract, key, f"(SELECT *, {shown} FROM {source})")


for _name, _spec in CONTRACT_ROWS.items():
    _add_validator(_name, *_spec)


# --- metrics of duplicate detection, replay keys and delivery chains
@query(
    """SELECT 'dedup.pair.' || name AS name, value, 'proportion' AS unit, n AS sample_size FROM (
    SELECT tp + fp + fn AS n, unnest(['precision', 'recall', 'f1']) AS name, unnest([tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0), CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END]) AS value FROM (
        SELECT count(*) FILTER (e AND o) AS tp, count(*) FILTER (o AND NOT e) AS fp, count(*) FILTER (e AND NOT o) AS fn FROM (
            SELECT coalesce(x.e, false) AS e, coalesce(y.o, false) AS o FROM (SELECT a.record_id AS l, b.record_id AS r, true AS e FROM records a JOIN records b ON a.title = b.title AND a.record_id < b.record_id) x
            FULL JOIN (SELECT left_id AS l, right_id AS r, true AS o FROM exact) y USING (l, r)))) WHERE value IS NOT NULL""", RECORDS, NORMAL, KEYS, EXACT)  # fmt: skip
def metric_rows(spark, sf_dir):
    r = D.records(spark, sf_dir)
    return ranking.metric_rows("dedup.pair", ranking.cluster_metrics(r.select(F.col("title"), "record_id"), dedup.exact_matches(r)))


@query("SELECT event_id, sha256(array_to_string(['search', CAST(user_id AS VARCHAR), event_type, payload], chr(0))) AS replay_key, count(*) OVER (PARTITION BY user_id, event_type, payload) > 1 AS shared FROM (SELECT *, props AS payload FROM events)")
def src_page_cache(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("\0", F.lit("search"), "user_id", "event_type", "props"), 256).alias("replay_key"))
    cache = e.groupBy("replay_key").agg((F.count("*") > 1).alias("shared"))
    return e.join(cache, "replay_key").select("event_id", "replay_key", "shared")


@query("SELECT n_regionkey, count(*) - 1 AS steps, max(n_name) AS head FROM nation GROUP BY n_regionkey")
def lifecycle_head(spark, sf_dir):
    """The head of each region's chain of nations, each linked to the one before by name."""
    from pyspark.sql import Window as W

    w = W.partitionBy("n_regionkey").orderBy("n_name")
    chain = D.table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("id"), F.lag("n_name").over(w).alias("previous"))
    runs = living.lineage(chain.select(F.col("id").alias("run_id"), F.col("previous").alias("parent_id")))
    heads = chain.join(chain.select(F.col("previous").alias("id")).where("id IS NOT NULL"), "id", "left_anti")
    return heads.join(runs, heads["id"] == runs["run_id"]).select("n_regionkey", F.col("ancestors").cast("long").alias("steps"), F.col("id").alias("head"))


# --- further provider pages
def _json_pages(items: DataFrame, head: str, tail: str) -> DataFrame:
    """Pages of 25 items (n, item) as JSON texts."""
    got = items.groupBy(F.floor(F.col("n") / 25).alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("x"))
    return got.select("page", F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x["item"]), ","), F.lit(tail)).alias("payload"))


BLOCKS = "blocks AS (SELECT *, n // 25 AS page, row_number() OVER (PARTITION BY n // 25 ORDER BY n) - 1 AS block FROM records)"


@query(
    """SELECT page, CASE WHEN n % 13 <> 0 THEN 'W' || n ELSE 'europe-pmc-' || block END AS record_id, CASE WHEN n % 13 <> 0 THEN 'W' || n ELSE '' END AS native_id, CASE WHEN n % 19 = 0 THEN '[untitled]' ELSE title END AS title, container,
    CASE WHEN n % 17 <> 0 THEN year END AS year, doi, pmid, CASE WHEN len(authors) = 0 THEN 0 ELSE 1 END AS authors, sha256(abstract) AS abstract_sha256 FROM blocks""", RECORDS, BLOCKS)  # fmt: skip
def src_europepmc(spark, sf_dir):
    from .sources import tagged

    r, n = D.records(spark, sf_dir), F.col("n")
    item = F.struct(
        F.when(n % 13 != 0, F.concat(F.lit("W"), "n")).alias("id"), "doi", "pmid", F.when(n % 19 != 0, F.col("title")).alias("title"), F.col("abstract").alias("abstractText"), F.when(F.size("authors") > 0, F.array_join("authors", ", ")).alias("authorString"),
        F.col("container").alias("journalTitle"), F.when(n % 17 == 0, F.concat(F.col("year").cast("string"), F.lit(" Jan"))).otherwise(F.col("year").cast("string")).alias("pubYear"),
    )
    pages = _json_pages(r.select("n", F.to_json(item).alias("item")), '{"hitCount":7,"resultList":{"result":[', "]}}")
    got = tagged.europepmc(pages, "page", "payload")
    return got.select("page", "record_id", "native_id", "title", "container", "year", "doi", "pmid", F.size("authors").cast("long").alias("authors"), F.sha2("abstract", 256).alias("abstract_sha256"))


@query(
    """SELECT page, 'clinicaltrials-' || coalesce(trim(trial), 'trial-' || block) AS record_id, CASE WHEN n % 19 = 0 THEN '[untitled trial]' ELSE title END AS title, trim(trial) AS trial, array_to_string(subjects, ',') AS subjects,
    'https://clinicaltrials.gov/study/' || coalesce(trim(trial), 'trial-' || block) AS url, CAST(year AS VARCHAR) AS date, sha256(abstract) AS abstract_sha256 FROM blocks""", RECORDS, BLOCKS)  # fmt: skip
def src_ctgov(spark, sf_dir):
    from .sources import tagged

    r, n = D.records(spark, sf_dir), F.col("n")
    title = F.when(n % 19 != 0, F.col("title"))
    names = [F.trim("trial").alias("nctId"), F.when(n % 5 != 0, title).alias("briefTitle"), F.when(n % 5 == 0, title).alias("officialTitle")]
    more = [F.struct(F.col("subjects").alias("conditions")).alias("conditionsModule"), F.struct(F.col("abstract").alias("briefSummary")).alias("descriptionModule"), F.struct(F.struct(F.col("year").cast("string").alias("date")).alias("startDateStruct")).alias("statusModule")]
    nested = F.struct(F.struct(*names).alias("identificationModule"), *more)
    item = F.when(n % 6 == 1, F.to_json(nested)).when(n % 6 == 2, F.to_json(F.struct(F.struct(*names, *more).alias("protocolSection")))).otherwise(F.to_json(F.struct(nested.alias("protocolSection"))))
    pages = _json_pages(r.select("n", item.alias("item")), '{"studies":[', '],"nextPageToken":"t"}')
    got = tagged.ctgov(pages, "page", "payload")
    return got.select("page", "record_id", "title", "trial", F.array_join("subjects", ",").alias("subjects"), F.get("urls", F.lit(0)).alias("url"), "date", F.sha2("abstract", 256).alias("abstract_sha256"))


@query("SELECT o_orderkey AS page, CASE WHEN o_orderkey % 5 <> 0 THEN 'c' || o_custkey END AS next_cursor, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS total_available, CASE WHEN o_orderkey % 11 = 0 THEN 'response omitted the list of records' END AS error FROM orders")
def src_page_envelope(spark, sf_dir):
    from .sources import tagged

    k = F.col("o_orderkey")
    body = F.struct(F.when(k % 5 != 0, F.concat(F.lit("c"), "o_custkey")).alias("nextPageToken"), F.when(k % 7 != 0, F.col("o_custkey")).alias("totalCount"), F.when(k % 11 != 0, F.array("o_orderstatus")).alias("studies"))
    return tagged.envelope(D.table(spark, sf_dir, "orders").select(k.alias("page"), F.to_json(body).alias("payload")), "page", "payload", "clinicaltrials-gov")


# --- adjudication, batches, derived flows and gates
ADJUDICATED = """boards AS (
    SELECT subject_id, round, coalesce(list(DISTINCT decision_id) FILTER (reviewer_kind <> 'agent'), []) AS ids, list(DISTINCT reviewer_id) AS reviewers, count(*) FILTER (reviewer_kind <> 'agent') AS humans,
        count(DISTINCT decision) FILTER (reviewer_kind <> 'agent') AS kinds FROM decisions GROUP BY ALL),
asked AS (
    SELECT *, 1 AS turn, subject_id % 7 AS adjudicator, CASE WHEN subject_id % 11 = 0 THEN list_append(ids, 'other') WHEN subject_id % 3 = 0 THEN list_filter(ids, lambda x: x <> list_min(ids)) ELSE ids END AS named FROM boards UNION ALL
    SELECT boards.*, t, 99, ids FROM boards, (VALUES (2), (3)) v(t)),
wrongs AS (
    SELECT *, CASE WHEN humans < 2 OR kinds < 2 THEN 'no_conflict' WHEN NOT list_has_all(ids, named) THEN 'unknown_decision' WHEN NOT list_has_all(named, ids) THEN 'incomplete_resolution'
        WHEN list_contains(reviewers, adjudicator) THEN 'adjudicator_not_independent' END AS wrong FROM asked)"""


@query(
    """SELECT subject_id || '-' || round || '-' || turn AS request_id, a.wrong IS NULL AND NOT EXISTS (FROM wrongs b WHERE b.subject_id = a.subject_id AND b.round = a.round AND b.turn < a.turn AND b.wrong IS NULL) AS accepted,
    CASE WHEN EXISTS (FROM wrongs b WHERE b.subject_id = a.subject_id AND b.round = a.round AND b.turn < a.turn AND b.wrong IS NULL) THEN 'round_finalized' ELSE a.wrong END AS rejection FROM wrongs a""", D.DECISIONS, ADJUDICATED)  # fmt: skip
def resolve_conflict(spark, sf_dir):
    """Three adjudications of each round: an incomplete, strange or dependent one for some, then two complete ones."""
    d = D.decisions(spark, sf_dir)
    ids = F.collect_set(F.when(F.col("reviewer_kind") != "agent", F.col("decision_id")))
    asked = d.groupBy("subject_id", "round").agg(ids.alias("ids")).withColumn("turn", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    first, s = F.col("turn") == 1, F.col("subject_id")
    named = F.when(first & (s % 11 == 0), F.array_append("ids", "other")).when(first & (s % 3 == 0), F.array_except("ids", F.array(F.array_min("ids")))).otherwise(F.col("ids"))
    asked = asked.select("subject_id", "round", F.concat_ws("-", "subject_id", "round", "turn").alias("request_id"), F.when(first, s % 7).otherwise(99).alias("adjudicator_id"), named.alias("decision_ids"))
    return screening.resolve(d, asked)


@query(
    """SELECT o_orderkey AS board_id, CASE WHEN n IS NULL THEN 'empty_submission' WHEN o_orderkey % 13 = 0 THEN 'stale_preview' WHEN first_rejection IS NOT NULL THEN 'rejected' ELSE 'applied' END AS state, coalesce(n, 0) AS decisions, first_rejection
    FROM orders LEFT JOIN (SELECT subject_id, count(*) AS n, first(rejection ORDER BY decided_at, decision_id, rejection) FILTER (rejection IS NOT NULL) AS first_rejection FROM broken GROUP BY subject_id) ON subject_id = o_orderkey""",
    D.DECISIONS, ADMIT, """broken AS (SELECT subject_id, decided_at, decision_id, coalesce(wrong, CASE WHEN same > 1 THEN 'duplicate_decision_id' WHEN turn > 1 THEN 'duplicate_reviewer' WHEN counts AND humans > 2 THEN 'independent_review_complete' END) AS rejection FROM u)""")
def bulk_preview_apply(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("board_id"), F.lit(0).alias("revision"), F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(0).alias("base_revision"))
    return screening.apply_bulk(D.decisions(spark, sf_dir).withColumn("board_id", F.col("subject_id")), o)


@query(
    """SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, review_required_clusters / nullif(proposed_clusters, 0) AS review_required_cluster_rate FROM (
    SELECT (SELECT count(*) FROM e JOIN o USING (l, r)) AS tp, (SELECT count(*) FROM o ANTI JOIN e USING (l, r)) AS fp, (SELECT count(*) FROM e ANTI JOIN o USING (l, r)) AS fn, (SELECT count(*) FROM clusters) AS proposed_clusters,
        (SELECT count(DISTINCT component) FROM unsure) AS review_required_clusters, (SELECT count(*) FROM members WHERE component IN (SELECT component FROM unsure)) AS review_required_records)""",
    *CLUSTER_CTES, "e AS (SELECT a.record_id AS l, b.record_id AS r FROM records a JOIN records b ON a.title = b.title AND a.record_id < b.record_id)",
    "o AS (SELECT a.record_id AS l, b.record_id AS r FROM members a JOIN members b ON a.component = b.component AND a.record_id < b.record_id)",
    "unsure AS (SELECT component FROM members JOIN (SELECT left_id FROM fuzzy ANTI JOIN exact USING (left_id, right_id)) ON left_id = record_id)")
def dedup_evaluation(spark, sf_dir):
    r = D.records(spark, sf_dir)
    observed = cut(dedup.members(r).select(F.col("component").alias("cluster_id"), "record_id"))
    return ranking.dedup_evaluation(r.select(F.col("title").alias("cluster_id"), "record_id"), observed, dedup.review_evidence(r))


DERIVED = """d AS (
    SELECT o_custkey AS review_id, l_orderkey || '-' || l_linenumber % 6 AS decision_id, l_orderkey AS subject_id, CASE WHEN l_linestatus = 'F' THEN 'full_text' ELSE 'title_abstract' END AS stage,
        CASE l_returnflag WHEN 'A' THEN 'include' WHEN 'N' THEN 'exclude' ELSE 'unclear' END AS decision, l_partkey % 97 = 0 AS agent FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 10 <> 0 OR l_suppkey % 5 = 0),
c AS (SELECT review_id, count(*) FILTER (stage = 'title_abstract' AND decision = 'exclude') AS te, count(*) FILTER (stage = 'title_abstract' AND decision = 'include') AS rs, count(*) FILTER (stage = 'full_text' AND decision = 'exclude') AS fe,
    count(*) FILTER (stage = 'full_text' AND decision = 'include') AS ri, count(*) FILTER (agent) AS agents, count(*) FILTER (subject_id % 10 = 0) AS strange, count(*) - count(DISTINCT decision_id) AS same FROM d GROUP BY review_id),
b AS (SELECT o_custkey AS review_id, count(*) AS input_records, count(*) FILTER (o_orderkey % 10 = 0) AS duplicate_records, count(*) FILTER (o_orderkey % 10 <> 0) AS unique_records FROM orders GROUP BY o_custkey),
p AS (SELECT b.*, te, rs, fe, ri, array_to_string(list_filter([CASE WHEN agents > 0 THEN 'decision_not_human' END, CASE WHEN strange > 0 THEN 'unknown_record' END, CASE WHEN same > 0 THEN 'duplicate_decision_id' END], lambda x: x IS NOT NULL), ',') AS problems
    FROM b LEFT JOIN c USING (review_id)),
k AS (SELECT review_id, input_records, duplicate_records, unique_records, CASE WHEN problems = '' THEN coalesce(te, 0) END AS title_abstract_excluded, CASE WHEN problems = '' THEN coalesce(rs, 0) END AS reports_sought,
    CASE WHEN problems = '' THEN coalesce(fe, 0) END AS full_text_excluded, CASE WHEN problems = '' THEN coalesce(ri, 0) END AS reports_included, problems FROM p)"""


@query("SELECT *, reports_sought = full_text_excluded + reports_included AS arithmetic_holds FROM k", DERIVED)
def prisma_derive(spark, sf_dir):
    o, key = D.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    lines = D.table(spark, sf_dir, "lineitem").where("l_orderkey % 10 != 0 OR l_suppkey % 5 = 0").join(o.select(key.alias("l_orderkey"), F.col("o_custkey").alias("review_id")), "l_orderkey")
    decision = F.when(F.col("l_returnflag") == "A", "include").when(F.col("l_returnflag") == "N", "exclude").otherwise("unclear")
    lines = lines.select(
        "review_id", F.concat_ws("-", "l_orderkey", F.col("l_linenumber") % 6).alias("decision_id"), F.col("l_orderkey").alias("subject_id"), F.when(F.col("l_linestatus") == "F", "full_text").otherwise("title_abstract").alias("stage"),
        decision.alias("decision"), F.when(F.col("l_partkey") % 97 == 0, "agent").otherwise("human").alias("reviewer_kind"),
    )
    return prisma.derive(o.select(F.col("o_custkey").alias("review_id"), key.alias("record_id"), (key % 10 == 0).alias("duplicate")), lines)


PLANTED_SECRETS = "CASE doc_id % 50 WHEN 3 THEN ' AKIA' || upper(substr(md5(text), 1, 16)) WHEN 7 THEN ' Api_Key = ' || md5(text) WHEN 13 THEN ' ghp_' || substr(md5(text), 1, 20) WHEN 17 THEN ' -----BEGIN EC PRIVATE KEY-----' WHEN 19 THEN ' password: short' ELSE '' END"
SECRET_DATA = f"""s AS (SELECT CASE WHEN doc_id % 50 = 11 THEN 'd/' || doc_id || '/.ENV' ELSE 'd/' || doc_id || '.txt' END AS path, text || {PLANTED_SECRETS} AS text FROM documents),
found AS (SELECT path, 'filename' AS finding FROM s WHERE path LIKE '%/.ENV' UNION ALL SELECT path, 'private_key' FROM s WHERE regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----')
    UNION ALL SELECT path, 'github_token' FROM s WHERE regexp_matches(text, '\\bgh[pousr]_[A-Za-z0-9_]{{20,}}\\b') UNION ALL SELECT path, 'aws_key' FROM s WHERE regexp_matches(text, '\\bAKIA[0-9A-Z]{{16}}\\b')
    UNION ALL SELECT path, 'credential' FROM s WHERE regexp_matches(text, '(?i)\\b(password|passwd|api[_-]?key|client[_-]?secret)\\s*[:=]\\s*[''"]?[^\\s''"]{{8,}}'))"""


@query("SELECT path, finding FROM found", SECRET_DATA)
def scan_secrets(spark, sf_dir):
    """All documents, some with secrets planted at their end and some under a prohibited name."""
    d = D.table(spark, sf_dir, "documents").selectExpr("CASE WHEN doc_id % 50 = 11 THEN 'd/' || doc_id || '/.ENV' ELSE 'd/' || doc_id || '.txt' END AS path", f"text || {PLANTED_SECRETS} AS text")
    return policy.scan_secrets(d, "path", "text")


LIFECYCLE = {"policy_id": "p1", "classifications": ["public_metadata", "confidential"], "maximum_retention_days": 40}
CLAIMS = """claims AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS request_id, l_orderkey AS review_id, ['retain', 'export', 'delete'][l_suppkey % 3 + 1] AS action, ['public_metadata', 'confidential', 'restricted_full_text'][l_orderkey % 3 + 1] AS classification,
    CASE WHEN l_linenumber < 6 THEN CAST(l_quantity AS INT) END AS retention_days, l_partkey % 4 = 0 AS includes_audit_log, l_returnflag = 'A' AS legal_hold, CASE WHEN l_linestatus = 'F' THEN 'apply' ELSE 'preview' END AS execution_mode,
    sha256(CAST(l_orderkey AS VARCHAR)) AS digest, CASE WHEN l_linenumber <> 1 THEN 'a-' || l_orderkey END AS approval_id, l_orderkey - CAST(l_partkey % 5 = 0 AS INT) AS approval_review, ['retain', 'export', 'delete'][(l_suppkey + CAST(l_partkey % 7 = 0 AS INT)) % 3 + 1] AS approval_action,
    sha256(CAST(l_orderkey - CAST(l_partkey % 11 = 0 AS INT) AS VARCHAR)) AS approval_digest, 'p' || (1 + CAST(l_partkey % 13 = 0 AS INT)) AS approval_policy, l_shipdate AS used_on FROM lineitem),
registry AS (SELECT 'a-' || o_orderkey AS approval_id, o_orderkey AS review, sha256(CAST(o_orderkey AS VARCHAR)) AS held_digest, o_orderdate AS approved_at, o_orderdate + INTERVAL 60 DAY AS expires_at FROM orders),
verified AS (SELECT c.*, coalesce(approval_review = review AND approval_digest = held_digest AND used_on >= approved_at AND used_on < expires_at, false) AS verified FROM claims c LEFT JOIN registry USING (approval_id)),
coded AS (SELECT request_id, execution_mode = 'apply' AS receipt_required, array_to_string(list_filter([
    CASE WHEN classification NOT IN ('public_metadata', 'confidential') THEN 'lifecycle.classification.denied' END, CASE WHEN action = 'retain' AND coalesce(retention_days, 0) > 40 THEN 'lifecycle.retention.exceeds_policy' END,
    CASE WHEN action = 'delete' AND includes_audit_log THEN 'lifecycle.delete.immutable_audit_denied' END, CASE WHEN action = 'delete' AND legal_hold THEN 'lifecycle.delete.legal_hold' END,
    CASE WHEN execution_mode = 'apply' AND approval_id IS NULL THEN 'lifecycle.apply.approval_required' END, CASE WHEN execution_mode = 'apply' AND approval_id IS NOT NULL AND approval_review <> review_id THEN 'lifecycle.apply.approval_review_mismatch' END,
    CASE WHEN execution_mode = 'apply' AND approval_id IS NOT NULL AND approval_action <> action THEN 'lifecycle.apply.approval_action_mismatch' END, CASE WHEN execution_mode = 'apply' AND approval_id IS NOT NULL AND approval_digest <> digest THEN 'lifecycle.apply.approval_digest_mismatch' END,
    CASE WHEN execution_mode = 'apply' AND approval_id IS NOT NULL AND approval_policy <> 'p1' THEN 'lifecycle.apply.approval_policy_mismatch' END, CASE WHEN execution_mode = 'apply' AND approval_id IS NOT NULL AND NOT verified THEN 'lifecycle.apply.approval_verification_failed' END
    ], lambda x: x IS NOT NULL), ',') AS blockers, array_to_string(list_filter([CASE WHEN execution_mode <> 'apply' THEN 'lifecycle.preview.no_effects' END, CASE WHEN action = 'export' THEN 'lifecycle.export.destination_review_required' END,
    CASE WHEN action = 'delete' THEN 'lifecycle.delete.tombstones_required' END], lambda x: x IS NOT NULL), ',') AS warnings FROM verified)"""


def _claims(spark, sf_dir) -> DataFrame:
    order = "CAST(l_orderkey AS STRING)"
    claims = D.table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS request_id", "l_orderkey AS review_id", "array('retain', 'export', 'delete')[CAST(l_suppkey % 3 AS INT)] AS action",
        "array('public_metadata', 'confidential', 'restricted_full_text')[CAST(l_orderkey % 3 AS INT)] AS classification", "CASE WHEN l_linenumber < 6 THEN CAST(round(l_quantity) AS INT) END AS retention_days", "l_partkey % 4 = 0 AS includes_audit_log",
        "l_returnflag = 'A' AS legal_hold", "CASE WHEN l_linestatus = 'F' THEN 'apply' ELSE 'preview' END AS execution_mode", f"sha2({order}, 256) AS digest", "CASE WHEN l_linenumber != 1 THEN concat('a-', l_orderkey) END AS approval_id",
        "l_orderkey - CAST(l_partkey % 5 = 0 AS INT) AS approval_review", "array('retain', 'export', 'delete')[CAST((l_suppkey + CAST(l_partkey % 7 = 0 AS INT)) % 3 AS INT)] AS approval_action",
        "sha2(CAST(l_orderkey - CAST(l_partkey % 11 = 0 AS INT) AS STRING), 256) AS approval_digest", "concat('p', 1 + CAST(l_partkey % 13 = 0 AS INT)) AS approval_policy", "l_shipdate AS used_on",
    )
    registry = D.table(spark, sf_dir, "orders").selectExpr("concat('a-', o_orderkey) AS approval_id", "o_orderkey AS approval_review", "sha2(CAST(o_orderkey AS STRING), 256) AS approval_digest", "o_orderdate AS approved_at", "o_orderdate + INTERVAL 60 DAY AS expires_at")
    return policy.verify_approvals(claims, registry, ["approval_review", "approval_digest"], "used_on")


@query("SELECT request_id, verified FROM verified", CLAIMS)
def approval_verify(spark, sf_dir):
    return _claims(spark, sf_dir).select("request_id", "verified")


@query("SELECT request_id, blockers = '' AS permitted, blockers = '' AND receipt_required AS effects_authorized, blockers, warnings, receipt_required FROM coded", CLAIMS)
def lifecycle_evaluate(spark, sf_dir):
    return policy.evaluate_lifecycle(_claims(spark, sf_dir), LIFECYCLE)


@query("SELECT event_id FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0")
def benchmark_leak(spark, sf_dir):
    """All events; some payloads are wrapped in an object with a forbidden key, others name one in a text only."""
    i, p = F.col("event_id"), F.col("props")
    wrapped = F.when(i % 97 == 0, F.to_json(F.struct(F.struct(p.alias("gold")).alias("a")))).when(i % 89 == 0, F.to_json(F.struct(F.array(F.struct(p.alias("expected_labels"))).alias("a")))).when(i % 83 == 0, F.to_json(F.struct(F.lit('"gold": 1').alias("note")))).otherwise(p)
    named = ("label", "labels", "gold", "gold_clusters", "gold_studies", "expected_labels", "outcomes")
    return policy.leaked_keys(D.table(spark, sf_dir, "events").select("event_id", F.coalesce(wrapped, F.lit("{}")).alias("payload")), "event_id", "payload", named)


@query(
    """SELECT receipt_id, CASE WHEN stated IS NULL THEN 'unresolved_receipt' ELSE 'count_mismatch' END AS problem, coalesce(n, 0) AS records FROM (SELECT l_suppkey + l_linenumber // 7 * 1000000 AS receipt_id, count(*) AS n FROM lineitem GROUP BY ALL)
    FULL JOIN (SELECT s_suppkey AS receipt_id, count(*) - CAST(s_suppkey % 4 = 0 AS INT) AS stated FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_linenumber < 7 GROUP BY s_suppkey) USING (receipt_id) WHERE stated IS NULL OR stated <> coalesce(n, 0)""")  # fmt: skip
def receipt_integrity(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem")
    receipts = lines.where("l_linenumber < 7").join(D.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_suppkey").alias("receipt_id")).agg((F.count("*") - F.when(F.col("s_suppkey") % 4 == 0, 1).otherwise(0)).alias("stated"))
    return study.receipt_integrity(lines.selectExpr("concat_ws('-', l_orderkey, l_linenumber) AS record_id", "l_suppkey + l_linenumber div 7 * 1000000 AS receipt_id"), receipts)


@query("SELECT subject_id, round, reviewer_id, count(*) AS rows FROM decisions GROUP BY ALL HAVING count(*) > 1", D.DECISIONS)
def set_distinct_required(spark, sf_dir):
    return study.repeated_keys(D.decisions(spark, sf_dir), "subject_id", "round", "reviewer_id")


@query(
    """SELECT l_orderkey, start_byte, end_byte FROM (SELECT *, lag(end_byte) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM (
    SELECT *, l_linenumber * 10 + l_partkey % 12 AS start_byte, l_linenumber * 10 + l_partkey % 12 + l_suppkey % 12 - 1 AS end_byte FROM lineitem)) WHERE start_byte < p OR end_byte < start_byte""")  # fmt: skip
def span_monotonic(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem").withColumns({"place": F.struct("l_linenumber", "l_partkey", "l_suppkey"), "start_byte": F.col("l_linenumber") * 10 + F.col("l_partkey") % 12})
    lines = lines.withColumn("end_byte", F.col("start_byte") + F.col("l_suppkey") % 12 - 1)
    return study.broken_spans(lines, "l_orderkey", "place", "start_byte", "end_byte").select("l_orderkey", "start_byte", "end_byte")


LINES = """lines AS (SELECT p_partkey, ['pubmed', 'ovid_medline', 'psycinfo_ovid', 'embase', 'cinahl_ebsco', 'scopus', 'web_of_science', 'generic_boolean', 'crossref'][p_partkey % 9 + 1] AS dialect,
    replace('{p}[Title/Abstract]|exp {p}/|{p}.ti,ab.|''{p}''/exp|{p}:ti,kw|(MH "{p}")|TITLE-ABS-KEY({p})|TS=({p})|{p}.ti,zz.|  ', '{p}', p_name) AS forms, p_partkey // 9 % 10 AS form FROM part),
l AS (SELECT p_partkey, dialect, string_split(forms, '|')[form + 1] AS body, form FROM lines)"""


@query(
    """SELECT p_partkey, 'native.' || dialect || '.unsupported_syntax' AS code FROM l WHERE NOT CASE dialect WHEN 'pubmed' THEN form = 0 WHEN 'ovid_medline' THEN form IN (1, 2) WHEN 'psycinfo_ovid' THEN form IN (1, 2) WHEN 'embase' THEN form IN (3, 4)
    WHEN 'cinahl_ebsco' THEN form = 5 WHEN 'scopus' THEN form = 6 WHEN 'web_of_science' THEN form = 7 WHEN 'generic_boolean' THEN form <> 9 ELSE false END""", LINES)  # fmt: skip
def native_diagnostics(spark, sf_dir):
    """Every part's name in one of ten line forms, under one of nine dialects."""
    from .plans.search import native_diagnostics as diagnose

    k, name = F.col("p_partkey"), "p_name"
    wrap = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    forms = F.array(wrap("", "[Title/Abstract]"), wrap("exp ", "/"), wrap("", ".ti,ab."), wrap("'", "'/exp"), wrap("", ":ti,kw"), wrap('(MH "', '")'), wrap("TITLE-ABS-KEY(", ")"), wrap("TS=(", ")"), wrap("", ".ti,zz."), F.lit("  "))
    dialect = _pick(["pubmed", "ovid_medline", "psycinfo_ovid", "embase", "cinahl_ebsco", "scopus", "web_of_science", "generic_boolean", "crossref"], k % 9)
    lines = D.table(spark, sf_dir, "part").select("p_partkey", dialect.alias("dialect"), F.element_at(forms, (F.floor(k / 9) % 10 + 1).cast("int")).alias("body"))
    return diagnose(lines, "dialect", "body").select("p_partkey", "code")


# --- requests, study graphs, limits, authority and provenance
_enc = lambda x: f"replace(replace(replace(url_encode(CAST({x} AS VARCHAR)), '%20', '+'), '~', '%7E'), '%2A', '*')"
_opt = lambda name, x: f"coalesce('&{name}=' || {_enc(x)}, '')"
ASKED = "asked AS (SELECT p_partkey, p_name || ' & \"' || p_type || '\" ~' AS q, p_size AS n, CASE WHEN p_partkey % 3 = 0 THEN 'AoJ/' || p_partkey || '*=' END AS c, CASE WHEN p_partkey % 2 = 0 THEN 'a+b@example.org' END AS m FROM part)"


@query(
    f"""SELECT p_partkey, unnest(['europe-pmc', 'pubmed', 'pubmed-summary', 'crossref', 'openalex', 'clinicaltrials-gov']) AS service, unnest([
    'https://www.ebi.ac.uk/europepmc/webservices/rest/search?query=' || {_enc('q')} || '&format=json&resultType=core&pageSize=' || n || {_opt('cursorMark', 'c')},
    'https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&retmode=json&term=' || {_enc('q')} || '&retmax=' || n || '&retstart=' || p_partkey || '&tool=t' || {_opt('email', 'm')},
    'https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esummary.fcgi?db=pubmed&retmode=json&id=' || p_partkey || '%2C' || n || '&tool=t' || {_opt('email', 'm')},
    'https://api.crossref.org/works?query.bibliographic=' || {_enc('q')} || '&rows=' || n || {_opt('cursor', 'c')} || {_opt('mailto', 'm')},
    'https://api.openalex.org/works?search=' || {_enc('q')} || '&per-page=' || n || '&cursor=' || coalesce({_enc('c')}, '*') || {_opt('mailto', 'm')},
    'https://clinicaltrials.gov/api/v2/studies?query.term=' || {_enc('q')} || '&pageSize=' || n || '&format=json' || {_opt('pageToken', 'c')}]) AS url FROM asked""", ASKED)  # fmt: skip
def src_endpoint_urls(spark, sf_dir):
    from .sources.endpoints import SERVICES, endpoint

    k = F.col("p_partkey")
    given = {
        "query": F.concat("p_name", F.lit(' & "'), "p_type", F.lit('" ~')), "size": F.col("p_size"), "offset": k, "ids": F.concat_ws(",", k, "p_size"), "tool": F.lit("t"),
        "cursor": F.when(k % 3 == 0, F.concat(F.lit("AoJ/"), k, F.lit("*="))), "email": F.when(k % 2 == 0, "a+b@example.org"),
    }
    urls = F.array(*(F.struct(F.lit(s).alias("service"), endpoint(s, **given).alias("url")) for s in SERVICES))
    return D.table(spark, sf_dir, "part").select("p_partkey", F.explode(urls).alias("u")).select("p_partkey", "u.service", "u.url")


GRAPH = """reports AS (SELECT 'r-' || CASE WHEN o_orderkey % 50 = 49 THEN o_orderkey - 1 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE o_orderpriority END AS title, o_custkey % 20 AS records FROM orders),
studies AS (SELECT CASE WHEN c_custkey % 40 = 0 THEN 'r-' ELSE 's-' END || c_custkey AS id, c_name AS label, CASE WHEN c_custkey % 13 = 0 THEN [] ELSE list_filter(['r-' || c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'r-' || c_custkey END, CASE WHEN c_custkey % 11 = 0 THEN 'r-x' END], lambda x: x IS NOT NULL) END AS ids FROM customer),
links AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS id, l_orderkey AS a, CASE WHEN l_partkey % 9 = 0 THEN l_orderkey ELSE l_suppkey END AS b, l_discount * 11 AS confidence, l_partkey % 6 AS evidence FROM lineitem)"""


@query(
    """SELECT 'report' AS object, id, 'empty_title' AS code FROM reports WHERE title = ' ' UNION SELECT 'report', id, 'no_records' FROM reports WHERE records = 0 UNION SELECT 'study', id, 'no_reports' FROM studies WHERE len(ids) = 0
    UNION SELECT 'study', id, 'duplicate_report' FROM studies WHERE len(list_distinct(ids)) < len(ids) UNION SELECT 'study', id, 'unknown_report' FROM (SELECT id, unnest(ids) AS r FROM studies) WHERE r NOT IN (SELECT id FROM reports)
    UNION SELECT 'link', id, 'self_reference' FROM links WHERE a = b UNION SELECT 'link', id, 'confidence_range' FROM links WHERE confidence < 0 OR confidence > 1 UNION SELECT 'link', id, 'no_evidence' FROM links WHERE evidence = 0
    UNION SELECT 'link', id, 'duplicate_identifier' FROM links GROUP BY id HAVING count(*) > 1 UNION SELECT max(o), id, 'duplicate_identifier' FROM (SELECT 'report' AS o, id FROM reports UNION ALL SELECT 'study', id FROM studies) GROUP BY id HAVING count(*) > 1""", GRAPH)  # fmt: skip
def val_study_graph(spark, sf_dir):
    text = "CAST({} AS STRING)".format
    reports = D.table(spark, sf_dir, "orders").selectExpr("concat('r-', CASE WHEN o_orderkey % 50 = 49 THEN o_orderkey - 1 ELSE o_orderkey END) AS report_id", "CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE o_orderpriority END AS title", "o_custkey % 20 AS records")
    ids = "filter(array(concat('r-', c_custkey), CASE WHEN c_custkey % 7 = 0 THEN concat('r-', c_custkey) END, CASE WHEN c_custkey % 11 = 0 THEN 'r-x' END), x -> x IS NOT NULL)"
    studies = D.table(spark, sf_dir, "customer").selectExpr("concat(CASE WHEN c_custkey % 40 = 0 THEN 'r-' ELSE 's-' END, c_custkey) AS study_id", "c_name AS label", f"CASE WHEN c_custkey % 13 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE {ids} END AS report_ids")
    links = D.table(spark, sf_dir, "lineitem").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS link_id", f"{text('l_orderkey')} AS from_id", f"{text('CASE WHEN l_partkey % 9 = 0 THEN l_orderkey ELSE l_suppkey END')} AS to_id", "l_discount * 11 AS confidence", "l_partkey % 6 AS evidence")
    return study.graph_violations(reports, studies, links)


@query(
    """SELECT p_partkey AS strategy_id, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 AND p_size % 5 = 0 AND p_size % 4 = 0 THEN 'date.unbounded' END, CASE WHEN p_partkey % 3 = 0 AND p_size % 5 <> 0 AND p_size % 4 <> 0 AND p_size > 25 THEN 'date.crossed' END,
    CASE WHEN p_partkey % 10 = 0 THEN 'limits.empty_value' END, CASE WHEN (p_partkey % 3 = 0 OR p_partkey % 10 = 0 OR p_partkey % 4 = 1 OR p_partkey % 7 = 1) AND p_partkey % 6 > 2 THEN 'limits.no_rationale' END], lambda x: x IS NOT NULL), ',') AS codes FROM part""")  # fmt: skip
def val_strategy(spark, sf_dir):
    none = "CAST(array() AS ARRAY<STRING>)"
    return policy.strategy_violations(D.table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS strategy_id", "p_partkey % 3 = 0 AS dated", "CASE WHEN p_size % 5 != 0 THEN 1980 + p_size END AS from_year", "CASE WHEN p_size % 4 != 0 THEN 2030 - p_size END AS to_year", f"CASE WHEN p_partkey % 10 = 0 THEN array('en', ' ') ELSE {none} END AS languages",
        "CASE WHEN p_partkey % 4 = 1 THEN array('review') END AS publication_types", f"CASE WHEN p_partkey % 7 = 1 THEN array('rct') ELSE {none} END AS filters", f"CASE WHEN p_partkey % 6 > 2 THEN {none} ELSE array('scope') END AS rationale",
    ))


@query(
    """SELECT event_id AS request_id, reason IN ('non_canonical_draft', 'network_free_replay', 'explicit_approval_verified') AS allowed, reason FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'non_canonical_draft' WHEN 1 THEN 'network_free_replay'
    ELSE CASE WHEN event_id % 7 IN (2, 3) AND user_id % 3 <> 0 THEN 'human_authority_required' WHEN user_id % 5 < 3 THEN 'explicit_approval_verified' ELSE 'explicit_approval_required' END END AS reason FROM events)""")  # fmt: skip
def agent_operation(spark, sf_dir):
    kinds = ["draft", "fixture_replay", "final_exclusion", "protocol_amendment", "live_execution", "apply_deduplication", "registry_publication"]
    u = F.col("user_id")
    receipt = F.when(u % 5 == 3, " ").when(u % 5 < 3, F.concat(F.lit("rc-"), u))
    return policy.authorise_operation(D.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), _pick(kinds, F.col("event_id") % 7).alias("operation"), _pick(["human", "agent", "service"], u % 3).alias("principal"), receipt.alias("receipt_id")))


@query("SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS assessment_id, l_suppkey % 6 <= l_partkey % 4 AND l_returnflag = 'A' AS acceptable FROM lineitem")
def translation_acceptable(spark, sf_dir):
    good = policy.translation_acceptable(F.col("l_suppkey") % 6, F.col("l_partkey") % 4, F.col("l_returnflag") == "A")
    return D.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("assessment_id"), good.alias("acceptable"))


@query(
    """SELECT o_custkey AS review_id, 'entity' AS section, 'sr:receipt-' || o_orderkey AS id, '{"prov:type":"sr:SourceReceipt","sr:provider":"' || o_orderpriority || '","sr:recordsRetrieved":' || o_orderkey % 100 || ',"prov:generatedAtTime":"' || strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') || '"}' AS body FROM orders
    UNION ALL SELECT review_id, 'activity', 'sr:event-' || event_id, '{"prov:type":"' || event_type || '","prov:startedAtTime":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') || '"}' FROM audit_events
    UNION ALL SELECT review_id, 'agent', 'sr:actor-' || actor_id, '{"prov:type":"' || max_by(actor_kind, seq) || '"}' FROM audit_events GROUP BY review_id, actor_id
    UNION ALL SELECT review_id, 'wasAssociatedWith', 'sr:association-' || event_id, '{"prov:activity":"sr:event-' || event_id || '","prov:agent":"sr:actor-' || actor_id || '"}' FROM audit_events
    UNION ALL SELECT review_id, 'wasDerivedFrom', 'sr:derivation-' || event_id, '{"prov:generatedEntity":"sr:event-' || event_id || '","prov:usedEntity":"sr:event-' || before || '"}' FROM (
        SELECT *, lag(event_id) OVER (PARTITION BY review_id ORDER BY seq) AS before FROM audit_events) WHERE before IS NOT NULL""", D.AUDIT_EVENTS)  # fmt: skip
def snk_prov(spark, sf_dir):
    receipts = D.table(spark, sf_dir, "orders").selectExpr("o_custkey AS review_id", "o_orderkey AS receipt_id", "o_orderpriority AS provider_id", "o_orderkey % 100 AS records", "o_orderdate AS executed_at")
    events = D.audit_events(spark, sf_dir)
    return audit.prov(receipts, events, audit.append_hashes(events))


# --- licensed requests, validation reports and workflow traces
@query(
    """SELECT request_id, refused, CASE WHEN refused IS NULL THEN array_to_string(b, ',') END AS blockers, refused IS NULL AND len(b) = 0 AS ready FROM (SELECT o_orderkey AS request_id,
    CASE WHEN o_orderkey % 11 = 0 THEN 'malformed_endpoint' WHEN o_orderkey % 7 = 0 THEN 'insecure_endpoint' WHEN o_orderkey % 13 = 0 THEN 'missing_host' WHEN o_custkey % 5 = 4 THEN 'host_not_allowed' WHEN o_orderstatus = 'P' THEN 'dialect_mismatch' END AS refused,
    list_filter([CASE WHEN o_custkey % 3 = 0 THEN 'credential_absent' END, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 'live_opt_in_disabled' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'translation_review_required' END], lambda x: x IS NOT NULL) AS b FROM orders)""")  # fmt: skip
def licensed_plan(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    scheme = F.when(k % 11 == 0, "api").when(k % 7 == 0, "http://").otherwise("HTTPS://")
    host = F.when((k % 13 == 0) & (k % 11 != 0), "").otherwise(F.concat(F.when(c % 2 == 0, "user@").otherwise(""), F.lit("Api"), c % 5, F.lit(".example.org"), F.when(c % 3 == 0, ":443").otherwise("")))
    asked = D.table(spark, sf_dir, "orders").select(
        k.alias("request_id"), F.concat(scheme, host, F.lit("/search?q="), k).alias("endpoint"), F.array(*(F.lit(f"api{i}.example.org") for i in range(4))).alias("allowed_hosts"), F.lit("embase").alias("dialect"),
        F.when(F.col("o_orderstatus") == "P", "scopus").otherwise("embase").alias("strategy_dialect"), (c % 3 != 0).alias("credential_present"), F.when(k % 4 == 0, "0").when(k % 4 == 1, "yes").when(k % 4 == 2, "TRUE").alias("opt_in"), F.col("o_orderpriority").startswith("1").alias("review_required"),
    )
    return policy.licensed_plan(asked)


@query(
    """SELECT o_orderkey AS report_id, array_to_string(list_filter([CASE WHEN o_orderkey % 17 = 0 THEN 'strategy_id.blank' END, CASE WHEN o_custkey % 8 IN (6, 7) THEN 'minimum_recall.range' END, CASE WHEN pb THEN 'press.blank' END, CASE WHEN po THEN 'press.other_strategy' END,
    CASE WHEN sb THEN 'seed.blank' END, CASE WHEN tb THEN 'translation.blank' END, CASE WHEN t THEN 'translation.other_strategy' END, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 THEN 'approved.without_approver' END], lambda x: x IS NOT NULL), ',') AS codes
    FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'A' AND (l_partkey % 10 = 0 OR l_suppkey % 9 = 0)) AS pb, bool_or(l_returnflag = 'A' AND (l_partkey % 12 = 0 OR l_orderkey % 17 = 0)) AS po, bool_or(l_returnflag = 'N' AND l_partkey % 14 = 0) AS sb,
        bool_or(l_returnflag = 'R' AND l_partkey % 15 = 0) AS tb, bool_or(l_returnflag = 'R' AND (l_suppkey % 8 = 0 OR l_orderkey % 17 = 0)) AS t FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")  # fmt: skip
def val_search_validation(spark, sf_dir):
    """A report per order: its lines are peer reviews, seeds and translations."""
    p, key = F.col("l_partkey"), F.concat(F.lit("st-"), "l_orderkey")
    strategy = lambda wrong: F.when(wrong, "st-other").otherwise(key).alias("strategy_id")
    press = F.struct(strategy(p % 12 == 0), F.when(p % 10 != 0, "approve").alias("decision"), F.array(F.lit("add synonyms"), F.when(F.col("l_suppkey") % 9 == 0, " ").otherwise("check fields")).alias("findings"))
    seed = F.struct(F.concat(F.lit("seed-"), p).alias("seed_id"), F.when(p % 14 == 0, "  ").otherwise("known item").alias("basis"))
    translation = F.struct(strategy(F.col("l_suppkey") % 8 == 0), F.when(p % 15 != 0, "scopus").alias("dialect"))
    each = lambda flag, row, name: F.collect_list(F.when(F.col("l_returnflag") == flag, row)).alias(name)
    parts = D.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(each("A", press, "press"), each("N", seed, "seeds"), each("R", translation, "translations"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reports = D.table(spark, sf_dir, "orders").join(parts, F.col("l_orderkey") == k, "left").select(
        k.alias("report_id"), F.when(k % 17 != 0, F.concat(F.lit("st-"), k)).alias("strategy_id"), F.when(c % 8 == 7, F.lit(float("nan"))).otherwise((c % 8) / 5).alias("minimum_recall"), "press", "seeds", "translations",
        (F.col("o_orderstatus") == "F").alias("approved"), F.when(c % 3 == 0, "editor").when(c % 3 == 1, " ").alias("approver"),
    )
    return policy.search_validation_violations(reports)


TRACE = "trace AS (SELECT l_orderkey AS review_id, CASE WHEN l_partkey % 40 = 0 THEN ' ' ELSE 't-' || l_partkey % 25 END AS transition_id, l_suppkey, l_partkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"


@query(
    """SELECT DISTINCT review_id, transition_id, code FROM (SELECT review_id, transition_id, 'transition_id.blank' AS code FROM trace WHERE transition_id = ' ' UNION ALL SELECT review_id, transition_id, 'actor.blank' FROM trace WHERE l_suppkey % 9 = 0
    UNION ALL SELECT review_id, transition_id, 'occurred_at.blank' FROM trace WHERE l_linenumber = 7 UNION ALL SELECT review_id, transition_id, 'state.unchanged' FROM trace WHERE (l_returnflag, l_linestatus) IN (('N', 'O'), ('A', 'F'))
    UNION ALL SELECT review_id, transition_id, 'evidence.none' FROM trace WHERE l_partkey % 6 IN (0, 1) UNION ALL SELECT review_id, transition_id, 'evidence.blank' FROM trace WHERE l_partkey % 6 = 2
    UNION ALL SELECT review_id, transition_id, 'transition_id.duplicate' FROM trace GROUP BY ALL HAVING count(*) > 1)""", TRACE)  # fmt: skip
def val_workflow_trace(spark, sf_dir):
    p = F.col("l_partkey")
    evidence = F.when(p % 6 == 0, F.array().cast("array<string>")).when(p % 6 == 2, F.array(F.lit("e-1"), F.lit(" "))).when(p % 6 != 1, F.array(F.concat(F.lit("e-"), p)))
    after = F.when(F.col("l_returnflag") == "N", "O").when(F.col("l_returnflag") == "A", "F").otherwise("closed")
    return policy.trace_violations(D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("review_id"), F.when(p % 40 == 0, " ").otherwise(F.concat(F.lit("t-"), p % 25)).alias("transition_id"), F.when(F.col("l_suppkey") % 9 == 0, "").otherwise("actor").alias("actor_id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("occurred_at"), F.col("l_linestatus").alias("before"), after.alias("after"), evidence.alias("evidence_ids"),
    ))


# --- registered events
JUDGED = """judged AS MATERIALIZED (
    SELECT *, CASE WHEN EXISTS (SELECT 1 FROM json_tree(payload) WHERE lower(key) IN ('credential', 'password', 'secret', 'token', 'full_text')) THEN 'prohibited_key' WHEN event_type = 'made_up' THEN 'unregistered_type'
        WHEN len(list_filter(json_keys(payload), lambda k: k NOT IN ('_schema_version', 'amendment_id', 'contract_version', 'plan_id', 'status', 'decision', 'final_authority', 'record_id', 'reviewer_id', 'stage', 'provider', 'record_count', 'run_id', 'source_id'))) > 0 THEN 'unregistered_key'
        WHEN CAST(payload ->> '$._schema_version' AS INT) NOT IN (0, 1) THEN 'unsupported_version' END AS code
    FROM registered)"""


@query(
    """SELECT event_id, code, sha256('{' || (SELECT string_agg(to_json(k)::VARCHAR || ':' || (payload -> ('$."' || k || '"'))::VARCHAR, ',' ORDER BY k) FROM (SELECT unnest(json_keys(payload)) AS k)) || '}') AS payload_digest,
    CASE WHEN code IS NULL THEN coalesce(payload ->> '$.source_id', payload ->> '$.provider') END AS source_id FROM judged""", D.REGISTERED_EVENTS, JUDGED)  # fmt: skip
def payload_registered(spark, sf_dir):
    got = events.ingested(D.registered_events(spark, sf_dir))
    return got.select("event_id", "code", events.canonical_digest(F.col("payload")).alias("payload_digest"), F.try_element_at("fields", F.lit("source_id")).alias("source_id"))


@query(
    """SELECT review_id, 'state' AS section, '' AS key, CASE WHEN wrong IS NULL THEN '{"status":"' || status || '","plan_validated":' || plan_validated || ',"source_event_count":' || n || ',"source_head_hash":"' || head || '","last_event_id":"' || last || '","advisory_recommendation_count":' || advisory || '}'
    ELSE '{"error":"' || wrong || '"}' END AS body FROM state
UNION ALL SELECT review_id, 'search_run', p ->> '$.run_id', '{"run_id":"' || (p ->> '$.run_id') || '","source_id":"' || coalesce(p ->> '$.source_id', p ->> '$.provider') || '","record_count":' || (p ->> '$.record_count') || ',"event_id":"' || event_id || '"}'
    FROM (SELECT *, payload AS p FROM good WHERE event_type = 'search_run_completed' QUALIFY row_number() OVER (PARTITION BY review_id, payload ->> '$.run_id' ORDER BY seq DESC) = 1)
UNION ALL SELECT DISTINCT review_id, 'amendment', payload ->> '$.amendment_id', '{}' FROM good WHERE event_type = 'protocol_amended'
UNION ALL SELECT review_id, 'final_decision', payload ->> '$.record_id', '{"record_id":"' || (payload ->> '$.record_id') || '","stage":"full_text","decision":"' || (payload ->> '$.decision') || '","reviewer_id":"' || actor_id || '","event_id":"' || event_id || '"}' FROM final
UNION ALL SELECT review_id, 'rejected_final_authority', event_id, '{}' FROM good WHERE event_type = 'screening_decision_recorded' AND payload ->> '$.final_authority' = 'true' AND actor_type <> 'human'
UNION ALL SELECT review_id, 'final_decision_count', payload ->> '$.decision', '{"n":' || count(*) || '}' FROM final GROUP BY 1, 2, 3
UNION ALL SELECT review_id, 'event_type_count', event_type, '{"n":' || count(*) || '}' FROM good GROUP BY 1, 2, 3""",
    D.REGISTERED_EVENTS, JUDGED,
    """linked AS (SELECT *, CASE WHEN previous_hash <> coalesce(lag(event_hash) OVER (PARTITION BY review_id ORDER BY seq), 'GENESIS') THEN 'not_after_preceding_event' END AS link FROM judged)""",
    """decides AS (SELECT *, event_type = 'screening_decision_recorded' AND payload ->> '$.final_authority' = 'true' AND actor_type = 'human' AS final FROM linked)""",
    """said AS (SELECT *, CASE WHEN code IS NOT NULL THEN NULL WHEN final THEN 'screening' WHEN event_type = 'review_plan_validated' THEN 'planned' WHEN event_type = 'search_run_completed' THEN 'searching' WHEN event_type = 'review_status_changed' THEN payload ->> '$.status' END AS status FROM decides)""",
    """state AS (SELECT review_id, coalesce(arg_max(status, seq) FILTER (status IS NOT NULL), 'created') AS status, bool_or(event_type = 'review_plan_validated') AS plan_validated, count(*) AS n, arg_max(event_hash, seq) AS head, arg_max(event_id, seq) AS last,
        count(*) FILTER (event_type = 'screening_decision_recorded' AND payload ->> '$.final_authority' = 'false') AS advisory,
        coalesce(arg_min(link || ':' || event_id, seq) FILTER (link IS NOT NULL), arg_min(code || ':' || event_id, seq) FILTER (code IS NOT NULL)) AS wrong FROM said GROUP BY review_id)""",
    "good AS (SELECT s.* FROM said s JOIN state t ON t.review_id = s.review_id AND t.wrong IS NULL)",
    "final AS (SELECT * FROM good WHERE final QUALIFY row_number() OVER (PARTITION BY review_id, payload ->> '$.record_id' ORDER BY seq DESC) = 1)",
)
def review_state(spark, sf_dir):
    return events.reduce_batch(D.registered_events(spark, sf_dir))


# --- gated requests: each decision depends on those before it, so tests hold this against a loop
@query()
def requests_gated(spark, sf_dir):
    return access.gated(D.requests(spark, sf_dir), 2, 8, 3 * 24 * 3600).select("seq", "denied")


#: One address an order, of a form that its key chooses; the SQL judges the numbers it is made of.
ADDRESSES = """addresses AS (
    SELECT o_orderkey AS k, o_orderkey % 8 AS form, o_custkey % 256 AS a, o_orderkey % 251 AS b FROM orders)"""


@query(
    """SELECT k AS order_id, CASE form WHEN 0 THEN a || '.' || b || '.0.7' WHEN 1 THEN '::ffff:' || a || '.' || b || '.0.7' WHEN 2 THEN 'FC' || printf('%02x', a) || '::' || b WHEN 3 THEN '2001:db8:' || a || '::1' WHEN 4 THEN '2001:4860::' || a || ':' || b
        WHEN 5 THEN 'fe' || printf('%02x', a) || ':0:0:0:0:0:0:1' WHEN 6 THEN '::' || a WHEN 7 THEN '1:2:3:4:5:6:7' END AS ip,
    CASE WHEN form = 7 THEN NULL WHEN form <= 1 THEN a IN (10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0) OR (a = 192 AND b = 168) OR (a = 198 AND b BETWEEN 18 AND 19)
        WHEN form IN (2, 3) THEN true WHEN form = 4 THEN false WHEN form = 5 THEN a BETWEEN 128 AND 191 ELSE a <= 1 END AS prohibited FROM addresses""", ADDRESSES)  # fmt: skip
def ip_prohibited_both(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    a, b = F.col("o_custkey") % 256, F.col("o_orderkey") % 251
    two = F.lower(F.lpad(F.hex(a), 2, "0"))
    v4 = F.concat_ws(".", a, b, F.lit(0), F.lit(7))
    forms = [v4, F.concat(F.lit("::ffff:"), v4), F.concat(F.lit("FC"), two, F.lit("::"), b), F.concat(F.lit("2001:db8:"), a, F.lit("::1")), F.concat(F.lit("2001:4860::"), a, F.lit(":"), b), F.concat(F.lit("fe"), two, F.lit(":0:0:0:0:0:0:1")), F.concat(F.lit("::"), a), F.lit("1:2:3:4:5:6:7")]
    ip = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("order_id"), ip.alias("ip")).withColumn("prohibited", policy.prohibited_address(F.col("ip")))


# --- contracts of search execution, nested
def _runs(spark, sf_dir):
    """One run an order, its receipts the order's lines."""
    from .operators import contracts as C

    li = D.table(spark, sf_dir, "lineitem")
    x, key = F.lit("x"), F.col("l_orderkey").cast("string")
    policy = F.struct(
        F.lit(10).alias("max_records"), (F.col("l_partkey") % 13).alias("max_pages"), F.lit(5).alias("timeout_seconds"), F.when(F.col("l_partkey") % 3 == 0, 4 + F.col("l_linenumber") % 3).alias("total_timeout_seconds"), F.lit(1).alias("max_response_bytes"),
        F.lit(2).alias("retry_base_delay_ms"), (F.col("l_suppkey") % 4 + 1).alias("retry_max_delay_ms"), (F.col("l_linenumber") == 2).alias("cache_write_enabled"), (F.col("l_suppkey") % 2 == 0).alias("replay_enabled"),
    )
    texts = {name: x for name in C.RECEIPT_TEXTS} | {"receipt_id": F.when(F.col("l_partkey") % 17 == 0, " ").otherwise("x"), "review_id": key, "run_id": F.when(F.col("l_partkey") % 19 == 0, "other").otherwise(key)}
    receipt = F.struct(
        F.lit(C.RECEIPT_VERSION).alias("schema_version"), *(v.alias(k) for k, v in texts.items()), (F.col("l_linenumber") % 3).alias("pages_retrieved"), F.col("l_quantity").cast("int").alias("records_retrieved"),
        (F.col("l_partkey") % 5).alias("cache_hits"), (F.col("l_suppkey") % 3).alias("cache_writes"), F.array(F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise("w")).alias("warnings"), policy.alias("policy"),
    )
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    runs = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*order, receipt.alias("r")))).alias("rows"))
    run = F.struct(
        F.lit(C.RUN_VERSION).alias("schema_version"), key.alias("review_id"), key.alias("run_id"), F.when(F.col("l_orderkey") % 23 == 0, "").otherwise("p").alias("purpose"), x.alias("started_at"), F.lit(None).cast("string").alias("completed_at"),
        F.when(F.col("l_orderkey") % 7 == 0, key).alias("supersedes_run_id"), F.col("rows.r").alias("receipts"),
    )
    return runs.select("l_orderkey", run.alias("run"))


@query(
    """SELECT l_orderkey AS run_id, concat_ws(',', CASE WHEN l_orderkey % 23 = 0 THEN 'purpose' END, CASE WHEN l_orderkey % 7 = 0 THEN 'supersedes_itself' END, string_agg(nullif(codes, ''), ',' ORDER BY i)) AS codes FROM (
    SELECT l_orderkey, i, array_to_string(list_transform(list_filter([
        CASE WHEN l_partkey % 17 = 0 THEN 'receipt_id' END, CASE WHEN l_linenumber % 3 = 0 AND l_quantity >= 1 THEN 'records_without_page' END, CASE WHEN l_partkey % 5 + l_suppkey % 3 > 2 * (l_linenumber % 3) THEN 'cache_counters' END, CASE WHEN l_suppkey % 4 = 0 THEN 'blank_warning' END,
        CASE WHEN l_partkey % 13 = 0 THEN 'policy.budget_zero' END, CASE WHEN l_partkey % 3 = 0 AND l_linenumber % 3 = 0 THEN 'policy.total_timeout' END, CASE WHEN l_suppkey % 4 = 0 THEN 'policy.retry_delays' END,
        CASE WHEN l_linenumber = 2 AND l_suppkey % 2 = 1 THEN 'policy.cache_without_replay' END, CASE WHEN l_partkey % 19 = 0 THEN 'foreign' END], lambda c: c IS NOT NULL), lambda c: 'receipts[' || i || '].' || c), ',') AS codes
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem)) GROUP BY l_orderkey""")  # fmt: skip
def val_search_run(spark, sf_dir):
    from .operators import contracts as C

    return _runs(spark, sf_dir).select(F.col("l_orderkey").alias("run_id"), F.array_join(C.run_codes(F.col("run")), ",").alias("codes"))


# --- the reporting ledger
LEDGER_EVIDENCE = """evidence AS (
    SELECT o_custkey AS review_id, unnest(['database_name', 'dates_of_searches', 'total_records']) AS item, 'e' || o_orderkey AS text FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_custkey, ['contacts', 'prior_work', 'updates', 'search_filters', 'peer_review', 'study_registries', 'citation_searching'][CAST(o_orderkey % 7 + 1 AS INT)], ['none', ' Not Applicable ', '  ', 'said', NULL][CAST(o_orderkey % 5 + 1 AS INT)] FROM orders)"""


@query(
    """SELECT review_id, place, i.item, CASE WHEN kind = 'evidence' THEN CASE WHEN n > 0 THEN 'complete' ELSE 'missing' END WHEN said > 0 THEN 'complete' WHEN nothing > 0 THEN 'not_applicable' ELSE 'missing' END AS status, coalesce(n, 0) AS n_evidence
    FROM (SELECT DISTINCT o_custkey AS review_id FROM orders), items i LEFT JOIN (
    SELECT review_id AS r, item, count(text) AS n, count(*) FILTER (trim(text) <> '' AND lower(trim(text)) NOT IN ('none', 'not applicable')) AS said, count(*) FILTER (lower(trim(text)) IN ('none', 'not applicable')) AS nothing FROM evidence GROUP BY ALL) e ON e.r = review_id AND e.item = i.item""",
    LEDGER_EVIDENCE,
    """items(place, item, kind) AS (VALUES (1, 'database_name', 'evidence'), (2, 'multi_database_searching', 'note'), (3, 'study_registries', 'evidence'), (4, 'online_resources_and_browsing', 'note'), (5, 'citation_searching', 'note'), (6, 'contacts', 'note'),
    (7, 'other_methods', 'note'), (8, 'full_search_strategies', 'evidence'), (9, 'limits_and_restrictions', 'note'), (10, 'search_filters', 'note'), (11, 'prior_work', 'note'), (12, 'updates', 'note'), (13, 'dates_of_searches', 'evidence'),
    (14, 'peer_review', 'evidence'), (15, 'total_records', 'evidence'), (16, 'deduplication', 'evidence'))""",
)
def prisma_s_items(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    review = F.col("o_custkey").alias("review_id")
    item = F.element_at(F.array(*map(F.lit, ("contacts", "prior_work", "updates", "search_filters", "peer_review", "study_registries", "citation_searching"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    text = F.element_at(F.array(F.lit("none"), F.lit(" Not Applicable "), F.lit("  "), F.lit("said"), F.lit(None)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    receipts = o.where("o_orderstatus = 'F'").select(review, F.explode(F.array(*map(F.lit, ("database_name", "dates_of_searches", "total_records")))).alias("item"), F.concat(F.lit("e"), "o_orderkey").alias("text"))
    return prisma.ledger(o.select(review).distinct(), receipts.unionByName(o.select(review, item.alias("item"), text.alias("text"))))
