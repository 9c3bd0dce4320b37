"""Contract validators: rules of one row, and the codes of those it breaks.

A contract is a list of (code, condition) in SQL that holds for a breach; a condition that
is null counts as kept. All rules of a contract become one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import codes

Rules = list[tuple[str, str]]

#: The breaches of each contract, over the columns named in the conditions.
CONTRACTS: dict[str, Rules] = {
    "policy": [("budget.zero", "budget <= 0"), ("total.below_request", "total_budget < budget"), ("cache.without_replay", "cache AND NOT replay"), ("retries.negative", "retries < 0")],
    "page": [("cursor.blank", "trim(cursor_text) = ''"), ("records.exceed_page", "records > page_size"), ("total.below_records", "total_available < records")],
    "receipt": [("counts.inconsistent", "written + rejected != received"), ("hash.format", "NOT {match}(digest, '^[0-9a-f]{64}$')"), ("pages.zero", "pages = 0 AND received > 0")],
    "living_run": [("completed.without_status", "completed AND status != 'completed'"), ("status.without_completion", "NOT completed AND status = 'completed'"), ("parent.self", "parent_id = run_id"), ("changes.unreleased", "changes > 0 AND NOT released")],
    "discovery_run": [("depth.zero", "maximum_depth < 1"), ("records.zero", "maximum_records < 1"), ("edge.self", "source = target"), ("release.required", "NOT human_release")],
    "calibration": [("threshold.range", "threshold < 0 OR threshold > 1"), ("approved.without_approver", "approved AND approver IS NULL"), ("approved.below_minimum", "approved AND sensitivity < minimum"), ("auto_exclusion.allowed", "NOT auto_exclusion_prohibited")],
    "benchmark_report": [("bounds.order", "low > high"), ("value.outside", "value < low OR value > high"), ("sample.empty", "n < 1")],
    "envelope": [("disabled.with_hosts", "NOT network AND hosts > 0"), ("enabled.without_hosts", "network AND hosts = 0"), ("enabled.without_approver", "network AND approver IS NULL")],
    "document_evidence": [("span.order", "start_at >= end_at"), ("span.outside", "end_at > size"), ("confidence.range", "confidence < 0 OR confidence > 1"), ("write.canonical", "canonical_write")],
    "diagnostic": [("code.format", "NOT {match}(code, '^[a-z0-9_]+([.][a-z0-9_]+)*$')"), ("column.without_line", "column_no IS NOT NULL AND line_no IS NULL"), ("line.zero", "line_no < 1"), ("blocking.severity", "blocking != (severity = 'error')")],
    "governance_policy": [("retention.zero", "retention_days < 1"), ("region.format", "NOT {match}(region, '^[A-Z]{2}$')"), ("permitted.with_blockers", "permitted != (blockers = 0)")],
    "lifecycle_request": [("preview.with_approval", "preview AND approval IS NOT NULL"), ("apply.without_approval", "NOT preview AND approval IS NULL"), ("delete.retention", "action = 'delete' AND retention IS NOT NULL"), ("target.missing", "targets = 0")],
    "licensed": [("host.not_bare", "NOT {match}(host, '^[a-z0-9-]+([.][a-z0-9-]+)+$')"), ("raw.persisted", "raw_persisted"), ("env.case", "upper(env) != env")],
    "component": [("digest.format", "NOT {match}(digest, '^[0-9a-f]{64}$')"), ("memory.zero", "memory < 1"), ("hosts.without_network", "hosts > 0 AND NOT network"), ("network.without_hosts", "network AND hosts = 0")],
    "amendment": [("version.unchanged", "new_version = old_version"), ("decided.without_decider", "decided AND decider IS NULL"), ("open.with_decider", "NOT decided AND decider IS NOT NULL")],
    "standard_assessment": [("met.without_evidence", "state IN ('met', 'partial') AND evidence = 0"), ("note.blank", "trim(note) = ''")],
    "named_filter": [("date.order", "effective > expires"), ("rights.redistribution", "NOT redistribution"), ("not_current", "effective > today OR expires < today")],
    "plan": [("blocking.invalid", "sources = 0"), ("warning.single_source", "sources = 1"), ("warning.peer_review_disabled", "NOT peer_review")],
    "parity": [("difference.unapproved", "NOT equivalent AND NOT approved"), ("cutover.early", "cutover AND (blockers > 0 OR NOT equivalent AND NOT approved)")],
    "backup": [("unencrypted", "NOT encrypted"), ("restore.untested", "permitted AND restored_at IS NULL")],
}


def violations(rows: DataFrame, key: str, contract: str) -> DataFrame:
    """(key, codes): the codes of the contract's rules that a row breaks, joined by commas."""
    rules = ((code, F.expr(cond.replace("{match}", "regexp_like"))) for code, cond in CONTRACTS[contract])
    return rows.select(key, F.array_join(codes(*rules), ",").alias("codes"))


def sql(contract: str, key: str, relation: str) -> str:
    """The same in DuckDB's SQL."""
    rules = ", ".join(f"CASE WHEN {cond.replace('{match}', 'regexp_matches')} THEN '{code}' END" for code, cond in CONTRACTS[contract])
    return f"SELECT {key}, array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ',') AS codes FROM {relation}"
