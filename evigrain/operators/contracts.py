"""Contracts of search execution: policies, receipts, runs and provider pages, with what they hold inside.

Each function takes a struct column and gives the codes of the rules that it breaks, those of
what it holds with its place in front: ``receipts[2].policy.budget_zero``. A missing value
breaks a rule that needs one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts that must not be blank.
RECEIPT_TEXTS = ("receipt_id", "review_id", "run_id", "provider_id", "source_label", "strategy_id", "query_hash", "executed_at", "execution_mode", "provider_version", "compiler_version", "result_digest")
RUN_TEXTS = ("review_id", "run_id", "purpose", "started_at")
RECEIPT_VERSION, RUN_VERSION, PAGE_VERSION = "source-receipt.v1", "search-run.v1", "provider-page.v1"


def blank(x: Column) -> Column:
    return ~F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))


def breaches(*rules: tuple[str, Column]) -> Column:
    """The codes of the rules whose breach holds; null counts as no breach."""
    return F.array_compact(F.array(*(F.when(F.coalesce(breach, F.lit(False)), F.lit(code)) for code, breach in rules)))


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)) <= 0


def placed(prefix: Column | str, found: Column) -> Column:
    front = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.transform(found, lambda code: F.concat(front, code))


def policy_codes(p: Column) -> Column:
    """Budgets and timeouts are above zero, those of a whole run at least those of a request; delays and caching go together."""
    total, base, most = p["total_timeout_seconds"], p["retry_base_delay_ms"], p["retry_max_delay_ms"]
    return breaches(
        ("budget_zero", zero(p["max_records"]) | zero(p["max_pages"]) | zero(p["timeout_seconds"])),
        ("total_timeout", total.isNotNull() & ((total <= 0) | (total < p["timeout_seconds"]))),
        ("response_bytes_zero", p["max_response_bytes"].isNotNull() & (p["max_response_bytes"] <= 0)),
        ("retry_delays", base.isNotNull() & most.isNotNull() & ((base <= 0) | (most < base))),
        ("cache_without_replay", F.coalesce(p["cache_write_enabled"], F.lit(False)) & ~F.coalesce(p["replay_enabled"], F.lit(False))),
    )


def receipt_codes(r: Column) -> Column:
    """A receipt names everything it is about; its counts agree with its pages."""
    texts = [(name, blank(r[name])) for name in RECEIPT_TEXTS]
    own = breaches(
        ("schema_version", ~F.coalesce(r["schema_version"] == RECEIPT_VERSION, F.lit(False))), *texts,
        ("records_without_page", (r["pages_retrieved"] == 0) & (r["records_retrieved"] > 0)), ("cache_counters", r["cache_hits"] + r["cache_writes"] > 2 * r["pages_retrieved"]),
        ("blank_warning", F.exists(r["warnings"], blank)),
    )
    return F.concat(own, placed("policy.", policy_codes(r["policy"])))


def run_codes(run: Column) -> Column:
    """A run doesn't supersede itself, and its receipts are its own."""
    parent, receipts = run["supersedes_run_id"], F.coalesce(run["receipts"], F.array())
    own = breaches(
        ("schema_version", ~F.coalesce(run["schema_version"] == RUN_VERSION, F.lit(False))), *((name, blank(run[name])) for name in RUN_TEXTS),
        ("completed_at", run["completed_at"].isNotNull() & blank(run["completed_at"])), ("supersedes_run_id", parent.isNotNull() & blank(parent)), ("supersedes_itself", parent == run["run_id"]),
    )
    foreign = lambda r: breaches(("foreign", ~F.coalesce((r["run_id"] == run["run_id"]) & (r["review_id"] == run["review_id"]), F.lit(False))))
    inside = F.transform(receipts, lambda r, i: placed(F.concat(F.lit("receipts["), i.cast("string"), F.lit("].")), F.concat(receipt_codes(r), foreign(r))))
    return F.concat(own, F.flatten(inside))


def page_codes(page: Column, record_codes) -> Column:
    """A page's records are valid by ``record_codes`` (struct -> codes), its diagnostics are named."""
    own = breaches(("schema_version", ~F.coalesce(page["schema_version"] == PAGE_VERSION, F.lit(False))), ("blank_diagnostic", F.exists(F.coalesce(F.map_keys(page["diagnostics"]), F.array().cast("array<string>")), blank)))
    inside = F.transform(F.coalesce(page["records"], F.array()), lambda r, i: placed(F.concat(F.lit("records["), i.cast("string"), F.lit("].")), record_codes(r)))
    return F.concat(own, F.flatten(inside))
