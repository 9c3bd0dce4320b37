"""Nested contracts against plain Python rules."""

import copy

from pyspark.sql import functions as F

from evigrain.operators import contracts as C

POLICY = dict(max_records=10, max_pages=2, timeout_seconds=5, total_timeout_seconds=5, max_response_bytes=1, retry_base_delay_ms=1, retry_max_delay_ms=1, cache_write_enabled=True, replay_enabled=True)
RECEIPT = dict.fromkeys(C.RECEIPT_TEXTS, "x") | dict(schema_version=C.RECEIPT_VERSION, pages_retrieved=1, records_retrieved=5, cache_hits=1, cache_writes=1, warnings=["w"], policy=POLICY)
RUN = dict(schema_version=C.RUN_VERSION, review_id="x", run_id="x", purpose="p", started_at="s", completed_at=None, supersedes_run_id=None, receipts=[RECEIPT, copy.deepcopy(RECEIPT)])
POLICY_DDL = "struct<max_records:long,max_pages:long,timeout_seconds:long,total_timeout_seconds:long,max_response_bytes:long,retry_base_delay_ms:long,retry_max_delay_ms:long,cache_write_enabled:boolean,replay_enabled:boolean>"
RECEIPT_DDL = f"struct<schema_version:string,{','.join(f'{t}:string' for t in C.RECEIPT_TEXTS)},pages_retrieved:long,records_retrieved:long,cache_hits:long,cache_writes:long,warnings:array<string>,policy:{POLICY_DDL}>"
RUN_DDL = f"id int, run struct<schema_version:string,review_id:string,run_id:string,purpose:string,started_at:string,completed_at:string,supersedes_run_id:string,receipts:array<{RECEIPT_DDL}>>"


def changed(*path_and_value):
    *path, value = path_and_value
    run = copy.deepcopy(RUN)
    at = run
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return run


CASES = [
    (RUN, []), (changed("schema_version", "v0"), ["schema_version"]), (changed("purpose", "  "), ["purpose"]), (changed("completed_at", ""), ["completed_at"]), (changed("supersedes_run_id", "x"), ["supersedes_itself"]), (changed("supersedes_run_id", " "), ["supersedes_run_id"]),
    (changed("receipts", None), []), (changed("receipts", 1, "run_id", "y"), ["receipts[1].foreign"]), (changed("receipts", 0, "query_hash", None), ["receipts[0].query_hash"]), (changed("receipts", 0, "pages_retrieved", 0), ["receipts[0].records_without_page", "receipts[0].cache_counters"]),
    (changed("receipts", 1, "cache_hits", 2), ["receipts[1].cache_counters"]), (changed("receipts", 1, "warnings", ["ok", " "]), ["receipts[1].blank_warning"]), (changed("receipts", 1, "policy", "max_pages", 0), ["receipts[1].policy.budget_zero"]),
    (changed("receipts", 1, "policy", "total_timeout_seconds", 4), ["receipts[1].policy.total_timeout"]), (changed("receipts", 1, "policy", "total_timeout_seconds", None), []), (changed("receipts", 0, "policy", "max_response_bytes", 0), ["receipts[0].policy.response_bytes_zero"]),
    (changed("receipts", 0, "policy", "retry_max_delay_ms", 0), ["receipts[0].policy.retry_delays"]), (changed("receipts", 0, "policy", "replay_enabled", False), ["receipts[0].policy.cache_without_replay"]), (changed("receipts", 0, "policy", "timeout_seconds", None), ["receipts[0].policy.budget_zero"]),
]


def test_runs(spark):
    rows = spark.createDataFrame([(i, run) for i, (run, _) in enumerate(CASES)], RUN_DDL)
    got = {r.id: list(r.codes) for r in rows.select("id", C.run_codes(F.col("run")).alias("codes")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_pages(spark):
    pages = [(C.PAGE_VERSION, [("a",), ("",)], {"ok": "1"}), ("v0", None, {" ": "1"}), (C.PAGE_VERSION, [], None)]
    rows = spark.createDataFrame([(p,) for p in pages], "page struct<schema_version:string,records:array<struct<record_id:string>>,diagnostics:map<string,string>>")
    codes = C.page_codes(F.col("page"), lambda r: C.breaches(("record_id", C.blank(r["record_id"]))))
    assert [list(r.c) for r in rows.select(codes.alias("c")).collect()] == [["records[1].record_id"], ["schema_version", "blank_diagnostic"], []]
