"""Registered events: canonical payloads, policy, migrations, and review states in batch and as a stream, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evigrain.operators import events as E

DDL = "review_id string, seq long, schema_version string, event_id string, event_type string, actor_id string, actor_type string, payload string, previous_hash string, event_hash string"


def event(review, seq, kind, payload, actor="human", before=None, event_id=None, actor_id="u1", schema=E.EVENT_SCHEMA, own=None):
    own = own or f"{review}{seq}".encode().hex().rjust(64, "0")[-64:]
    return (review, seq, schema, event_id or f"{review}-e{seq}", kind, actor_id, actor, payload if payload is None or isinstance(payload, str) else json.dumps(payload), before, own)


def chained(rows):
    out, last = [], {}
    for r in rows:
        out.append((*r[:8], r[8] or last.get(r[0], E.GENESIS), r[9]))
        last[r[0]] = r[9]
    return out


def brute(rows, registry=None):
    """(review, section, key, body as a dict) by a loop over each review's events."""
    registry, out = registry or E.Registry(), []
    for review in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == review), key=lambda r: r[1])
        link, ids, last = None, set(), E.GENESIS
        for _, _, schema, i, _, _, _, _, before, own in mine:
            bad = "unsupported_schema_version" if schema != E.EVENT_SCHEMA else "duplicate_event_id" if i in ids else "not_after_preceding_event" if before != last else "non_canonical_hash" if len(own) != 64 or set(own) - set("0123456789abcdef") else None
            link = link or (bad and f"{bad}:{i}")
            ids.add(i)
            last = own
        state = dict(status="created", plan_validated=False, source_event_count=len(mine), source_head_hash=mine[-1][9], last_event_id=mine[-1][3], advisory_recommendation_count=0)
        rest, final, policy = {}, {}, None
        for _, _, _, i, kind, actor_id, actor, payload, _, _ in mine:
            bad, p = check(kind, payload, registry)
            if bad:
                policy = f"{bad}:{i}"
                break
            rest["event_type_count", kind] = {"n": rest.get(("event_type_count", kind), {"n": 0})["n"] + 1}
            if kind == "review_plan_validated":
                state.update(plan_validated=True, status="planned")
            elif kind == "search_run_completed" and "run_id" in p:
                rest["search_run", p["run_id"]] = {k: p[k] for k in ("run_id", "source_id", "record_count") if k in p} | {"event_id": i}
                state["status"] = "searching"
            elif kind == "protocol_amended" and "amendment_id" in p:
                rest["amendment", p["amendment_id"]] = {}
            elif kind == "review_status_changed" and "status" in p:
                state["status"] = p["status"]
            elif kind == "screening_decision_recorded":
                if "record_id" not in p:
                    rest["unknown_event_type", "malformed:screening_decision_recorded"] = {}
                elif p.get("final_authority") is not True:
                    state["advisory_recommendation_count"] += 1
                elif actor != "human":
                    rest["rejected_final_authority", i] = {}
                else:
                    final[p["record_id"]] = {k: p[k] for k in ("record_id", "stage", "decision") if k in p} | {"reviewer_id": p.get("reviewer_id") or actor_id, "event_id": i}
                    state["status"] = "screening"
        if link or policy:
            out.append((review, "state", "", {"error": link or policy}))
            continue
        for d in final.values():
            k = ("final_decision_count", str(d.get("decision")))
            rest[k] = {"n": rest.get(k, {"n": 0})["n"] + 1}
        out += [(review, "state", "", state)] + [(review, *k, v) for k, v in rest.items()] + [(review, "final_decision", k, v) for k, v in final.items()]
    return sorted(out, key=repr)


def keys(x):
    return set(x) | {k for v in x.values() for k in keys(v)} if isinstance(x, dict) else {k for v in x for k in keys(v)} if isinstance(x, list) else set()


def check(kind, payload, registry):
    x = json.loads(payload) if payload else None
    if not isinstance(x, dict):
        return "payload_not_object", None
    if len(json.dumps(x, separators=(",", ":"), ensure_ascii=False).encode()) > 16384:
        return "payload_too_large", None
    if {k.lower() for k in keys(x)} & set(E.PROHIBITED):
        return "prohibited_key", None
    if kind not in registry.types:
        return "unregistered_type", None
    types = registry.types[kind]
    if set(x) - set(types) - {"_schema_version"}:
        return "unregistered_key", None
    version = x.get("_schema_version", 1)
    if type(version) is not int:
        return "version_not_integer", None
    if version not in registry.versions(kind):
        return "unsupported_version", None
    if set(registry.required.get(kind, ())) - set(x):
        return "missing_key", None
    for step in registry.path(kind, version):
        for a, b in step.renames.items():
            if a not in x or b in x:
                return "rename_precondition", None
            x[b] = x.pop(a)
        x |= step.replaces
    for k, v in x.items():
        t = types.get(k, "integer")
        good = type(v) is bool if t == "boolean" else type(v) is int and v >= 0 if t == "integer" else isinstance(v, str) and v.strip() and len(v.encode()) <= 512 and not any(ord(c) < 32 or 127 <= ord(c) < 160 for c in v)
        if not good:
            return "invalid_field", None
    return None, x


def rows_of(df):
    return sorted(((r.review_id, r.section, r.key, json.loads(r.body)) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


FOUR = chained([
    event("demo", 1, "review_plan_validated", {"plan_id": "review-demo"}, actor_id="librarian-1"),
    event("demo", 2, "search_run_completed", {"run_id": "run-1", "source_id": "pubmed", "record_count": 42}, "cli"),
    event("demo", 3, "screening_decision_recorded", {"record_id": "record-1", "stage": "title_abstract", "decision": "exclude", "final_authority": True}, "agent", actor_id="ranker"),
    event("demo", 4, "screening_decision_recorded", {"record_id": "record-1", "stage": "title_abstract", "decision": "include", "final_authority": True}, actor_id="reviewer-1"),
])


def test_four_events(spark):
    got = rows_of(E.reduce_batch(frame(spark, FOUR)))
    assert got == brute(FOUR)
    found = {(s, k): b for _, s, k, b in got}
    assert ("rejected_final_authority", "demo-e3") in found and found["final_decision", "record-1"]["decision"] == "include" and found["final_decision_count", "include"] == {"n": 1}
    assert found["state", ""]["status"] == "screening" and found["state", ""]["plan_validated"] is True
    heads = lambda h: spark.createDataFrame([("demo", h)], "review_id string, verified_head string")
    state = E.reduce_batch(frame(spark, FOUR))
    assert rows_of(E.check_heads(state, heads(FOUR[-1][9]))) == got
    assert rows_of(E.check_heads(state, heads("f" * 64))) == [("demo", "state", "", {"error": "verified_head_mismatch"})]


def test_migration_from_version_0(spark):
    v0 = {"_schema_version": 0, "run_id": "run-migration-fixture-1", "provider": "pubmed", "record_count": 3}
    rows = frame(spark, chained([event("r", 1, "search_run_completed", v0)]))
    got = E.ingested(rows).first()
    assert got.code is None and got.fields == {"_schema_version": "1", "run_id": "run-migration-fixture-1", "source_id": "pubmed", "record_count": "3"}


PAYLOADS = [
    ("protocol_amended", {"amendment_id": "a"}), ("protocol_amended", {"amendment_id": " "}), ("protocol_amended", {"amendment_id": "x\ty"}), ("protocol_amended", {"amendment_id": "é" * 256}), ("protocol_amended", {"amendment_id": "é" * 257}),
    ("protocol_amended", {"amendment_id": 3}), ("protocol_amended", {"amendment_id": None}), ("protocol_amended", {"amendment_id": "a", "other": 1}), ("protocol_amended", {"_schema_version": 1, "amendment_id": "a"}),
    ("protocol_amended", {"_schema_version": 2, "amendment_id": "a"}), ("protocol_amended", {"_schema_version": "1", "amendment_id": "a"}), ("protocol_amended", {"_schema_version": 1.5}), ("protocol_amended", {}), ("protocol_amended", []), ("protocol_amended", "3"), ("protocol_amended", None),
    ("protocol_amended", {"amendment_id": {"a": [1, {"Token": 2}]}}), ("protocol_amended", {"amendment_id": 'password":'}), ("protocol_amended", {"amendment_id": ':"secret"'}), ("protocol_amended", {"pass\"word": 1}), ("protocol_amended", {"amendment_id": ["token", ":"]}),
    ("protocol_amended", {"amendment_id": "x" * 16400}), ("unknown", {"a": 1}), (None, {}), ("search_run_completed", {"_schema_version": 0, "run_id": "r"}), ("search_run_completed", {"_schema_version": 0, "provider": "p", "source_id": "s"}),
    ("search_run_completed", {"record_count": -1}), ("search_run_completed", {"record_count": 2.0}), ("search_run_completed", {"record_count": True}), ("screening_decision_recorded", {"final_authority": "true"}), ("screening_decision_recorded", {"final_authority": False, "record_id": "r"}),
    ("execution_committed", {"commit_id": "c"}), ("execution_committed", {"commit_id": "c", "receipt_id": "r", "record_count": 0, "run_id": "x"}),
]


def test_policy(spark):
    rows = [event("r", i, kind, payload) for i, (kind, payload) in enumerate(PAYLOADS)]
    got = {r.seq: (r.code, r.fields) for r in E.ingested(frame(spark, rows)).collect()}
    for i, r in enumerate(rows):
        code, x = check(r[4], r[7], E.Registry())
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        assert got[i] == (code, None if code else {k: text(v) for k, v in x.items()}), PAYLOADS[i]


def test_canonical_json(spark):
    a = '{"b": {"y": [1, {"d": null, "c": "x\\"y"}], "x": true}, "a": 1.5, "é": "ü"}'
    b = '{"é":"ü","a":1.5,"b":{"x":true,"y":[1,{"c":"x\\"y","d":null}]}}'
    rows = spark.createDataFrame([(a,), (b,), ("no json",), (None,), ("[]",), ('{"a":1,"a":2}',)], "j string")
    got = rows.select(E.canonical_json(F.col("j")).alias("c"), E.canonical_digest(F.col("j")).alias("d"), E.nested_keys(E.canonical_json(F.col("j"))).alias("k")).collect()
    want = json.dumps(json.loads(a), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[0].c == got[1].c == want and got[0].d == got[1].d and got[0].k == ["a", "b", "c", "d", "x", "y", "é"]
    assert got[2].c is None and got[3].c is None and got[4].c == "[]" and got[4].k == [] and got[5].c is None


def many(seed=0, reviews=8, n=40):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        for r in range(reviews):
            kind = rng.choice(["review_plan_validated", "search_run_completed", "search_run_completed", "protocol_amended", "review_status_changed", *["screening_decision_recorded"] * 4])
            x = {"review_plan_validated": {"plan_id": "p"}, "protocol_amended": {"amendment_id": f"a{rng.randint(0, 3)}"}, "review_status_changed": {"status": rng.choice(["paused", "done"])}}.get(kind)
            if kind == "search_run_completed":
                run = {"run_id": f"run{rng.randint(0, 3)}", "record_count": rng.randint(0, 9)}
                x = rng.choice([run | {"source_id": "s"}, run | {"provider": "p", "_schema_version": 0}, run, {"source_id": "s"}])
            if kind == "screening_decision_recorded":
                x = {"record_id": f"rec{rng.randint(0, 4)}", "decision": rng.choice(["include", "exclude"]), "stage": "full_text", "final_authority": rng.random() < 0.6}
                for k in rng.sample(sorted(x), rng.choice([0, 0, 0, 1])):
                    del x[k]
                if rng.random() < 0.3:
                    x["reviewer_id"] = "rv"
            rows.append(event(f"r{r}", seq, kind, x, rng.choice(["human", "agent", "cli"]), actor_id=f"u{rng.randint(0, 2)}"))
    rows = chained(rows)
    spoil = {(5, 30): 8, (6, 25): 7, (7, 20): 3}  # a wrong link, a prohibited key, a repeated id
    out = []
    for r in rows:
        place = spoil.get((int(r[0][1:]), r[1]))
        out.append(r if place is None else (*r[:place], {8: "0" * 64, 7: '{"plan_id":{"secret":1}}', 3: f"{r[0]}-e2"}[place], *r[place + 1 :]))
    return out


def test_batch_of_reviews(spark):
    rows = many()
    got = rows_of(E.reduce_batch(frame(spark, rows)))
    assert got == brute(rows)
    assert [b["error"].split(":")[0] for r, s, _, b in got if s == "state" and "error" in b] == ["not_after_preceding_event", "prohibited_key", "duplicate_event_id"]
    assert E.reduce_batch(frame(spark, [])).count() == 0


def test_a_registry_with_two_steps(spark):
    registry = E.Registry(types={"t": {"a": "string", "b": "string", "c": "string"}}, current={"t": 3}, migrations=(E.Migration("t", 1, 2, {"a": "b"}, {E.VERSION: 2}), E.Migration("t", 2, 3, {"b": "c"}, {E.VERSION: 3})), required={})
    rows = [event("r", i, "t", x) for i, x in enumerate([{"a": "x"}, {E.VERSION: 2, "b": "y"}, {E.VERSION: 3, "c": "z"}, {"b": "q"}])]
    got = [(r.code, r.fields) for r in E.ingested(frame(spark, rows), registry).orderBy("seq").collect()]
    assert got == [(None, {"c": v, E.VERSION: "3"}) for v in "xyz"] + [("rename_precondition", None)]
    with pytest.raises(ValueError):
        E.Registry(types={"t": {}}, current={"t": 2}).path("t", 1)


def test_stream_gives_the_batchs_state(spark, tmp_path):
    from evigrain.streaming import review_state

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, source = many(3), str(tmp_path / "in")
    for lo, hi in ((0, 10), (10, 11), (11, 40)):
        frame(spark, [r for r in rows if lo <= r[1] < hi]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(source)
    changes, checkpoint = str(tmp_path / "changes"), str(tmp_path / "cp")
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{changes}/batch={i}")
    q = review_state.review_states(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = review_state.latest(spark.read.parquet(changes))
    assert rows_of(got) == rows_of(E.reduce_batch(frame(spark, rows))) == brute(rows)
