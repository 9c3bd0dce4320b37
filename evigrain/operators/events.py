"""Registered audit events: canonical payloads, ingestion policy, version migrations, and the state of a review.

A registry says which event types exist and, for each, its payload keys with their types and
its versions. ``ingested`` turns it into columns: a code for what is wrong with an event, and
the payload's fields after migration to the current version. ``reduce_batch`` folds the
events of all reviews with windows and aggregations; ``streaming.review_state`` folds a stream
of the same columns with state. Both give rows (review_id, section, key, body), so that a
review with many runs or decisions is many rows, never one array.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut

GENESIS = "GENESIS"

#: The registered event types with their payload keys, and what no payload may hold.
EVENT_SCHEMA = "audit-event.v1"
PROHIBITED = ("credential", "password", "secret", "token", "full_text")
MAXIMUM_BYTES = 16_384
EVENT_TYPES = {
    "execution_committed": {"commit_id": "string", "receipt_id": "string", "record_count": "integer", "run_id": "string"},
    "protocol_amended": {"amendment_id": "string"},
    "review_plan_validated": {"contract_version": "string", "plan_id": "string"},
    "review_status_changed": {"status": "string"},
    "screening_decision_recorded": {"decision": "string", "final_authority": "boolean", "record_id": "string", "reviewer_id": "string", "stage": "string"},
    "search_run_completed": {"provider": "string", "record_count": "integer", "run_id": "string", "source_id": "string"},
}
VERSION = "_schema_version"


@dataclass(frozen=True)
class Migration:
    """One step of an event type's payload from a version to the next: renamed keys, then replaced values."""

    event_type: str
    before: int
    after: int
    renames: dict[str, str] = field(default_factory=dict)
    replaces: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Registry:
    """Event types with the types of their payload keys, current versions (1 if unsaid), and migrations."""

    types: dict[str, dict[str, str]] = field(default_factory=lambda: EVENT_TYPES)
    current: dict[str, int] = field(default_factory=dict)
    migrations: tuple[Migration, ...] = (Migration("search_run_completed", 0, 1, {"provider": "source_id"}, {VERSION: 1}),)
    required: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"execution_committed": ("commit_id", "receipt_id", "record_count", "run_id")})

    def versions(self, event_type: str) -> list[int]:
        now = self.current.get(event_type, 1)
        return sorted({now} | {m.before for m in self.migrations if m.event_type == event_type})

    def path(self, event_type: str, version: int) -> list[Migration]:
        """The migrations from a version to the current one; raises where the way breaks off or does not advance."""
        steps = []
        while version != self.current.get(event_type, 1):
            step = next((m for m in self.migrations if (m.event_type, m.before) == (event_type, version)), None)
            if step is None or step.after <= version:
                raise ValueError(f"no migration of {event_type} from version {version}")
            steps.append(step)
            version = step.after
        return steps


def canonical_json(json: Column) -> Column:
    """The JSON text with object keys in order at every depth and no spaces; null where it isn't JSON or has a key twice.

    A variant holds the fields of an object in the order of their names.
    """
    return F.to_json(F.try_parse_json(json))


def canonical_digest(json: Column) -> Column:
    """SHA-256 of the canonical form, the same for any order of keys."""
    return F.sha2(canonical_json(json), 256)


def nested_keys(canonical: Column) -> Column:
    """The distinct object keys at every depth of a canonical JSON text, in order.

    Strings are read off whole, with the colon that follows if they are keys; so nothing inside a string counts.
    """
    strings = F.regexp_extract_all(canonical, F.lit(r'"(?:[^"\\]|\\.)*":?'), F.lit(0))
    bare = lambda s: F.concat(F.lit("["), s.substr(F.lit(1), F.length(s) - 1), F.lit("]"))
    keys = F.transform(F.filter(strings, lambda s: s.endswith('":')), lambda s: F.element_at(F.from_json(bare(s), "array<string>"), 1))
    return F.array_sort(F.array_distinct(keys))


def is_valid(value: Column, kind: str) -> Column:
    """Is a variant a whole number of 0 or more, a Boolean, or a text that isn't blank, has no control characters and at most 512 bytes?"""
    type_ = F.schema_of_variant(value)
    if kind == "boolean":
        return type_ == "BOOLEAN"
    if kind == "integer":
        return (type_ == "BIGINT") & (F.try_variant_get(value, "$", "long") >= 0)
    x = F.try_variant_get(value, "$", "string")
    return (type_ == "STRING") & x.rlike(r"(?U)\S") & ~x.rlike(r"\p{Cc}") & (F.octet_length(x) <= 512)


def migrated(fields: Column, types: dict[str, str], steps: list[Migration]) -> tuple[Column, dict[str, tuple[Column, Column]]]:
    """(do all preconditions hold, key -> (is it there, its variant)) after some migrations of a map of variants."""
    now = {k: (F.map_contains_key(fields, k), fields[k]) for k in (VERSION, *types)}
    holds = F.lit(True)
    for step in steps:
        for old, new in step.renames.items():
            there, value = now.pop(old)
            holds = holds & there & ~now[new][0]
            now[new] = (there, value)
        for key, value in step.replaces.items():
            now[key] = (F.lit(True), F.parse_json(F.lit(f'"{value}"' if isinstance(value, str) else str(value).lower())))
    return holds, now


def ingested(events: DataFrame, registry: Registry | None = None, event_type: str = "event_type", payload: str = "payload") -> DataFrame:
    """events with code, what the ingestion policy holds against a payload (null: nothing), and fields, its keys and values at the current version.

    A payload must be a JSON object without repeated keys. fields is null where there is a code.
    """
    registry = registry or Registry()
    canonical = canonical_json(F.col(payload))
    rows = events.withColumns({"_json": canonical, "_map": F.when(F.substring(canonical, 1, 1) == "{", F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>"))})
    keys, found = F.map_keys("_map"), F.col("_map")
    kind = F.schema_of_variant(found[VERSION])
    version = F.when(~F.map_contains_key(found, VERSION), F.lit(1).cast("long")).when(kind == "BIGINT", F.try_variant_get(found[VERSION], "$", "long"))
    denied = F.exists(nested_keys(F.col("_json")), lambda k: F.lower(k).isin(*PROHIBITED))
    code = F.when(F.col("_map").isNull(), "payload_not_object").when(F.octet_length("_json") > MAXIMUM_BYTES, "payload_too_large").when(denied, "prohibited_key")
    code = code.when(~F.coalesce(F.col(event_type).isin(*registry.types), F.lit(False)), "unregistered_type")
    values = None
    for name, types in registry.types.items():
        own = F.col(event_type) == name
        code = code.when(own & (F.size(F.array_except(keys, F.array(*map(F.lit, (VERSION, *types))))) > 0), "unregistered_key")
        code = code.when(own & version.isNull(), "version_not_integer").when(own & ~version.isin(*registry.versions(name)), "unsupported_version")
        if need := registry.required.get(name):
            code = code.when(own & (F.size(F.array_except(F.array(*map(F.lit, need)), keys)) > 0), "missing_key")
        for n in registry.versions(name):
            here = own & (version == n)
            holds, now = migrated(found, types, registry.path(name, n))
            valid = F.lit(True)
            for k, (there, value) in now.items():
                valid = valid & (~there | F.coalesce(is_valid(value, types.get(k, "integer")), F.lit(False)))
            code = code.when(here & ~holds, "rename_precondition").when(here & ~valid, "invalid_field")
            entries = [F.when(there, F.struct(F.lit(k).alias("key"), F.try_variant_get(value, "$", "string").alias("value"))) for k, (there, value) in now.items()]
            built = F.map_from_entries(F.array_compact(F.array(*entries)))
            values = built if values is None and not types else F.when(here, built) if values is None else values.when(here, built)
    rows = rows.withColumn("code", code)
    return rows.withColumn("fields", F.when(F.col("code").isNull(), values)).drop("_json", "_map")


def linked(events: DataFrame) -> DataFrame:
    """events with link_code: what is wrong with an event's place in its review's chain, null if nothing."""
    order = Window.partitionBy("review_id").orderBy("seq")
    again = F.row_number().over(Window.partitionBy("review_id", "event_id").orderBy("seq")) > 1
    before = F.coalesce(F.lag("event_hash").over(order), F.lit(GENESIS))
    return events.withColumn("link_code", link_code(again, before))


def link_code(again: Column, before: Column) -> Column:
    blank = F.coalesce(F.col("event_id") == "", F.lit(True))
    code = F.when(F.col("schema_version").isNull() | (F.col("schema_version") != EVENT_SCHEMA), "unsupported_schema_version").when(blank, "no_event_id").when(again, "duplicate_event_id")
    code = code.when(~F.coalesce(F.col("previous_hash") == before, F.lit(False)), "not_after_preceding_event")
    return code.when(~F.coalesce(F.col("event_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "non_canonical_hash")


def effects(events: DataFrame) -> DataFrame:
    """Ingested events with what each does: its status, section, key and body, and whether it is advisory."""
    f, kind = F.col("fields"), F.col("event_type")
    get = lambda k: F.try_element_at(f, F.lit(k))
    decides = kind == "screening_decision_recorded"
    record, final, human = get("record_id"), F.coalesce(get("final_authority") == "true", F.lit(False)), F.col("actor_type") == "human"
    run = (kind == "search_run_completed") & get("run_id").isNotNull()
    amended = (kind == "protocol_amended") & get("amendment_id").isNotNull()
    accepted, rejected = decides & record.isNotNull() & final & human, decides & record.isNotNull() & final & ~F.coalesce(human, F.lit(False))
    malformed = decides & record.isNull()
    status = F.when(kind == "review_plan_validated", "planned").when(run, "searching").when(kind == "review_status_changed", get("status")).when(accepted, "screening")
    section = F.when(run, "search_run").when(amended, "amendment").when(accepted, "final_decision").when(rejected, "rejected_final_authority").when(malformed, "unknown_event_type")
    key = F.when(run, get("run_id")).when(amended, get("amendment_id")).when(accepted, record).when(rejected, F.col("event_id")).when(malformed, "malformed:screening_decision_recorded")
    reviewer = F.coalesce(get("reviewer_id"), F.col("actor_id").cast("string"))
    body = F.when(run, F.to_json(F.struct(get("run_id").alias("run_id"), get("source_id").alias("source_id"), get("record_count").cast("long").alias("record_count"), "event_id")))
    body = body.when(accepted, F.to_json(F.struct(record.alias("record_id"), get("stage").alias("stage"), get("decision").alias("decision"), reviewer.alias("reviewer_id"), "event_id"))).when(section.isNotNull(), "{}")
    decision = F.when(accepted, F.coalesce(get("decision"), F.lit("None")))
    advisory = decides & record.isNotNull() & ~final
    return events.withColumns({"status": status, "section": section, "key": key, "body": body, "decision": decision, "advisory": advisory, "plans": kind == "review_plan_validated"})


STATE = ("status", "plan_validated", "source_event_count", "source_head_hash", "last_event_id", "advisory_recommendation_count", "error")


def reduce_batch(events: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(review_id, section, key, body): the state of each review after all its events, in order of seq.

    ``events`` has review_id, seq, schema_version, event_id, event_type, actor_id, actor_type, payload, previous_hash and
    event_hash. Section ``state`` has one row a review; its error names the first event that breaks the chain or else the
    policy. A review with an error has no other rows: nothing can be derived from it.
    """
    e = effects(ingested(linked(events), registry))
    code = F.when(F.col("link_code").isNotNull(), F.struct(F.lit(0).alias("rank"), "seq", F.col("link_code").alias("code"), "event_id")).when(F.col("code").isNotNull(), F.struct(F.lit(1).alias("rank"), "seq", "code", "event_id"))
    # judged once: four aggregations read it
    e = cut(e.select("review_id", "seq", "event_id", "event_type", "event_hash", "status", "section", "key", "body", "decision", "advisory", "plans", code.alias("wrong")))
    state = e.groupBy("review_id").agg(
        F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))), F.lit("created")).alias("status"), F.max("plans").alias("plan_validated"), F.count("*").alias("source_event_count"),
        F.max_by("event_hash", "seq").alias("source_head_hash"), F.max_by("event_id", "seq").alias("last_event_id"), F.count_if("advisory").alias("advisory_recommendation_count"), F.min("wrong").alias("wrong"),
    )
    wrong = F.when(F.col("wrong").isNotNull(), F.concat_ws(":", "wrong.code", F.coalesce("wrong.event_id", F.lit(""))))
    state = state.withColumn("error", wrong)
    broken = state.where("error IS NOT NULL").select("review_id")
    good = e.join(broken, "review_id", "left_anti")
    last = good.where("section IS NOT NULL").groupBy("review_id", "section", "key").agg(F.max_by("body", "seq").alias("body"), F.max_by("decision", "seq").alias("decision"))
    counted = lambda rows, section, key: rows.groupBy("review_id", F.lit(section).alias("section"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select("review_id", "section", "key", F.to_json(F.struct("n")).alias("body"))
    sound = F.to_json(F.struct(*STATE))
    failed = F.to_json(F.struct("error"))
    rows = state.select("review_id", F.lit("state").alias("section"), F.lit("").alias("key"), F.when(F.col("error").isNull(), sound).otherwise(failed).alias("body"))
    rows = rows.unionByName(last.select("review_id", "section", "key", "body"))
    rows = rows.unionByName(counted(last.where("section = 'final_decision'"), "final_decision_count", "decision"))
    return rows.unionByName(counted(good, "event_type_count", "event_type"))


def check_heads(states: DataFrame, heads: DataFrame) -> DataFrame:
    """states, each review held against its verified head (review_id, verified_head): where it differs only an error stays."""
    head = F.get_json_object("body", "$.source_head_hash")
    own = states.where("section = 'state'").join(heads, "review_id", "left")
    differs = own.where(F.get_json_object("body", "$.error").isNull() & ~F.coalesce(head == F.col("verified_head"), F.lit(False))).select("review_id").distinct()
    named = F.to_json(F.struct(F.lit("verified_head_mismatch").alias("error")))
    return states.join(differs, "review_id", "left_anti").unionByName(differs.select("review_id", F.lit("state").alias("section"), F.lit("").alias("key"), named.alias("body")))
