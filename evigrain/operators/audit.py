"""Hash-chained audit events: building and verifying chains, reduction, rates and replay."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from ..functions import text as T
from .components import parts

GENESIS = "GENESIS"


def by_review():
    return W.partitionBy("review_id").orderBy("seq")


def body(event_id="event_id", event_type="event_type", payload="payload") -> Column:
    """What an event's hash covers, besides the hash before it."""
    return F.concat_ws("|", F.col(event_id), F.col(event_type), F.coalesce(F.col(payload), F.lit("")))


def append_hashes(events: DataFrame) -> DataFrame:
    """events with previous_hash and event_hash, chained per review in order of seq.

    A hash needs the one before it, so a review's events pass through one task in order;
    a task holds one batch and one running hash, whatever a review's size.
    """
    rows = events.select("review_id", "seq", "event_id", "event_type", body().alias("body"))
    schema = StructType(rows.schema.fields).add("previous_hash", StringType()).add("event_hash", StringType())
    arrow = to_arrow_schema(schema)

    def chain(batches):
        review, last = None, GENESIS
        for batch in batches:
            before, now = [], []
            for r, b in zip(batch.column("review_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if r != review:
                    review, last = r, GENESIS
                before.append(last)
                last = hashlib.sha256(f"{last}\n{b}".encode()).hexdigest()
                now.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(now, pa.string())], names=arrow.names)

    return in_order(rows, "review_id", F.asc_nulls_last("seq")).mapInArrow(chain, schema)


def in_order(rows: DataFrame, group: str, *by: Column) -> DataFrame:
    """Each group whole in one partition, its rows in order; Spark sorts on disk."""
    return rows.repartition(parts(rows.sparkSession), group).sortWithinPartitions(F.col(group), *by)


def verify_chain(chained: DataFrame) -> DataFrame:
    """(review_id, events, head, broken): broken counts events with a wrong link, hash or repeated id."""
    link = F.coalesce(F.lag("event_hash").over(by_review()), F.lit(GENESIS))
    again = F.row_number().over(W.partitionBy("review_id", "event_id").orderBy("seq")) > 1
    hashed = F.sha2(F.concat_ws("\n", "previous_hash", "body"), 256)
    c = chained.select("review_id", "seq", "event_hash", ((F.col("previous_hash") != link) | (F.col("event_hash") != hashed) | again).alias("bad"))
    return c.groupBy("review_id").agg(F.count("*").alias("events"), F.max_by("event_hash", "seq").alias("head"), F.count_if("bad").alias("broken"))


def predecessors(chained: DataFrame) -> DataFrame:
    """(event_id, predecessor): by hash, within a review; events without one are left out."""
    before = chained.select("review_id", F.col("event_hash").alias("previous_hash"), F.col("event_id").alias("predecessor"))
    return chained.join(before, ["review_id", "previous_hash"]).select("event_id", "predecessor")


def reduce_reviews(events: DataFrame) -> DataFrame:
    """One state row per review: event counts, last event, final human and rejected decisions, latest actor."""
    final = F.col("event_type") == "purchase"
    return events.groupBy("review_id").agg(
        F.count("*").alias("source_event_count"), F.max_by("event_id", "seq").alias("last_event_id"),
        F.count_if(final & (F.col("actor_kind") == "human")).alias("final_decisions"), F.count_if(final & (F.col("actor_kind") != "human")).alias("rejected_final"),
        F.count_if(F.col("event_type") == "view").alias("advisory"), F.max_by("event_type", "seq").alias("status"), F.count_distinct("event_type").alias("event_types"),
    )


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("review_id", "event_type").agg(F.count("*").alias("n"))


def latest_final_decision(events: DataFrame) -> DataFrame:
    """(review_id, actor_id, event_id, value): the last human decision of each actor."""
    w = W.partitionBy("review_id", "actor_id").orderBy(F.desc("seq"))
    d = events.where("event_type = 'purchase' AND actor_kind = 'human'").withColumn("k", F.row_number().over(w))
    return d.where("k = 1").select("review_id", "actor_id", "event_id", "value")


def trailing_count(events: DataFrame, seconds: int) -> DataFrame:
    """(event_id, before): how many requests of the same actor came in the ``seconds`` up to this one."""
    at = F.unix_micros(F.to_timestamp("occurred_at"))
    w = W.partitionBy("actor_id").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    return events.select("event_id", "actor_id", at.alias("at")).select("event_id", (F.count("*").over(w) - 1).alias("before"))


def first_seen(events: DataFrame, key: list[str]) -> DataFrame:
    """(event_id, replay): is the key one that an earlier event had?"""
    return events.select("event_id", (F.row_number().over(W.partitionBy(*key).orderBy("seq")) > 1).alias("replay"))


def reserve(events: DataFrame, interval_ms: int) -> DataFrame:
    """(event_id, start_ms): when each request of a review may go, interval_ms after the one before at least.

    With k the number of requests before, start = max over them of (time - i * interval) + k * interval.
    """
    at = F.floor(F.unix_micros(F.to_timestamp("occurred_at")) / 1000)
    w = W.partitionBy("review_id").orderBy("at", "seq")
    e = events.select("event_id", "review_id", "seq", at.alias("at")).withColumn("k", F.row_number().over(w).cast("long") - 1)
    high = F.max(F.col("at") - F.col("k") * interval_ms).over(w.rowsBetween(W.unboundedPreceding, 0))
    return e.select("event_id", (high + F.col("k") * interval_ms).alias("start_ms"))


def result_digest(rows: DataFrame, group: str, seq: str, value: Column) -> DataFrame:
    """(group, digest): SHA-256 over the sequence of value digests of each group."""
    rows = rows.select(group, F.col(seq).alias("s"), F.sha2(value, 256).alias("h"))
    schema = StructType([rows.schema[0]]).add("digest", StringType())
    arrow = to_arrow_schema(schema)

    def digests(batches):
        now, running, first = None, None, True
        for batch in batches:
            out = []
            for g, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if running is None or g != now:
                    if running is not None:
                        out.append((now, running.hexdigest()))
                    now, running, first = g, hashlib.sha256(), True
                if h is not None:
                    running.update((h if first else f"\n{h}").encode())
                    first = False
            if out:
                yield batch_of(out)
        if running is not None:
            yield batch_of([(now, running.hexdigest())])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return in_order(rows, group, F.col("s"), F.col("h")).mapInArrow(digests, schema)


def redact(x: Column) -> Column:
    """Text without e-mail addresses, bearer tokens, values of secret-looking keys and high-entropy tokens."""
    mail = lambda x: F.regexp_replace(x, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]")
    x = T.let(x, lambda x: F.when(x.contains("@"), mail(x)).otherwise(x))
    x = F.regexp_replace(x, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")
    x = F.regexp_replace(x, r"(?i)(api[_-]?key|token|password|secret)(\s*[:=]\s*)[^\s,;]+", "$1$2[REDACTED]")
    # cut before and after each run of 20 token characters or more; nothing is lost between the pieces
    c = "[A-Za-z0-9_~+/.=-]"
    secret = lambda p: p.rlike(rf"\A{c}{{20,}}\z") & p.rlike("[0-9]") & (entropy(p) >= 3.5 - 1e-9)
    kept = lambda x: F.transform(F.split(x, f"(?<!{c})(?={c}{{20}})|(?<={c}{{20}})(?!{c})", -1), lambda p: F.when(secret(p), "[REDACTED]").otherwise(p))
    # the text is named thrice: without let each of the patterns above would run on it thrice
    return T.let(x, lambda x: F.when(x.rlike(f"{c}{{20}}"), F.array_join(kept(x), "")).otherwise(x))


def entropy(x: Column) -> Column:
    """Shannon entropy of the characters of x in bits."""
    n = F.length(x).cast("double")
    share = lambda ch: (F.length(x) - F.length(F.replace(x, ch, F.lit("")))).cast("double") / n
    parts = F.transform(F.transform(F.array_distinct(F.split(x, "")), share), lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p)


def prov(receipts: DataFrame, events: DataFrame, chained: DataFrame) -> DataFrame:
    """(review_id, section, id, body): the provenance graph of each review, a row per node or edge, body its JSON.

    ``receipts`` has review_id, receipt_id, provider_id, records and executed_at; ``chained`` the
    hashes of the events by ``append_hashes``. An actor is described by the last event.
    """
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def rows(df, section, prefix, key, **body):
        return df.select("review_id", F.lit(section).alias("section"), F.concat(F.lit(f"sr:{prefix}-"), key).alias("id"), F.to_json(F.struct(*(v.alias(k) for k, v in body.items()))).alias("body"))

    event, actor = F.concat(F.lit("sr:event-"), "event_id"), F.concat(F.lit("sr:actor-"), "actor_id")
    agents = events.groupBy("review_id", "actor_id").agg(F.max_by("actor_kind", "seq").alias("actor_kind"))
    before = chained.select("review_id", F.col("event_hash").alias("previous_hash"), F.col("event_id").alias("used"))
    derived = chained.join(before, ["review_id", "previous_hash"])
    parts = [
        rows(receipts, "entity", "receipt", "receipt_id", **{"prov:type": F.lit("sr:SourceReceipt"), "sr:provider": F.col("provider_id"), "sr:recordsRetrieved": F.col("records"), "prov:generatedAtTime": at("executed_at")}),
        rows(events, "activity", "event", "event_id", **{"prov:type": F.col("event_type"), "prov:startedAtTime": at("occurred_at")}),
        rows(agents, "agent", "actor", "actor_id", **{"prov:type": F.col("actor_kind")}),
        rows(events, "wasAssociatedWith", "association", "event_id", **{"prov:activity": event, "prov:agent": actor}),
        rows(derived, "wasDerivedFrom", "derivation", "event_id", **{"prov:generatedEntity": event, "prov:usedEntity": F.concat(F.lit("sr:event-"), "used")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
