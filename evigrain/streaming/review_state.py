"""The state of a review from a stream of its events: the same rows as ``operators.events.reduce_batch``, as they change."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import events as E

CHANGE = "review_id string, section string, key string, body string, at long"
SUMMARY = "n long, seq long, head string, last string, status string, planned boolean, advisory long, link_error string, policy_error string"
FIRST = (0, -1, E.GENESIS, "", "created", False, 0, None, None)


class ReviewState(StatefulProcessor):
    """State: a summary of the review, its rows by section and key, the decision each record counts under, and its event ids."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.summary = handle.getValueState("summary", SUMMARY)
        self.rows = handle.getMapState("rows", "section string, key string", "body string")
        self.decided = handle.getMapState("decided", "key string", "decision string")
        self.ids = handle.getMapState("ids", "event_id string", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        n, seq, head, last, status, planned, advisory, link_error, policy_error = self.summary.get() if self.summary.exists() else FIRST
        changed: dict[tuple[str, str], str | None] = {}

        def put(section, name, body):
            self.rows.updateValue((section, name), (body,))
            changed[section, name] = body

        def add(section, name, by):
            now = json.loads(self.rows.getValue((section, name))[0])["n"] if self.rows.containsKey((section, name)) else 0
            if now + by:
                put(section, name, f'{{"n":{now + by}}}')
            else:
                self.rows.removeKey((section, name))
                changed[section, name] = None

        events = pd.concat(list(rows)).sort_values("seq", kind="stable").astype(object)
        for e in events.where(events.notna(), None).itertuples(index=False):
            n, seq = n + 1, e.seq
            wrong = e.link_code
            if wrong is None and e.event_id and self.ids.containsKey((e.event_id,)):
                wrong = "duplicate_event_id"
            if wrong is None and e.previous_hash != head:
                wrong = "not_after_preceding_event"
            wrong = wrong or e.hash_code
            if e.event_id:
                self.ids.updateValue((e.event_id,), (True,))
            link_error = link_error or (f"{wrong}:{e.event_id or ''}" if wrong else None)
            policy_error = policy_error or (f"{e.code}:{e.event_id or ''}" if e.code else None)
            head, last, status = e.event_hash, e.event_id, e.status or status
            planned, advisory = bool(planned or e.plans), advisory + bool(e.advisory)
            if link_error or policy_error:
                continue
            add("event_type_count", e.event_type, 1)
            if e.section:
                put(e.section, e.key, e.body)
            if e.decision:
                if self.decided.containsKey((e.key,)):
                    add("final_decision_count", self.decided.getValue((e.key,))[0], -1)
                self.decided.updateValue((e.key,), (e.decision,))
                add("final_decision_count", e.decision, 1)
        self.summary.update((n, seq, head, last, status, planned, advisory, link_error, policy_error))
        error = link_error or policy_error
        values = dict(zip(E.STATE, (status, planned, n, head, last, advisory, None))) if error is None else {"error": error}
        changed["state", ""] = json.dumps({k: v for k, v in values.items() if v is not None}, separators=(",", ":"), ensure_ascii=False)
        yield pd.DataFrame([(key[0], *k, body, n) for k, body in changed.items()], columns=["review_id", "section", "key", "body", "at"])


def review_states(events: DataFrame, registry: E.Registry | None = None) -> DataFrame:
    """Changes (review_id, section, key, body, at) of the states; a null body deletes the row, at counts the review's events so far.

    Needs the RocksDB state store. Events of one batch are taken in order of seq; an event that comes after a later one
    breaks the chain.
    """
    early = F.lit(False)
    link = E.link_code(early, F.col("previous_hash"))  # ids and predecessors are known to the state only
    hash_code = F.when(link == "non_canonical_hash", link)
    e = E.effects(E.ingested(events, registry)).withColumns({"link_code": F.when(link != "non_canonical_hash", link), "hash_code": hash_code})
    e = e.select(F.col("review_id").cast("string").alias("review_id"), "seq", "event_id", "event_type", "previous_hash", "event_hash", "link_code", "hash_code", "code", "status", "section", "key", "body", "decision", "advisory", "plans")
    return e.groupBy("review_id").transformWithStateInPandas(ReviewState(), CHANGE, "update", "none")


def latest(changes: DataFrame) -> DataFrame:
    """The states as they are after all changes: what ``reduce_batch`` gives for the same events."""
    now = changes.groupBy("review_id", "section", "key").agg(F.max_by(F.struct("body"), "at").alias("v")).select("review_id", "section", "key", "v.body").where("body IS NOT NULL")
    broken = now.where("section = 'state' AND get_json_object(body, '$.error') IS NOT NULL").select("review_id")
    return now.join(broken, "review_id", "left_anti").unionByName(now.where("section = 'state'").join(broken, "review_id", "left_semi"))
