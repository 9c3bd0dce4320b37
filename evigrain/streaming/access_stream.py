"""Gated requests as a stream: the same decisions as ``operators.access.gated``, with each tenant's gate as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.access import CAPACITY, Gate

DECIDED = "tenant string, actor string, request string, at long, seq long, blocker string, denied string"


class GateProcessor(StatefulProcessor):
    """State: the ids of the ledger in order, and the times of each actor; both bounded."""

    def __init__(self, limit: int, capacity: int, window_seconds: int):
        self.limit, self.capacity, self.window = limit, capacity, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ledger = handle.getValueState("ledger", "ids array<string>")
        self.times = handle.getMapState("times", "actor string", "at array<long>")

    def handleInputRows(self, key, rows, timerValues):
        requests = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").astype(object)
        requests = requests.where(requests.notna(), None)
        gate = Gate(self.limit, self.capacity, self.window, ids=list(self.ledger.get()[0]) if self.ledger.exists() else ())
        for actor in requests["actor"].unique():
            name = (actor or "",)
            if self.times.containsKey(name):
                gate.times[actor] = type(gate.order)(self.times.getValue(name)[0])
        requests["denied"] = [gate.decide(r.actor, r.request, int(r.at), r.blocker) for r in requests.itertuples(index=False)]
        self.ledger.update((list(gate.order),))
        for actor, times in gate.times.items():
            self.times.updateValue((actor or "",), (list(times),))
        yield requests[[c.split()[0] for c in DECIDED.split(", ")]]


def gated_stream(requests: DataFrame, limit: int, capacity: int = CAPACITY, window_seconds: int = 60) -> DataFrame:
    """Each request of the stream with denied; those of one batch are taken in order of time and seq. Needs the RocksDB state store."""
    rows = requests.select(F.col("tenant").cast("string").alias("tenant"), F.col("actor").cast("string").alias("actor"), "request", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "seq", "blocker")
    return rows.groupBy("tenant").transformWithStateInPandas(GateProcessor(limit, capacity, window_seconds), DECIDED, "append", "none")
