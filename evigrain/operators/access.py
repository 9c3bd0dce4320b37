"""Gated requests: a bounded replay ledger and a rate that counts permitted requests only.

Both depend on order: a denied request leaves no trace, so whether one is denied decides
about those after it. Requests of a tenant pass through one task in order; it holds the
tenant's ledger (at most ``capacity`` ids) and the times of the last ``window`` of each
actor (at most ``limit``), whatever the number of requests. Spark sorts on disk.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from .audit import in_order

#: The codes of denied requests.
RATE, REPLAY = "access.rate.exceeded", "access.replay.request_reused"
CAPACITY = 4096


class Gate:
    """The state of one tenant."""

    def __init__(self, limit: int, capacity: int = CAPACITY, window: int = 60_000_000, ids=(), times=None):
        self.limit, self.capacity, self.window = limit, max(capacity, 1), window
        self.order = deque(ids)
        self.ids = set(self.order)
        self.times: dict = {actor: deque(x) for actor, x in (times or {}).items()}

    def decide(self, actor, request, at: int, blocker: str | None) -> str | None:
        """Why the request is denied, or None; only a permitted one is remembered.

        The rate comes first, then what the caller's policy holds against it, then replay. A request as old as the
        window still counts.
        """
        seen = self.times.setdefault(actor, deque())
        while seen and seen[0] < at - self.window:
            seen.popleft()
        if len(seen) >= self.limit:
            return RATE
        if blocker is not None:
            return blocker
        if request in self.ids:
            return REPLAY
        while len(self.order) >= self.capacity:
            self.ids.discard(self.order.popleft())
        self.ids.add(request)
        self.order.append(request)
        seen.append(at)
        return None


def gated(requests: DataFrame, limit: int, capacity: int = CAPACITY, window_seconds: int = 60) -> DataFrame:
    """requests with denied: null, or why.

    ``requests`` has tenant, actor, request, at (timestamp), seq and blocker (what other policy holds against it, or null).
    Order is at, then seq. A null actor or request is a value like others.
    """
    rows = requests.select("tenant", "actor", "request", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "seq", "blocker")
    schema = StructType(rows.schema.fields).add("denied", StringType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        tenant, gate = None, None
        for batch in batches:
            out = []
            for t, actor, request, at, blocker in zip(*(batch.column(c).to_pylist() for c in ("tenant", "actor", "request", "at", "blocker")), strict=True):
                if gate is None or t != tenant:
                    tenant, gate = t, Gate(limit, capacity, window_seconds * 1_000_000)
                out.append(gate.decide(actor, request, at, blocker))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], schema=arrow)

    return in_order(rows, "tenant", F.col("at"), F.col("seq")).mapInArrow(run, schema)
