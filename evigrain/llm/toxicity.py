"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (2**BITS slots) of its lower-cased words, of
pairs of neighbours and of pairs with one word between. ``train`` fits on a bounded sample
of the labelled rows: those ``max_rows`` with the smallest hash of doc_id. One task runs
the per-coordinate updates over the sample's features and returns the weights that the L1
term leaves different from zero, at most 2**BITS numbers, which go to all tasks.

Defined cases: null or wordless text has no features and gets the score of the bias alone.
Rows with a null label, and ids without a document, are not learned from. Without labelled
rows, or with one label only, the score is that label's share (0.5 without any). Rows with
the same doc_id are separate. Columns named in ``carry`` are kept, all others are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import carried, rest_ddl, uncarried

BITS = 22
#: Lengths in bytes of the stems (word beginnings) that count as words too.
STEMS = (4, 5, 6)


def features(h: np.ndarray, first: np.ndarray, stems: list[np.ndarray]):
    """(text, slot) of all n-grams, skip-grams and stems (0: none), not yet distinct."""
    which = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for kind, gap in enumerate((0, 1, 2)):
        if len(h) <= gap:
            continue
        key = t.mix(h + np.uint64(kind)) if not gap else t.mix(t.mix(h[:-gap] + np.uint64(kind)) + h[gap:])
        inside = which[gap:] == which[: len(which) - gap]
        yield which[: len(which) - gap][inside], (key[inside] >> np.uint64(64 - BITS)).astype(np.int64)
    for kind, stem in enumerate(stems, 3):
        some = stem != 0
        yield which[some], (t.mix(stem[some] + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def hashed(texts: pa.Array):
    """(rows from, to, word hashes, word ranges, stem hashes) of each chunk."""
    for lo, hi, buf, offs in t.chunks(texts):
        buf = t.LOWER[buf]
        starts, ends, first = t.words(buf, offs, t.ALPHANUMERIC)
        codes = t.BYTE_CODES[buf]
        yield lo, hi, t.range_hash(codes, starts, ends), first, [np.where(ends - starts > k, t.range_hash(codes, starts, np.minimum(starts + k, ends)), np.uint64(0)) for k in STEMS]


@dataclass
class Model:
    bias: float = 0.0
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float64))


@dataclass
class Ftrl:
    """Per-coordinate learning rates and L1: the state is z and n for each slot, the weight follows from them."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 8

    def weight(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, rows: list[tuple[int, np.ndarray]]) -> Model:
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        bias = bias_n = 0.0
        for _ in range(self.epochs):
            for label, slots in rows:
                w = self.weight(z[slots], n[slots])
                g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
                more = n[slots] + g * g
                z[slots] += g - (np.sqrt(more) - np.sqrt(n[slots])) / self.alpha * w
                n[slots] = more
                bias_n += g * g
                bias -= self.alpha / (self.beta + np.sqrt(bias_n)) * g
        w = self.weight(z, n)
        slots = np.flatnonzero(w)
        return Model(float(bias), slots, w[slots])


TRAINED = pa.schema([("slot", pa.int64()), ("weight", pa.float64())])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", allowed: Column | None = None, max_rows: int = 10_000, ftrl: Ftrl | None = None) -> Model:
    """Fit on at most ``max_rows`` labelled rows for which ``allowed``, a condition on labels, holds."""
    ftrl = ftrl or Ftrl()
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.where(allowed) if allowed is not None else known
    known = known.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    share = known.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    if not share.n or share.p in (0.0, 1.0):
        p = min(max(share.p if share.n else 0.5, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))))

    def slots_of(batches):
        for batch in batches:
            ids, label = (t.column(batch, c).to_numpy() for c in ("id", "label"))
            for lo, hi, h, first, stems in hashed(t.column(batch, "body")):
                which, slot = (np.concatenate(x) for x in zip(*features(h, first, stems), strict=True)) if len(h) else (np.zeros(0, np.int64),) * 2
                key = np.unique((which << BITS) | slot)
                edges = np.searchsorted(key >> BITS, np.arange(hi - lo + 1))
                key = (key & ((1 << BITS) - 1)).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(label[lo:hi], pa.int32()), pa.array([key[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["id", "label", "slots"])

    def fit(batches):
        rows = sorted(((t.mix(np.array([i], np.int64).view(np.uint64))[0], i, y, s) for b in batches for i, y, s in zip(*(b.column(c).to_pylist() for c in ("id", "label", "slots")), strict=True)), key=lambda r: r[:3])
        model = ftrl.fit([(y, np.frombuffer(s, "<i4")) for _, _, y, s in rows])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.slots, -1)), pa.array(np.append(model.weights, model.bias))], schema=TRAINED)

    # at most max_rows ids, 12 bytes each
    sample = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body")).join(F.broadcast(known), "id").select("id", "label", "body")
    rows = sample.mapInArrow(slots_of, "id long, label int, slots binary").repartition(1).mapInArrow(fit, "slot long, weight double").toArrow().sort_by("slot")
    slot, weight = rows["slot"].to_numpy(), rows["weight"].to_numpy()
    return Model(float(weight[0]), slot[1:], weight[1:]) if len(slot) else Model()


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score) for each row, and the columns in ``carry``."""
    apart = text not in carry  # a carried text is read where it is
    rows = carried(docs, carry, id=F.col(doc_id), **({"body": F.col(text)} if apart else {}))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        weight = np.zeros(1 << BITS)
        weight[sent.value.slots] = sent.value.weights
        live = weight != 0
        for batch in batches:
            out = np.full(batch.num_rows, sent.value.bias)
            for lo, hi, h, first, stems in hashed(t.column(batch, "body") if apart else t.column(batch, "rest").field(text)):
                keys = [(which[live[slot]] << BITS) | slot[live[slot]] for which, slot in features(h, first, stems)]
                if keys:
                    key = np.unique(np.concatenate(keys))
                    out[lo:hi] += np.bincount(key >> BITS, weight[key & ((1 << BITS) - 1)], minlength=hi - lo)
            out = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([t.column(batch, "id"), pa.array(out), t.column(batch, "rest")], names=["id", "score", "rest"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(scored, f"id {kind}, score double, {rest_ddl(rows)}")
    return uncarried(got, carry, F.col("id").alias(doc_id), "score")


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by
