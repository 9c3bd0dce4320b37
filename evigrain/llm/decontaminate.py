"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

An item's windows are its runs of ``window`` words; an item of fewer words is one window.
A window is contained in a document when all its shingles (of up to three words) follow
each other there. As all of them must occur, the join prefix of a window is one shingle:
its rarest, by occurrences counted over all documents. Documents look their shingles up
in this index; the shingle's offset gives the only possible start, length and position
must lie inside the document, and all words of the window are compared, by 64-bit hashes
with a key for each place in a word.

The index goes to the tasks as broadcast blocks of at most ``BLOCK`` windows (about 150
bytes each); a larger benchmark takes several passes, whose hits are merged.

Defined cases: null or wordless documents have no hits; null or wordless items have no
windows. Items with equal windows all count. Each row of docs gives a row, repeated rows
too. Columns named in ``carry`` are kept, all others are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import carried, rest_ddl, uncarried
from .window_dedup import to_batch

BLOCK = 500_000
SHINGLE = 3
BITS = 20


def windows_of(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(w: word hashes, item) of each distinct window and item."""

    def cut(batches):
        for batch in batches:
            items = t.column(batch, "item").to_pylist()
            for lo, hi, buf, offs in t.chunks(t.column(batch, "body")):
                buf = t.LOWER[buf]
                starts, ends, first = t.words(buf, offs, t.ALPHANUMERIC)
                h = t.word_hashes(buf, starts, ends).view(np.int64)
                out = []
                for i in range(hi - lo):
                    own = h[first[i] : first[i + 1]]
                    out += [(own[k : k + window].tolist(), items[lo + i]) for k in range(max(1, len(own) - window + 1)) if len(own)]
                for k in range(0, len(out), 10_000):
                    yield to_batch(out[k : k + 10_000], WINDOWS)

    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("body")).mapInArrow(cut, "w array<long>, item string").distinct()


WINDOWS = pa.schema([("w", pa.list_(pa.int64())), ("item", pa.string())])


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for each ``size`` consecutive word hashes."""
    out = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        out = t.mix(out) + h[i : len(h) - size + 1 + i]
    return t.mix(out)


class Index:
    """Windows by a key shingle. rows: (window words, items, key offset)."""

    def __init__(self, rows: list[tuple[np.ndarray, list[str], int]]):
        self.length = np.array([len(w) for w, _, _ in rows], np.int64)
        self.words = np.zeros((len(rows), int(self.length.max(initial=1))), np.uint64)
        for i, (w, _, _) in enumerate(rows):
            self.words[i, : len(w)] = w
        self.items = [items for _, items, _ in rows]
        self.offset = np.array([k for _, _, k in rows], np.int64)
        self.by_size = {}
        for size in range(1, SHINGLE + 1):
            own = np.flatnonzero(np.minimum(self.length, SHINGLE) == size)
            if len(own):
                key = np.array([grams(rows[i][0], size)[rows[i][2]] for i in own], np.uint64)
                order = np.argsort(key)
                self.by_size[size] = (key[order], own[order], seen_bits(key))

    def find(self, h: np.ndarray, first: np.ndarray, text_of: np.ndarray):
        """(start, window) of every occurrence of a window within one text."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, (key, window, bits) in self.by_size.items():
            if len(h) < size:
                continue
            at, gram = maybe(h, size, bits)
            lo, hi = np.searchsorted(key, gram, "left"), np.searchsorted(key, gram, "right")
            n = hi - lo
            w = window[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            at = np.repeat(at, n)
            start = at - self.offset[w]
            inside = (start >= first[text_of[at]]) & (start + self.length[w] <= first[text_of[at] + 1])
            w, start = w[inside], start[inside]
            for k in range(self.words.shape[1]):
                same = (k >= self.length[w]) | (h[np.minimum(start + k, len(h) - 1)] == self.words[w, k])
                w, start = w[same], start[same]
            starts.append(start)
            found.append(w)
        return np.concatenate(starts), np.concatenate(found)


def seen_bits(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << BITS, bool)
    bits[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return bits


def maybe(h: np.ndarray, size: int, bits: np.ndarray):
    """Places and hashes of the shingles that may be among the keys behind ``bits``."""
    gram = grams(h, size)
    at = np.flatnonzero(bits[(gram >> np.uint64(64 - BITS)).astype(np.int64)])
    return at, gram[at]


def occurrences(docs: DataFrame, text: str, keys: dict[int, np.ndarray]) -> DataFrame:
    """(size, gram, n): how often each shingle among ``keys`` occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def counted(batches):
        total = {size: np.zeros(len(k), np.int64) for size, k in sent.value.items()}
        bits = {size: seen_bits(k) for size, k in sent.value.items()}
        for batch in batches:
            for _, _, buf, offs in t.chunks(t.column(batch, "body")):
                buf = t.LOWER[buf]
                starts, ends, first = t.words(buf, offs, t.ALPHANUMERIC)
                h = t.word_hashes(buf, starts, ends)
                text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for size, key in sent.value.items():
                    if len(h) >= size:
                        at, gram = maybe(h, size, bits[size])
                        gram = gram[text_of[at] == text_of[at + size - 1]]
                        place = np.minimum(np.searchsorted(key, gram), len(key) - 1)
                        total[size] += np.bincount(place[key[place] == gram], minlength=len(key))
        for size, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size), pa.int32()), pa.array(sent.value[size][some].view(np.int64)), pa.array(n[some])], names=["size", "gram", "n"])

    return docs.select(F.col(text).alias("body")).mapInArrow(counted, "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))


def indexes(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, window: int):
    """An Index for each block of the benchmark's windows."""
    found = windows_of(benchmark, item_id, item_text, window).groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))
    blocks = -(-found.count() // BLOCK)
    for block in range(blocks):
        own = found if blocks == 1 else found.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == block)
        rows = [(np.array(r.w, np.int64).view(np.uint64), r["items"]) for r in own.toLocalIterator()]
        keys: dict[int, list] = {}
        for w, _ in rows:
            keys.setdefault(min(len(w), SHINGLE), []).append(grams(w, min(len(w), SHINGLE)))
        keys = {size: np.unique(np.concatenate(k)) for size, k in keys.items()}
        count = {size: np.zeros(len(k), np.int64) for size, k in keys.items()}
        for r in occurrences(docs, text, keys).toLocalIterator():  # a row for each shingle of the block at most
            count[r["size"]][np.searchsorted(keys[r["size"]], np.int64(r["gram"]).astype(np.uint64))] = r["n"]
        out = []
        for w, items in rows:
            size = min(len(w), SHINGLE)
            out.append((w, items, int(np.argmin(count[size][np.searchsorted(keys[size], grams(w, size))]))))
        yield Index(out)


HITS = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
HITS_DDL = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, spans: merged word intervals [start, end) inside occurrences, items: sorted ids as strings), and the columns in ``carry``."""
    apart = text not in carry  # a carried text is read where it is
    rows = carried(docs, carry, id=F.col(doc_id), key=F.xxhash64(doc_id, text), **({"body": F.col(text)} if apart else {}))

    def looked_up(index: Index | None, only_hits: bool):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches):
            for batch in batches:
                out, keep = [], []
                for lo, hi, buf, offs in t.chunks(t.column(batch, "body") if apart else t.column(batch, "rest").field(text)):
                    buf = t.LOWER[buf]
                    starts, ends, first = t.words(buf, offs, t.ALPHANUMERIC)
                    h = t.word_hashes(buf, starts, ends)
                    text_of = np.repeat(np.arange(hi - lo), np.diff(first))
                    at, w = sent.value.find(h, first, text_of) if sent.value else (np.zeros(0, np.int64),) * 2
                    hit = t.covered(len(h), at, at + sent.value.length[w]) if len(at) else None
                    which = text_of[at]
                    touched = set(which.tolist())
                    for i in range(hi - lo):
                        a, b = first[i], first[i + 1]
                        if i in touched:
                            s, e = t.spans(hit[a:b])
                            items = sorted({x for k in np.unique(w[which == i]) for x in sent.value.items[k]})
                            out.append((int(b - a), [{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)], items))
                        else:
                            out.append((int(b - a), [], []))
                        keep.append(not only_hits or i in touched)
                made = to_batch(out, HITS) if out else pa.RecordBatch.from_pylist([], HITS)
                made = pa.RecordBatch.from_arrays([*(t.column(batch, c) for c in ("id", "key")), *made.columns, t.column(batch, "rest")], names=["id", "key", *HITS.names, "rest"])
                yield made.filter(pa.array(keep)) if only_hits else made

        kind = rows.schema["id"].dataType.simpleString()
        return rows.mapInArrow(run, f"id {kind}, key long, {HITS_DDL}, {rest_ddl(rows)}")

    found = list(indexes(docs, text, benchmark, item_id, item_text, window)) if not benchmark.isEmpty() else []
    got = looked_up(found[0] if found else None, False)
    if len(found) > 1:
        more = looked_up(found[1], True).select("key", "spans", "items")
        for index in found[2:]:
            more = more.unionByName(looked_up(index, True).select("key", "spans", "items"))
        more = more.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("s2"), F.flatten(F.collect_list("items")).alias("i2"))
        got = got.join(more, "key", "left")
        none = F.array()
        got = got.withColumn("spans", F.concat("spans", F.coalesce("s2", none.cast("array<struct<start:long,end:long>>")))).withColumn("items", F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i2", none.cast("array<string>"))))))
        merged = "aggregate(array_sort(spans), cast(array() as array<struct<start:long,end:long>>), (a, x) -> if(size(a) > 0 and element_at(a, -1).end >= x.start, concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"
        got = got.withColumn("spans", F.expr(merged))
    got = got.withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)"))
    return uncarried(got, carry, F.col("id").alias(doc_id), "n_words", "n_hit", "spans", "items")


def contaminated(n_hit="n_hit", n_words="n_words", share: int = 20):
    """The contamination rule: at least one word in ``share`` is hit."""
    return (F.col(n_hit) > 0) & (F.lit(share) * F.col(n_hit) >= F.col(n_words))
