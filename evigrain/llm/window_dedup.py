"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

``mark_windows`` hashes every window of every text (numpy, from one running sum), deals
the hashes to shuffle partitions by hash and finds there each window that also starts
earlier. ``remove_windows`` merges these windows into maximal intervals per document.

Only compact rows are shuffled: a task packs the windows that go to one bucket into one
row (9 bytes of hash, 1 to 2 for the place), in flushes of ``FLUSH`` windows. Of a window
that occurs several times in a flush only the first place goes to the window's bucket; the
others are later ones for certain and go to their documents straight away. A passage in a
third of all documents thus costs its bucket one entry a flush.

A window's identity has 72 + log2(buckets) bits: all 64 of one hash, and of a second hash,
over other codes of the bytes, one byte and the bucket, which comes from bits outside that
byte. D distinct windows give about D^2 / (2^73 * buckets) false repeats in all.

Words are hashed with a key for each place, so regular words don't collide; windows by
powers of one base over their words' hashes.

Defined cases: null or empty text, or fewer words than a window: nothing is removed. Equal
rows (same doc_id and text) count as one document, as identical places never count as
earlier, and each of them gets a result row. Rows that share a doc_id and differ in text
are documents of their own, in the order of their texts' hashes. A null doc_id sorts
before all others. An empty table gives an empty result. Other columns of the input are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import materialise, parts

#: Windows that a task holds before it sends them on.
FLUSH = 1 << 20
NO_ID = -(1 << 63)
#: Bytes of a window's packed key.
WIDE = 9


def planes(x: np.ndarray) -> bytes:
    """Little-endian int32 by byte position, so the zeros of small numbers compress."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def hash_bytes(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)


def wide_key(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """WIDE bytes: h and the lowest byte of check."""
    return np.concatenate((hash_bytes(h), hash_bytes(check)[:, :1]), axis=1)


def pack(bucket: np.ndarray, buckets: int, doc: np.ndarray, at: np.ndarray, h: np.ndarray | None = None, uid: np.ndarray | None = None):
    """One row (bucket, docs, runs, at, hash) for each bucket; entries keep their order.

    h is 64-bit hashes, of which the upper 48 bits are kept, or rows of bytes, kept whole. Without h, hash is empty.
    docs has a number for each run of entries of one document, and then, where not all are zero, a uid for each.
    """
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket, doc, at = bucket[order], doc[order], at[order]
    uid = None if uid is None or not uid.any() else uid[order]
    if h is None:
        key = np.zeros((len(doc), 0), np.uint8)
    else:
        key = h[order] if h.ndim == 2 else np.ascontiguousarray(hash_bytes(h[order])[:, 2:])
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[k], edges[k + 1]
        d, a = doc[lo:hi], at[lo:hi].astype(np.int64)
        u = d if uid is None else uid[lo:hi]
        heads = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (u[1:] != u[:-1]))))
        step = np.diff(a, prepend=0)
        step[heads] = a[heads]
        more = b"" if uid is None or not u.any() else u[heads].astype("<i8").tobytes()
        yield int(k), d[heads].astype("<i8").tobytes() + more, planes(np.diff(np.append(heads, hi - lo))), planes(step), key[lo:hi].tobytes()


def unpack(rows: list[tuple[bytes, bytes, bytes, bytes]]):
    """doc, at and hash (its upper 48 bits, if packed) of all entries of some packed rows."""
    doc, _, at, h = unpack_all(rows)
    return doc, at, h


def unpack_all(rows: list[tuple[bytes, bytes, bytes, bytes]]):
    """doc, uid, at and hash (its upper 48 bits, if packed) of all entries of some packed rows."""
    docs, uids, ats, hashes = [], [], [], []
    for d, runs, at, h in rows:
        runs = unplanes(runs)
        step = unplanes(at).astype(np.int64)
        total = np.cumsum(step)
        heads = np.cumsum(runs) - runs
        ats.append(total - np.repeat(total[heads] - step[heads], runs))
        named = np.frombuffer(d, "<i8")
        docs.append(np.repeat(named[: len(runs)], runs))
        uids.append(np.repeat(named[len(runs) :] if len(named) > len(runs) else np.zeros(len(runs), np.int64), runs))
        key = np.zeros((len(h) // 6, 8), np.uint8)
        key[:, 2:] = np.frombuffer(h, np.uint8).reshape(-1, 6)
        hashes.append(key.view("<u8").ravel())
    return tuple(np.concatenate(x) for x in (docs, uids, ats, hashes))


def unpack_wide(rows: list[tuple[bytes, bytes, bytes, bytes]]):
    """doc, uid, at, hash and check byte of all entries of some rows packed with wide_key."""
    doc, uid, at, _ = unpack_all([(*r[:3], b"") for r in rows])
    keys = [np.frombuffer(r[3], np.uint8).reshape(-1, WIDE) for r in rows]
    return doc, uid, at, np.concatenate([np.ascontiguousarray(k[:, :8]).view("<u8").ravel() for k in keys]), np.concatenate([k[:, 8] for k in keys])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)


def packed_rows(batches) -> list[tuple]:
    empty = (b"",) * 4
    return [r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("docs", "runs", "at", "hash")), strict=True)] or [empty]


PACKED = "bucket int, docs binary, runs binary, at binary, hash binary"


def ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return t.column(batch, name).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def to_batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


PACKED_ARROW = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("docs", "runs", "at", "hash"))])


def pack_all(pieces, buckets: int):
    """Pack (doc, at, hash) or (doc, at, hash, check, uid) pieces into record batches, a flush at a time."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= FLUSH:
            yield to_batch(list(pack_held(held, buckets)), PACKED_ARROW)
            held, n = [], 0
    if n:
        yield to_batch(list(pack_held(held, buckets)), PACKED_ARROW)


def pack_held(held: list, buckets: int):
    doc, at, h, *check = (np.concatenate(x) for x in zip(*held, strict=True))
    if check:
        return pack(bucket_of(check[0], buckets), buckets, doc, at, wide_key(h, check[0]), *check[1:])
    return pack(bucket_of(h, buckets), buckets, doc, at, h)


def later_places(doc: np.ndarray, uid: np.ndarray, at: np.ndarray, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, extra): entries whose window has an earlier place among these, and all that needn't be passed on."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(h) else order
    order = order[np.lexsort((at[order], uid[order], doc[order], check[order], h[order]))]
    d, u, a, x, c = doc[order], uid[order], at[order], h[order], check[order]
    head = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (c[1:] != c[:-1]))))[: len(x)]
    size = np.diff(np.append(head, len(x)))
    later, extra = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order] = (d != np.repeat(d[head], size)) | (u != np.repeat(u[head], size)) | (a != np.repeat(a[head], size))
    extra[order] = True
    extra[order[head]] = False
    return later, extra


def place_batches(doc: np.ndarray, uid: np.ndarray, at: np.ndarray, buckets: int):
    """Places packed for the buckets of their documents."""
    order = np.lexsort((at, uid, doc))
    doc, uid, at = doc[order], uid[order], at[order]
    if len(order):
        bucket = bucket_of(t.mix(doc.view(np.uint64) ^ t.mix(uid.view(np.uint64))), buckets)
        yield to_batch(list(pack(bucket, buckets, doc, at, uid=uid)), PACKED_ARROW)


def told_apart(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, doc, uid, body): doc is doc_id with NO_ID for null; uid is a hash of the text where rows of its doc differ in text, else 0."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("uid"), F.col(text).alias("body"))
    several = materialise(rows.groupBy("doc").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low != high").select("doc", F.lit(True).alias("several")))
    if several.isEmpty():
        return rows.withColumn("uid", F.lit(0).cast("long"))
    return rows.join(several, "doc", "left").withColumn("uid", F.when(F.col("several"), F.col("uid")).otherwise(0)).drop("several")


def mark_windows(rows: DataFrame, window: int = 20) -> DataFrame:
    """Words of windows that also start earlier: rows (doc, uid, gone), gone the merged intervals start, end, start, end ...

    ``rows`` has the columns doc, uid and body.
    """
    buckets = parts(rows.sparkSession)

    def windows(batches):
        for batch in batches:
            doc, uid = ids(batch, "doc"), ids(batch, "uid")
            for lo, _, buf, offs in t.chunks(t.column(batch, "body")):
                starts, ends, first = t.words(buf, offs)
                at, which = t.window_starts(first, window)
                if len(at):
                    h, check = (t.range_hash(t.word_hashes(buf, starts, ends, codes), at, at + window) for codes in (t.BYTE_CODES, t.CHECK_CODES))
                    yield doc[lo + which], at - first[which], h, check, uid[lo + which]

    def hashed(batches):
        held, n = [], 0

        def sent():
            doc, at, h, check, uid = (np.concatenate(x) for x in zip(*held, strict=True))
            later, extra = later_places(doc, uid, at, h, check)
            yield from place_batches(doc[later], uid[later], at[later], buckets)
            yield to_batch(list(pack_held([tuple(x[~extra] for x in (doc, at, h, check, uid))], buckets)), PACKED_ARROW)

        for piece in windows(batches):
            held.append(piece)
            n += len(piece[0])
            if n >= FLUSH:
                yield from sent()
                held, n = [], 0
        if n:
            yield from sent()

    def repeated(batches):
        rows, known = [], []
        for r in packed_rows(batches):
            (rows if r[3] or not r[0] else known).append(r)
        if known:
            yield from place_batches(*unpack_all(known)[:3], buckets)
        doc, uid, at, h, check = unpack_wide(rows or [(b"",) * 4])
        later, _ = later_places(doc, uid, at, h, check)
        yield from place_batches(doc[later], uid[later], at[later], buckets)

    def merged(batches):
        doc, uid, at, _ = unpack_all(packed_rows(batches))
        order = np.lexsort((at, uid, doc))
        doc, uid, at = doc[order], uid[order], at[order]
        other = (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1])
        head = np.concatenate(([True], other | (at[1:] > at[:-1] + window)))[: len(doc)]
        tail = np.append(head[1:], True)[: len(doc)]
        doc, uid, pairs = doc[head], uid[head], np.stack((at[head], at[tail] + window), axis=1)
        head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1]))))[: len(doc)]
        edges = np.append(head, len(doc)).astype(np.int32)
        if len(head):
            yield pa.RecordBatch.from_arrays([pa.array(doc[head], pa.int64()), pa.array(uid[head], pa.int64()), pa.ListArray.from_arrays(pa.array(edges * 2), pa.array(pairs.ravel(), pa.int64()))], names=["doc", "uid", "gone"])

    dealt = rows.select("doc", "uid", "body").mapInArrow(hashed, PACKED).repartitionById(buckets, F.col("bucket")).mapInArrow(repeated, PACKED)
    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(merged, "doc long, uid long, gone array<long>")


def remove_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Each document without the words of windows that also start earlier.

    Returns (doc_id, n_words, n_removed, spans: removed word intervals [start, end), kept: the kept words joined by
    one space).
    """
    rows = told_apart(docs, doc_id, text)
    marks = mark_windows(rows, window)

    def removed(batches):
        for batch in batches:
            doc, marked = t.column(batch, "id"), t.column(batch, "gone")
            for lo, hi, buf, offs in t.chunks(t.column(batch, "body")):
                starts, ends, first = t.words(buf, offs)
                out = []
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    gone = np.zeros(b - a, bool)
                    if marked[lo + i].is_valid:
                        s, e = np.minimum(marked[lo + i].values.to_numpy().reshape(-1, 2), b - a).T
                        gone = t.covered(b - a, s, e)
                    s, e = t.spans(gone)
                    out.append((doc[lo + i].as_py(), int(b - a), int(gone.sum()), [{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)], joined(buf, starts[a:b][~gone], ends[a:b][~gone])))
                yield to_batch(out, REMOVED_ARROW)

    return rows.join(marks, ["doc", "uid"], "left").mapInArrow(removed, REMOVED).withColumnRenamed("doc", doc_id)


REMOVED = "doc long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
REMOVED_ARROW = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words at these places, joined by one space."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    to = np.cumsum(size) - size
    index = np.arange(size.sum()) + np.repeat(starts - to, size)
    out = buf[np.minimum(index, len(buf) - 1)]
    out[to + size - 1] = 0x20
    return out[:-1].tobytes()


