"""Suffix-array dedup of byte strings: breadth-first backward extension on a Burrows-Wheeler transform.

``repeats`` finds, in one block of strings, every position whose first ``least`` bytes
also start elsewhere in the block. It sorts the suffixes by their first bytes, takes the
Burrows-Wheeler transform and walks the intervals of all strings by growing length,
extending each to the left; the first interval to end at a place of the suffix array
fixes the common prefix there. The walk stops at ``least``: places it has not reached
have a longer common prefix.

The corpus is cut into such blocks by content. Each window of ``least`` bytes has an
anchor, the byte k-gram in it with the smallest hash, so equal windows have the same
anchor at the same offset. Consecutive windows with one anchor form a stretch, about 1.5
windows long. Stretches are the rows that Spark counts: equal ones (two hashes, one modulo
2^64 and one modulo the prime 2^61 - 1) collapse to one with a count, first within a task's
chunk of text, so that a passage in every document costs one row a chunk. A stretch with a
count above one is repeated as a whole and marked by that count; the transform finds what
repeats inside stretches that differ.

Different stretches of an anchor can share a window only if they agree on the
``(least - gram) / 2`` bytes before the anchor or on as many after it, since a window that
holds the anchor reaches that far on one side. Stretches carry a hash of either context;
only those that share one with a different stretch fetch their bytes and meet in a block.
A block takes whole anchors up to ``ROOM`` bytes, or one larger anchor. An anchor with more
bytes than ``hot`` goes another exact way: all its windows are hashed and counted.

Hashing holds some 15 arrays of 8 bytes a byte of text and the transform about as many a byte
of its block, so both work on a quarter of a MB at a time, and a task gives its memory back.

The joins with whole texts are merge joins at every size, by (doc, uid), and share one
shuffle of the texts.

Defined cases: null or empty text, or a text shorter than ``least``: nothing is removed.
Repeated rows (same doc_id and text) are different places, so their long texts go. Rows
with a null doc_id are documents like others. An empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as t
from .common import materialise, parts, releasing
from .window_dedup import NO_ID, to_batch

GRAM = 32
BLOCK = 1 << 20
#: Bytes of a block of several anchors, and of text hashed at a time.
ROOM = 1 << 18
SEGMENT = 1 << 18
#: A context that a stretch does not have. Left contexts end in the bits 11, right ones in 0.
NONE = np.int64(1)


def sums(codes: np.ndarray) -> np.ndarray:
    up, _ = t.powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], dtype=np.uint64, out=out[1:])
    return out


def hash_of(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return t.mix((total[ends] - total[starts]) * t.powers(len(total))[1][starts] + (ends - starts).astype(np.uint64))


def lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, ~np.uint64(0), dtype=np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def stretches(buf: np.ndarray, offs: np.ndarray, least: int, gram: int):
    """(text, start, length, anchor hash, two string hashes, left and right context) of the stretches in a chunk."""
    size = np.diff(offs)
    if not len(buf) or size.max() < least:
        return None
    first, second = sums(t.BYTE_CODES[buf]), t.PrimeHash(buf)
    at = np.arange(len(buf) - gram + 1)
    grams = hash_of(first, at, at + gram)
    keys = (grams >> np.uint64(28) << np.uint64(28)) | at.astype(np.uint64)
    best = (lowest(keys, least - gram + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
    n = np.maximum(size - (least - 1), 0)
    which = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - (np.cumsum(n) - n)[which] + offs[:-1][which]
    anchor = best[start]
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1]))))
    begin, end = start[head], start[np.append(head[1:], len(start)) - 1] + least
    which, anchor = which[head], anchor[head]
    side = (least - gram) // 2
    # a context that reaches beyond the stretch lies in none of its windows
    left = np.where(anchor - side >= begin, hash_of(first, np.maximum(anchor - side, begin), anchor).view(np.int64) | 3, NONE)
    right = np.where(anchor + gram + side <= end, hash_of(first, anchor + gram, np.minimum(anchor + gram + side, end)).view(np.int64) & ~1, NONE)
    return which, begin - offs[:-1][which], end - begin, grams[anchor].view(np.int64), hash_of(first, begin, end).view(np.int64), second.of(begin, end).view(np.int64), left, right


def collapsed(anchor: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """(first, known): the first row of each kind, and whether a row's kind has others among these rows."""
    order = np.lexsort((np.arange(len(h1)), h2, h1, anchor))
    a, x, y = anchor[order], h1[order], h2[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    first, known = np.empty(len(order), bool), np.empty(len(order), bool)
    first[order] = new
    known[order] = ~new | np.append(~new[1:], False)
    return first, known


def sort_suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their next ``depth`` codes (0 to 256), by prefix doubling."""
    n, known = len(codes), 7
    padded = np.concatenate((codes, np.zeros(known, codes.dtype))).astype(np.int64)
    key = padded[:n].copy()
    for i in range(1, known):
        key = (key << 9) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    key = key[order]
    rank[order] = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(n), 0))
    while known < depth:
        ranked = rank[order]
        tied = np.concatenate((ranked[1:] == ranked[:-1], [False]))
        tied[1:] |= tied[:-1]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        mine = order[places]
        later = np.where(mine + known < n, rank[np.minimum(mine + known, n - 1)] + 1, 0)
        key = ranked[places] * (n + 1) + later
        by = np.argsort(key, kind="stable")
        order[places], key = mine[by], key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        begin = np.maximum.accumulate(np.where(np.concatenate(([True], ranked[places][1:] != ranked[places][:-1])), np.arange(len(places)), 0))
        inside = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0)) - begin
        rank[order[places]] = ranked[places] + inside
        known *= 2
    return order


def long_prefixes(codes: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place of the suffix array but the first: is the prefix it shares with the one before ``least`` or longer?"""
    n = len(codes)
    last = codes[order - 1]
    by = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)
    step[by] = np.arange(n)
    front = codes[order]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for length in range(1, least + 1):
        size = hi - lo
        one = size == 1
        single = lo[one]
        if length > 1:
            single = single[last[single] != 0]
        new_lo, new_hi = [step[single]], [step[single] + 1]
        lo, size = lo[~one], size[~one]
        if len(lo):
            owner = np.repeat(np.arange(len(lo)), size)
            place = np.arange(len(owner)) - (np.cumsum(size) - size)[owner] + lo[owner]
            if length > 1:
                keep = last[place] != 0
                owner, place = owner[keep], place[keep]
            both = np.sort(owner * n + step[place])
            owner, to = np.divmod(both, n)
            if len(to):
                head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (front[to[1:]] != front[to[:-1]]))))
                new_lo.append(to[head])
                new_hi.append(to[np.append(head[1:], len(to)) - 1] + 1)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        live = unset[hi]
        lo, hi = lo[live], hi[live]
        unset[hi] = False
        if not len(lo):
            break
    return unset


def repeats(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string, whether each of its windows of ``least`` bytes also starts elsewhere among all of them."""
    buf, offs = t.raw_bytes(pa.array(strings, pa.large_binary()))
    codes = np.zeros(len(buf) + len(strings), np.int16)
    at = offs[:-1] + np.arange(len(strings))
    body = np.ones(len(codes), bool)
    body[offs[1:] + np.arange(len(strings))] = False
    codes[body] = buf.astype(np.int16) + 1
    order = sort_suffixes(codes, least)
    unset = long_prefixes(codes, order, least)
    found = np.empty(len(codes), bool)
    found[order] = unset[:-1] | unset[1:]
    return [found[a : a + max(0, len(s) - least + 1)] for a, s in zip(at, strings, strict=True)]


STRETCH = pa.schema([("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), *((c, pa.int64()) for c in ("anchor", "h1", "h2", "left", "right")), ("first", pa.bool_()), ("known", pa.bool_())])
STRETCH_DDL = "doc long, uid long, start long, size int, anchor long, h1 long, h2 long, left long, right long, first boolean, known boolean"
MARK = pa.schema([(n, pa.int64()) for n in ("doc", "uid", "begin", "end")])
MARK_DDL = "doc long, uid long, begin long, end long"


def segments(texts: pa.Array, least: int):
    """(row, offset in the row, buf, offs): chunks of whole texts, long texts in overlapping segments."""
    for lo, hi, buf, offs in t.chunks(texts, SEGMENT):
        rows = np.arange(lo, hi)
        if len(buf) <= SEGMENT:
            yield rows, np.zeros(hi - lo, np.int64), buf, offs
            continue
        for i in range(hi - lo):
            for a in range(offs[i], max(offs[i] + 1, offs[i + 1] - least + 1), SEGMENT):
                piece = buf[a : min(a + SEGMENT + least - 1, offs[i + 1])]
                yield rows[i : i + 1], np.array([a - offs[i]]), piece, np.array([0, len(piece)])


def blocks(batches, rows: int = 1000):
    """Lists of rows with whole anchors (the first column; rows of one anchor follow each other), of ROOM bytes (the last column) or one anchor."""
    block, size, own, more = [], 0, [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            for r in zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True):
                if own and r[0] != own[-1][0]:
                    if block and size + more > ROOM:
                        yield block
                        block, size = [], 0
                    block.extend(own)
                    size, own, more = size + more, [], 0
                own.append(r)
                more += len(r[-1])
    if block and size + more > ROOM:
        yield block
        block = []
    if block or own:
        yield block + own


def find_repeats(rows: DataFrame, least: int = 400, gram: int = GRAM, hot: int = BLOCK) -> DataFrame:
    """Byte ranges covered by repeated strings: rows (doc, uid, begin, end); ranges can overlap.

    ``rows`` has the columns doc, uid and body; uid tells rows of the same doc_id apart. They are all kept up to the
    join with the texts, so that the caller's own join by (doc, uid) can use the same shuffled rows.
    """

    def places_of(held):
        found = [np.concatenate(x) for x in zip(*held, strict=True)]
        found += collapsed(*found[4:7])
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, STRETCH, strict=True)], schema=STRETCH)

    def cut(batches):
        for batch in batches:
            doc, uid = (t.column(batch, c).to_numpy() for c in ("doc", "uid"))
            held, size = [], 0
            for row, base, buf, offs in segments(t.column(batch, "body"), least):
                if (got := stretches(buf, offs, least, gram)) is not None:
                    which, start, n, *rest = got
                    held.append((doc[row[which]], uid[row[which]], start + base[which], n.astype(np.int32), *rest))
                size += len(buf)
                if held and size >= t.CHUNK:
                    yield places_of(held)
                    held, size = [], 0
            if held:
                yield places_of(held)

    def fetch(batches):
        for batch in batches:
            buf, offs = t.raw_bytes(t.column(batch, "body"))
            out = [
                (w["anchor"], doc, uid, w["start"], w["n"], buf[a + w["start"] : a + w["start"] + w["size"]].tobytes())
                for a, doc, uid, wanted in zip(offs[:-1], *(batch.column(c).to_pylist() for c in ("doc", "uid", "wanted")), strict=True)
                for w in wanted
            ]
            for i in range(0, len(out), 2000):
                yield to_batch(out[i : i + 2000], FETCHED)

    def marks(group, found):
        for (_, doc, uid, start, n, _), hit in zip(group, found, strict=True):
            if n == 1 and hit.any():
                for a, b in zip(*t.spans(hit), strict=True):
                    yield doc, uid, start + int(a), start + int(b) - 1 + least

    def extend(batches):
        for group in blocks(batches):
            if out := list(marks(group, repeats([g[-1] for g in group], least))):
                yield to_batch(out, MARK)

    def each_window(batches):
        """The hash of every window of a hot anchor's stretches."""
        for batch in batches:
            for a, doc, uid, start, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buf = np.frombuffer(body, np.uint8)
                at = np.arange(len(buf) - least + 1)
                one, two = hash_of(sums(t.BYTE_CODES[buf]), at, at + least).view(np.int64), t.PrimeHash(buf).of(at, at + least).view(np.int64)
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.full(k, a), np.full(k, doc), np.full(k, uid), at + start, np.full(k, n), one, two), WINDOW, strict=True)], schema=WINDOW)

    buckets = parts(rows.sparkSession)
    key = ["anchor", "h1", "h2"]
    places = rows.select("doc", "uid", "body").mapInArrow(releasing(cut), STRETCH_DDL)
    # one shuffle: by anchor, or anywhere for the rows that others of their chunk stand for
    dealt = F.when(F.col("first"), F.col("anchor")).otherwise(F.xxhash64("uid", "start"))
    places = places.withColumn("at", dealt).repartition(buckets, "at").withColumn("times", F.count(F.when(F.col("first"), 1)).over(Window.partitionBy("at")))
    places = materialise(places.where("known OR first AND times > 1").drop("at", "times"))
    kinds = places.where("first").groupBy(*key).agg(F.count("*").alias("times"), F.max("known").alias("known"), F.min(F.struct("doc", "uid", "start", "size", "left", "right")).alias("place"))
    kinds = materialise(kinds.select(*key, (F.col("known") | (F.col("times") > 1)).alias("copied"), "place.*"))
    context = F.explode(F.array("left", "right")).alias("context")
    shared = kinds.select("anchor", context).where(F.col("context") != int(NONE)).groupBy("anchor", "context").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", "context")
    wanted = kinds.select("*", context).join(shared, ["anchor", "context"], "left_semi").drop("context").dropDuplicates(key)
    wanted = materialise(wanted.select("doc", "uid", F.struct("anchor", "start", "size", F.when(F.col("copied"), 2).otherwise(1).cast("long").alias("n")).alias("w")))
    several = wanted.groupBy("w.anchor").agg(F.sum(F.col("w.size").cast("long")).alias("total"))
    wanted = wanted.groupBy("doc", "uid").agg(F.collect_list("w").alias("wanted"))
    texts = rows.join(wanted.hint("merge"), ["doc", "uid"]).select(*rows.columns, "wanted").mapInArrow(releasing(fetch), FETCHED_DDL)
    span = [F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end")]
    copies = places.where("NOT known").join(kinds.where("copied").select(*key), key).select("doc", "uid", *span)
    copies = copies.unionByName(places.where("known").select("doc", "uid", *span))
    crowded = several.where(F.col("total") > hot).select("anchor")
    if crowded.isEmpty():
        few = texts
    else:
        texts = materialise(texts)
        few = texts.join(crowded, "anchor", "left_anti")
        windows = texts.join(crowded, "anchor", "left_semi").mapInArrow(releasing(each_window), WINDOW_DDL)
        counted = windows.groupBy(*key).agg(F.count("*").alias("kinds")).where("kinds > 1")
        many = windows.where("n = 1").join(counted, key).select("doc", "uid", F.col("start").alias("begin"), (F.col("start") + least).alias("end"))
        copies = copies.unionByName(many)
    few = few.repartition(buckets, "anchor").sortWithinPartitions("anchor").mapInArrow(releasing(extend), MARK_DDL)
    return few.unionByName(copies)


FETCHED = pa.schema([*((c, pa.int64()) for c in ("anchor", "doc", "uid", "start", "n")), ("body", pa.binary())])
FETCHED_DDL = "anchor long, doc long, uid long, start long, n long, body binary"
WINDOW = pa.schema([(c, pa.int64()) for c in ("anchor", "doc", "uid", "start", "n", "h1", "h2")])
WINDOW_DDL = ", ".join(f"{f.name} long" for f in WINDOW)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 400, gram: int = GRAM, hot: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document without the bytes of strings of ``least`` bytes that also start elsewhere.

    Returns (doc_id, n_bytes, n_removed, spans: removed byte intervals [start, end), kept: the remaining bytes,
    kept_text: the same as text, with the characters whole that a span cuts), and the columns named in ``carry``.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("uid"), F.col(text).alias("body"), F.struct(F.lit(0).alias("_"), *carry).alias("rest"),
    )
    found = find_repeats(rows, least, gram, hot)
    found = found.groupBy("doc", "uid").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))

    def removed(batches):
        for batch in batches:
            marks, rest = t.column(batch, "marks"), t.column(batch, "rest")
            for lo, hi, buf, offs in t.chunks(t.column(batch, "body")):
                out = []
                for i in range(hi - lo):
                    own = buf[offs[i] : offs[i + 1]]
                    gone = np.zeros(len(own), bool)
                    if marks[lo + i].is_valid:
                        m = marks[lo + i].values
                        gone = t.covered(len(own), *(m.field(k).to_numpy() for k in ("begin", "end")))
                    s, e = t.spans(gone)
                    kept = own[~gone].tobytes()
                    if len(s):
                        whole = (own & 0xC0) != 0x80
                        char = np.cumsum(whole) - 1
                        full = np.ones(int(whole.sum()), bool)
                        full[char[~gone]] = False
                        shown = own[~full[char]].tobytes()
                    else:
                        shown = kept
                    out.append((len(own), int(gone.sum()), [{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)], kept, shown.decode("utf-8", "replace")))
                made = to_batch(out, REMOVED)
                yield pa.RecordBatch.from_arrays([t.column(batch, "id").slice(lo, hi - lo), *made.columns, rest.slice(lo, hi - lo)], names=["id", *REMOVED.names, "rest"])

    joined = rows.join(found.hint("merge"), ["doc", "uid"], "left")
    kind = joined.schema["rest"].dataType.simpleString()
    got = joined.select("id", "doc", "uid", "body", "rest", "marks").mapInArrow(releasing(removed), f"id long, {REMOVED_DDL}, rest {kind}")
    return got.select(F.col("id").alias(doc_id), *REMOVED.names, *(F.col(f"rest.{c}").alias(c) for c in carry))


REMOVED = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("kept_text", pa.string())])
REMOVED_DDL = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_text string"
