"""Phrase collocation mining with stripes: each prefix keys an associative next-word counter.

A stripe is a row (lang, prefix, seg, nexts, counts, other): how often each next word
follows the prefix, and ``other``, how often none does that matters: the piece ends, or
the longer phrase can't be frequent. Level m counts phrases of m words as stripes of
prefixes of m - 1 words. A task reads its texts in spans of ``SPAN`` bytes, adds their phrases up and makes one
stripe a prefix of up to ``ENTRIES`` phrases; merging stripes adds them elementwise. A merged stripe gives all that is asked for: the frequent
extensions (its entries), the prefix's own frequency (its total, with ``other``) and the
largest extension to the right (its maximum), which decides subsumption; the largest
extension to the left is the maximum of the entries by what follows their first word.

A phrase can only be frequent if the phrases without its last and without its first word
are. Level m therefore looks both up in a bitmap of the frequent phrases of m - 1 words,
``BITS`` wide whatever the input (8 MB, broadcast). False positives of the bitmap are
counted and dropped, so it never changes a result.

Pairs of frequent words are many and mostly rare. Before level 2 every task therefore counts
its pairs in buckets by hash, each up to ``least``; only pairs whose bucket adds up to
``least`` over all tasks can be frequent and enter a stripe. There is a bucket for each
``least / 8`` words of the corpus, 2^COUNTERS at most (a bitmap of 32 MB, broadcast).

Stripes of short prefixes are long and frequent: they are cut into ``SEGMENTS`` by a hash of
the next word, so that no task gathers a whole stripe. A task sends all stripes of a hash
bucket in one row; merging takes a bucket, sorts its stripes and adds them up slice by slice.
The number of buckets is that of shuffle partitions, which the user sizes to the input.

Within a task's stripes, phrases are told apart by 64-bit hashes (D distinct phrases merge
falsely with D^2 / 2^65, under 1e-7 for ENTRIES); stripes merge by their strings.

Defined cases: null or empty texts have no words. A null lang is ``und``, together with
rows whose lang says so. Repeated rows count again. Ties in the ranking go by a and phrase.
A text is never cut: a long one is a span of its own. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as t
from .common import materialise, parts
from .window_dedup import bucket_of

SPAN = 4 << 20
BITS = 26
COUNTERS = 28
#: Counters to a row.
PART = 1 << 16
#: Spans that a task counts before it sends their counts on.
HELD = 8
#: Into how many pieces a stripe is cut, by the words of its prefix.
SEGMENTS = (1024, 32, 4, 4, 4)
#: Phrases that a task holds before it sends stripes on.
ENTRIES = 1 << 20
#: Stripes that are merged at once.
SLICE = 1 << 16

DELIMITER = t.byte_table(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
INSIDE = t.byte_table(lambda b: not (b in b" \t.,;:!?" or 0x0A <= b <= 0x0D))
STRIPE = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("seg", pa.int32()), ("nexts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("other", pa.int64())])
#: The stripes that a task sends to a bucket, in one row.
PACKED = pa.schema([("bucket", pa.int32()), *((f.name, pa.list_(f.type)) for f in STRIPE)])
PACKED_DDL = "bucket int, lang array<string>, prefix array<string>, seg array<int>, nexts array<array<string>>, counts array<array<long>>, other array<long>"
#: next is null in the row that sums a segment up: n is then its total, top its largest entry.
MERGED = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("next", pa.string()), ("n", pa.int64()), ("top", pa.int64())])
MERGED_DDL = "lang string, prefix string, next string, n long, top long"


def seeds(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    coded = langs.dictionary_encode()
    of = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    return of[coded.indices.to_numpy()]


def phrase_hashes(seed: np.ndarray, h: np.ndarray, words: int) -> np.ndarray:
    """The hash of the phrase of so many words that starts at each word, where so many follow."""
    n = max(len(h) - words + 1, 0)
    out = seed[:n].copy()
    for j in range(words):
        out = t.mix(out ^ h[j : n + j])
    return out


def assembled(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, words: int) -> pa.Array:
    """The phrases of so many words that start at the words ``at``, their words joined by one space."""
    place = (at[:, None] + np.arange(words)).ravel()
    space = np.tile(np.arange(words) < words - 1, len(at))
    size = ends[place] - starts[place] + space
    to = np.cumsum(size) - size
    index = np.arange(size.sum()) + np.repeat(starts[place] - to, size)
    data = buf[np.minimum(index, len(buf) - 1)]
    data[(to + size - 1)[space]] = 0x20
    offs = np.concatenate(([0], np.cumsum(size.reshape(len(at), words).sum(axis=1)))).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data)))


def is_set(bitmap: np.ndarray, h: np.ndarray, bits: int | None = None) -> np.ndarray:
    at = (h >> np.uint64(64 - (bits or BITS))).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Span:
    """The words of one span of whole texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, langs: pa.Array):
        self.buf = buf = t.LOWER[buf]
        self.starts, self.ends, first = t.words(buf, offs, INSIDE)
        cuts = np.concatenate(([0], np.cumsum(DELIMITER[buf])))
        self.text_of = text_of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        self.piece = np.cumsum(np.concatenate(([True], (cuts[self.starts[1:]] != cuts[self.ends[:-1]]) | (text_of[1:] != text_of[:-1])))[: len(text_of)])
        self.h, self.seed = t.word_hashes(buf, self.starts, self.ends), seeds(langs)[text_of]

    def extended(self, prefix: int, bitmap: np.ndarray):
        """(where a frequent phrase of ``prefix`` words starts, where the phrase a word longer can be frequent too, hashes of the phrases)."""
        own, piece, n = phrase_hashes(self.seed, self.h, prefix), self.piece, len(self.h)
        at = np.flatnonzero((piece[: len(own)] == piece[prefix - 1 : prefix - 1 + len(own)]) & is_set(bitmap, own))
        following = at[at + prefix < n]
        following = following[piece[following] == piece[following + prefix]]
        return at, following[is_set(bitmap, own[following + 1])], own

    def longer(self, own: np.ndarray, at: np.ndarray, prefix: int) -> np.ndarray:
        """The hashes of the phrases a word longer than own at these places."""
        return t.mix(own[at] ^ self.h[at + prefix])


class Entries:
    """Counted phrases of some spans: hashes of prefix and phrase, whether there is a next word, counts, and the texts of each."""

    def __init__(self, own, full, more, times, langs, prefixes, nexts):
        self.own, self.full, self.more, self.times, self.langs, self.prefixes, self.nexts = own, full, more, times, langs, prefixes, nexts

    @staticmethod
    def together(parts: list[Entries]) -> Entries:
        """The entries of several spans, equal ones added up."""
        own, full, more, times = (np.concatenate([getattr(p, c) for p in parts]) for c in ("own", "full", "more", "times"))
        _, pick, of = np.unique(full, return_index=True, return_inverse=True)
        total = np.zeros(len(pick), np.int64)
        np.add.at(total, of, times)
        texts = (pa.concat_arrays([getattr(p, c) for p in parts]).take(pa.array(pick)) for c in ("langs", "prefixes", "nexts"))
        return Entries(own[pick], full[pick], more[pick], total, *texts)


def span_entries(span: Span, langs: pa.Array, prefix: int, bitmap: np.ndarray | None, counted: tuple[int, np.ndarray] | None = None) -> Entries | None:
    """The phrases of one span; bitmap marks the frequent ones of ``prefix`` words, counted the hashes, to so many bits, of longer ones that can be frequent."""
    n = len(span.starts)
    if n < max(prefix, 1):
        return None
    if prefix == 0:
        at, own, more = np.arange(n), span.seed, np.ones(n, bool)
    else:
        at, following, own = span.extended(prefix, bitmap)
        if counted is not None:
            following = following[is_set(counted[1], span.longer(own, following, prefix), counted[0])]
        more = np.zeros(n, bool)
        more[following] = True
        more, own = more[at], own[at]
    if not len(at):
        return None
    # an end is told apart from every word by its own constant
    full = t.mix(own ^ np.where(more, span.h[np.minimum(at + prefix, n - 1)], np.uint64(0x5851F42D4C957F2D)))
    _, pick, times = np.unique(full, return_index=True, return_counts=True)
    at, own, more, full = at[pick], own[pick], more[pick], full[pick]
    words = assembled(span.buf, span.starts, span.ends, at[more] + prefix, 1)
    nexts = words.take(pa.array(np.where(more, np.cumsum(more) - 1, 0), mask=~more))
    _, first, of = np.unique(own, return_index=True, return_inverse=True)
    prefixes = assembled(span.buf, span.starts, span.ends, at[first], prefix) if prefix else pa.array([""] * len(first))
    return Entries(own, full, more, times.astype(np.int64), langs.take(pa.array(span.text_of[at])), prefixes.take(pa.array(of)), nexts)


def packed_stripes(parts: list[Entries], prefix: int, buckets: int) -> pa.RecordBatch:
    """The stripes of some spans, one for each prefix and segment, those of a bucket together in a row."""
    e = Entries.together(parts)
    seg = np.where(e.more, (e.full % np.uint64(SEGMENTS[prefix])).astype(np.int64), 0)
    bucket = bucket_of(t.mix(e.own + seg.astype(np.uint64)), buckets).astype(np.int64)
    order = np.lexsort((seg, e.own, bucket))
    own, more, seg, times, bucket = e.own[order], e.more[order], seg[order], e.times[order], bucket[order]
    head = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1]) | (seg[1:] != seg[:-1]))))
    edges = pa.array(np.concatenate(([0], np.cumsum(more)))[np.append(head, len(own))].astype(np.int32))
    heads, mine = pa.array(order[head]), pa.array(order[more])
    columns = [e.langs.take(heads), e.prefixes.take(heads), pa.array(seg[head], pa.int32()), pa.ListArray.from_arrays(edges, e.nexts.take(mine)), pa.ListArray.from_arrays(edges, pa.array(times[more])), pa.array(np.add.reduceat(np.where(more, 0, times), head).astype(np.int64))]
    bucket = bucket[head]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rows = pa.array(np.append(first, len(head)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), *(pa.ListArray.from_arrays(rows, c) for c in columns)], schema=PACKED)


def merge_slice(rows: pa.Table, least: int, last: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None]:
    """(merged rows of all stripes but the last, the last one as a stripe) of sorted stripes; of all and none, if ``last``."""
    rows = rows.combine_chunks()
    lang, prefix, seg, nexts, counts, other = (rows.column(c).combine_chunks() if rows.num_rows else None for c in STRIPE.names)
    change = np.zeros(rows.num_rows, bool)
    for c in (lang, prefix, seg):
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    key = np.cumsum(change)
    head = np.flatnonzero(np.concatenate(([True], change[1:])))
    size = pc.list_value_length(nexts).to_numpy()
    entries = pa.table({"key": np.repeat(key, size), "next": nexts.flatten(), "n": counts.flatten()}).group_by(["key", "next"]).aggregate([("n", "sum")])
    of, n = entries.column("key").to_numpy(), entries.column("n_sum").to_numpy()
    word = entries.column("next").combine_chunks()
    total, top = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
    np.add.at(total, of, n)
    np.maximum.at(top, of, n)
    rest = np.zeros(len(head), np.int64)
    np.add.at(rest, key, other.to_numpy())
    kept = None
    done = len(head)
    if not last:
        done -= 1
        mine = np.flatnonzero(of == done)
        edges = pa.array([0, len(mine)], pa.int32())
        kept = pa.RecordBatch.from_arrays([c.slice(head[done], 1) for c in (lang, prefix, seg)] + [pa.ListArray.from_arrays(edges, word.take(pa.array(mine))), pa.ListArray.from_arrays(edges, pa.array(n[mine])), pa.array(rest[done:], pa.int64())], schema=STRIPE)
    if not done:
        return None, kept
    often = np.flatnonzero((n >= least) & (of < done))
    heads = pa.array(head[:done])
    source = pa.array(np.concatenate((head[of[often]], head[:done])))
    columns = [lang.take(source), prefix.take(source), pa.concat_arrays([word.take(pa.array(often)), pa.nulls(len(heads), pa.string())]), pa.array(np.concatenate((n[often], (total + rest)[:done]))), pa.array(np.concatenate((np.zeros(len(often), np.int64), top[:done])))]
    return pa.RecordBatch.from_arrays(columns, schema=MERGED), kept


def spans(batches):
    """(Span, languages) of the texts of batches with lang and body."""
    for batch in batches:
        langs = t.column(batch, "lang")
        for lo, hi, buf, offs in t.chunks(t.column(batch, "body"), SPAN):
            own = langs.slice(lo, hi - lo)
            yield Span(buf, offs, own), own


def countable(docs: DataFrame, prefix: int, bitmap: np.ndarray, least: int, words: int) -> tuple[int, np.ndarray]:
    """(bits, bitmap of the hash buckets) in which ``least`` phrases a word longer than ``prefix`` fall; the corpus has so many words."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bitmap)
    bits = min(max((8 * words // least).bit_length(), 16), COUNTERS)
    kind = np.uint8 if least < 256 else np.uint32
    names = ["part", "places", "counts"]

    def packed(held):
        place, n = np.unique(np.concatenate(held), return_counts=True)
        n = np.minimum(n, least).astype(kind)
        edges = np.searchsorted(place, np.arange(0, (1 << bits) + 1, PART))
        low = (place % PART).astype("<u2")
        rows = [(part, low[a:b].tobytes(), n[a:b].tobytes()) for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)

    def counted(batches):
        held = []
        for span, _ in spans(batches):
            if len(span.h) > prefix:
                _, following, own = span.extended(prefix, sent.value)
                held.append((span.longer(own, following, prefix) >> np.uint64(64 - bits)).astype(np.int64))
                if len(held) >= HELD:
                    yield from packed(held)
                    held = []
        if held:
            yield from packed(held)

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, places, counts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                mine = total.setdefault(part, np.zeros(PART, np.uint32))
                at = np.frombuffer(places, "<u2")
                mine[at] = np.minimum(mine[at] + np.frombuffer(counts, kind), least)
        for part, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(n >= least, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    made = docs.mapInArrow(counted, "part int, places binary, counts binary").repartition(parts(spark), "part").mapInArrow(summed, "part int, bits binary")
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in made.collect():  # 2^bits / PART rows of 8 KB at most
        out[r["part"] * (PART >> 3) : (r["part"] + 1) * (PART >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return bits, out


def level(docs: DataFrame, prefix: int, bitmap: np.ndarray | None, least: int, counted: tuple[int, np.ndarray] | None = None) -> DataFrame:
    """Merged stripes of all prefixes of so many words; docs has lang and body."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((bitmap, counted))

    buckets = parts(spark)

    def stripes(batches):
        held, n = [], 0
        for span, langs in spans(batches):
            made = span_entries(span, langs, prefix, *sent.value)
            if made is not None:
                held.append(made)
                n += len(made.own)
            if n >= ENTRIES:
                held = [Entries.together(held)]
                n = len(held[0].own)
                if 2 * n >= ENTRIES:  # too little of it was equal
                    yield packed_stripes(held, prefix, buckets)
                    held, n = [], 0
        if held:
            yield packed_stripes(held, prefix, buckets)

    def merged(batches):
        rows = [pa.RecordBatch.from_arrays([t.column(batch, f.name).flatten().cast(f.type) for f in STRIPE], schema=STRIPE) for batch in batches]
        rows = pa.Table.from_batches(rows, schema=STRIPE).combine_chunks()
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("lang", "prefix", "seg")])
        kept, lo = None, 0
        while lo < len(order):
            some = rows.take(order.slice(lo, SLICE))
            lo += SLICE
            if kept is not None:
                some = pa.concat_tables([pa.Table.from_batches([kept]), some])
            out, kept = merge_slice(some, least, lo >= len(order))
            if out is not None:
                yield out

    return materialise(docs.mapInArrow(stripes, PACKED_DDL).repartitionById(buckets, F.col("bucket")).mapInArrow(merged, MERGED_DDL))


def frequent_bits(phrases: DataFrame, words: int) -> np.ndarray:
    """The bitmap of the phrases (lang, phrase), all of so many words."""

    def positions(batches):
        for batch in batches:
            buf, offs = t.raw_bytes(t.column(batch, "phrase"))
            starts, ends, first = t.words(buf, offs, INSIDE)
            h, out = t.word_hashes(buf, starts, ends), seeds(t.column(batch, "lang"))
            for j in range(words):
                out = t.mix(out ^ h[first[:-1] + j])
            yield pa.RecordBatch.from_arrays([pa.array((out >> np.uint64(64 - BITS)).astype(np.int64) + 1)], names=["place"])

    placed = phrases.mapInArrow(positions, "place long")
    blocks = placed.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bitmap = np.zeros(1 << BITS - 3, np.uint8)
    for r in blocks.collect():  # 2^BITS / 32768 rows of 4 KB at most
        at = (r["block"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``most`` words of each language."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("body"))
    levels, bitmap = [], None
    for words in range(1, most + 1):
        counted = None
        if words == 2:
            total = levels[0][0].where("next IS NULL").agg(F.sum("n")).first()[0] or 0
            counted = countable(rows, 1, bitmap, least, total)
        found = level(rows, words - 1, bitmap, least, counted)
        phrase = F.concat(F.col("prefix"), F.when(F.col("prefix") == "", "").otherwise(" "), F.col("next"))
        levels.append((found, found.where("next IS NOT NULL").select("lang", phrase.alias("phrase"), F.col("n").alias("a"))))
        if words < most:
            bitmap = frequent_bits(levels[-1][1].select("lang", "phrase"), words)
    sums = lambda found: found.where("next IS NULL").groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("n").alias("a"), F.max("top").alias("right"))
    size = sums(levels[0][0]).select("lang", F.col("a").alias("n"))
    shorter = sums(levels[1][0])
    for found, _ in levels[2:]:
        shorter = shorter.unionByName(sums(found))
    shorter = materialise(shorter.where(F.col("a") >= least))  # all frequent phrases below ``most`` words
    phrases = shorter.where("instr(phrase, ' ') > 0").unionByName(levels[-1][1].withColumn("right", F.lit(0).cast("long")))
    phrases = phrases if most > 1 else phrases.limit(0)
    left = phrases.groupBy("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase")).agg(F.max("a").alias("left"))
    kept = phrases.join(left, ["lang", "phrase"], "left").where("greatest(right, coalesce(left, 0)) < a").select("lang", "phrase", "a")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(F.split("phrase", " ")) - 1)))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    known = shorter.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cut = cut.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(size, "lang")
    score = F.expr("(1000 * cast(a AS decimal(18,0)) * cast(n AS decimal(18,0))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    by = [F.desc("score"), F.desc("a"), "phrase"]
    # a language's phrases are many: the first of each of several parts, then of those
    first = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts(docs.sparkSession))))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
