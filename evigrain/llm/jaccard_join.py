"""N-gram Jaccard join: token-combination prefixes over word shingles, then exact verification.

A document's set holds its distinct shingles of ``words`` words. Two documents link when
``100 * |intersection| >= percent * |union|``; ``near_duplicates`` gives each document the
smallest doc_id its links reach. The steps:

1. Equal sets collapse to a class, named by 64 bits of two sums over the set.
2. Shingles are counted over classes, packed by hash bucket as in ``window_dedup``. Each
   class gets back its shingles that occur in other classes too, rarest first. Only these
   can be shared, so one with too few of them links with nothing and drops out; the others
   ("active") need no text any more.
3. A few min-wise keys over the sets pair each active class with the smallest of those
   that share the key. Verified pairs give first components, which keep a large group of
   near copies from meeting itself pair by pair later.
4. Prefix index, exact: of each set ordered by rarity, the first ``n - ceil(t n) + 1``
   shingles hold one that any partner's prefix shares. Rare shingles of the prefix are
   keys of their own. Where the prefix reaches frequent ones (more than ``FREQUENT``
   classes), it is extended by ``CLASSES`` shingles: partners then share CLASSES + 1 of
   them, two of which fall in the same of CLASSES hash classes, so the keys are pairs of
   frequent shingles of one class. Sets too small for that use single shingles.
5. Components of step 3 that share a key are compared, set by set, and the links found
   join them. Sets of a key are ordered by size, since links need similar sizes; where none
   has more than ``CROWD`` others in reach, the key gives pairs of components. Otherwise its
   components are a crowd. Its sets are first held against some of them, the links
   found join components, and the keys are read again with these. The crowds that remain are
   compared among themselves; keys that overlap by half make one crowd.
6. Both sides of a comparison are dealt to tiles of ``TILE`` sets, so that a task reads
   two tiles at a time whatever the size of a group.

Identity: words by 64-bit hashes with a key for each place; 64 bits for sets (D distinct sets give about D^2 / 2^65 false merges in all); 48
bits and the bucket for shingles when counting, 48 bits when verifying.

Defined cases: null or wordless text: empty set, linked with nothing, component_id is its
own doc_id. Fewer words than a shingle: the whole sequence is the one shingle. Rows with
the same doc_id and different texts are documents of their own that share an id; each row
gets a result row. A null doc_id sorts before all others and stays null. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import components, materialise, parts, tile_labels
from .window_dedup import NO_ID, PACKED, PACKED_ARROW, bucket_of, ids, pack, pack_all, packed_rows, to_batch, unpack

FREQUENT = 64
CLASSES = 16
KEYS = 4
TILE = 512
CROWD = 24
CENTRES = 48
#: Sets below SMALL, or with fewer than CLASSES + 1 shingles to share, index single shingles only; those up to what can link with them do both.
SMALL = 23


def shingle_sets(batches, words: int):
    """(ids of the rows, row index, sorted distinct shingles) of each chunk of batches with ``doc``, ``uid`` and ``body``."""
    for batch in batches:
        doc = np.stack([ids(batch, c) for c in ("doc", "uid")], axis=1)
        for lo, hi, buf, offs in t.chunks(t.column(batch, "body")):
            starts, ends, first = t.words(buf, offs)
            at, which = t.window_starts(first, words)
            size = np.diff(first)
            short = np.flatnonzero((size > 0) & (size < words))
            begin = np.concatenate((at, first[:-1][short]))
            end = np.concatenate((at + words, first[1:][short]))
            which = np.concatenate((which, short))
            h = t.range_hash(t.word_hashes(t.LOWER[buf], starts, ends), begin, end) if len(begin) else np.zeros(0, np.uint64)
            order = np.lexsort((h, which))
            which, h = which[order], h[order]
            new = np.concatenate(([True], (which[1:] != which[:-1]) | (h[1:] != h[:-1])))[: len(h)]
            yield doc[lo:hi], which[new], h[new]


SETS = pa.schema([(c, pa.int64()) for c in ("doc", "uid", "n", "node")])


def class_names(rows: int, which: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, name) of each row's set."""
    total = [np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)]
    for i, s in enumerate(total):
        np.add.at(s, which, t.mix(h + np.uint64(i)))
    return np.bincount(which, minlength=rows), t.mix(total[0] ^ t.mix(total[1])).view(np.int64)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of a set of size n with any partner."""
    return -(-n * percent // 100)


def links(inter: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n + m - inter)


def tokens_of(b: bytes) -> np.ndarray:
    key = np.zeros((len(b) // 6, 8), np.uint8)
    key[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return key.view("<u8").ravel()


def compare(homes: list[tuple], visitors: list[tuple], percent: int):
    """Edges between the components whose sets link in a tile; rows are (component, n, tokens)."""
    sets = [tokens_of(h[2]) for h in homes]
    away, found = np.array([v[0] for v in visitors], np.int64), []
    lo = 0
    while lo < len(homes):  # as many homes at once as keep the grid small
        hi, total = lo + 1, len(sets[lo])
        while hi < len(homes) and (hi + 1 - lo) * (total + len(sets[hi])) <= GRID:
            total += len(sets[hi])
            hi += 1
        own, sizes = (np.array([h[i] for h in homes[lo:hi]], np.int64) for i in (0, 1))
        vocabulary, code = np.unique(np.concatenate(sets[lo:hi]), return_inverse=True)
        grid = np.zeros((len(vocabulary), hi - lo), np.uint8)
        grid[code, np.repeat(np.arange(hi - lo), [len(s) for s in sets[lo:hi]])] = 1
        same = np.zeros((len(visitors), hi - lo), bool)
        for i, (component, n, body) in enumerate(visitors):
            other = own != component
            if not other.any():
                continue
            mine = tokens_of(body)
            place = np.minimum(np.searchsorted(vocabulary, mine), len(vocabulary) - 1)
            inter = grid[place[vocabulary[place] == mine]].sum(axis=0, dtype=np.int64)
            same[i] = links(inter, n, sizes, percent) & other
        node, label = tile_labels(same, away, own)
        keep = node != label
        found.append(np.stack((node[keep], label[keep]), axis=1))
        lo = hi
    yield from map(tuple, np.unique(np.concatenate(found), axis=0).tolist())


GRID = 64 << 20
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def active_sets(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc, n, rare, tokens): classes that may link, tokens their shared shingles, the ``rare`` first ones rare."""
    buckets = parts(docs.sparkSession)

    def tokens(batches):
        def pieces():
            for doc, which, h in shingle_sets(batches, words):
                _, node = class_names(len(doc), which, h)
                once = np.zeros(len(node), bool)
                once[np.unique(node, return_index=True)[1]] = True
                which, h = which[once[which]], h[once[which]]
                yield node[which], np.zeros(len(h), np.int64), h

        yield from pack_all(pieces(), buckets)

    def shared(batches):
        doc, _, h = unpack(packed_rows(batches))
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))[: len(doc)]
        doc, h = doc[new], h[new]
        head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))[: len(h)]
        size = np.diff(np.append(head, len(h)))
        times = np.repeat(size, size)
        several = times > 1
        doc, h, times = doc[several], h[several], np.minimum(times[several], (1 << 31) - 1)
        order = np.lexsort((times, doc))
        if len(order):
            yield to_batch(list(pack(bucket_of(t.mix(doc[order].view(np.uint64)), buckets), buckets, doc[order], times[order], h[order])), PACKED_ARROW)

    def gathered(batches):
        doc, times, h = unpack(packed_rows(batches))
        order = np.lexsort((h, times, doc))
        doc, times, h = doc[order], times[order], h[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))[: len(doc)]
        doc, times, h = doc[new], times[new], h[new]
        head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))[: len(doc)]
        if not len(head):
            return
        rare = np.add.reduceat((times <= FREQUENT).astype(np.int64), head)
        edges = np.append(head, len(doc))
        key = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 2:])
        for lo in range(0, len(head), 1000):
            hi = min(lo + 1000, len(head))
            yield to_batch([(int(doc[head[i]]), int(rare[i]), key[edges[i] : edges[i + 1]].tobytes()) for i in range(lo, hi)], GATHERED)

    found = docs.mapInArrow(tokens, PACKED).repartitionById(buckets, F.col("bucket")).mapInArrow(shared, PACKED)
    found = found.repartitionById(buckets, F.col("bucket")).mapInArrow(gathered, "doc long, rare int, tokens binary")
    return found.join(sets, "doc").where(F.octet_length("tokens") * 100 >= F.col("n") * 6 * percent).select("doc", "n", "rare", "tokens")


GATHERED = pa.schema([("doc", pa.int64()), ("rare", pa.int32()), ("tokens", pa.binary())])


def first_links(active: DataFrame, percent: int) -> DataFrame:
    """Verified pairs (a, b) of documents with a common min-wise key."""

    def keyed(batches):
        for batch in batches:
            doc, key = [], []
            for d, body in zip(*(batch.column(c).to_pylist() for c in ("doc", "tokens")), strict=True):
                mine = tokens_of(body)
                for seed in range(KEYS):
                    doc.append(d)
                    key.append(int(t.mix(mine + np.uint64(seed)).min().view(np.int64)) if len(mine) else d)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64())], names=["doc", "key"])

    def verified(batches):
        for batch in batches:
            a, n, mine, b, m, other = (batch.column(c).to_pylist() for c in ("doc", "n", "tokens", "b", "m", "other"))
            inter = np.array([len(np.intersect1d(tokens_of(x), tokens_of(y), assume_unique=True)) for x, y in zip(mine, other, strict=True)], np.int64)
            hit = links(inter, np.array(n, np.int64), np.array(m, np.int64), percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)[hit]) for x in (a, b)], schema=PAIR)

    keys = active.mapInArrow(keyed, "doc long, key long")
    centre = keys.groupBy("key").agg(F.min("doc").alias("b"))
    wanted = keys.join(centre, "key").where("doc != b").groupBy("doc").agg(F.collect_set("b").alias("centres"))
    pairs = active.join(wanted, "doc").select("doc", "n", "tokens", F.explode("centres").alias("b"))
    other = active.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("other"))
    return pairs.join(other, "b").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).mapInArrow(verified, "a long, b long")


def index_keys(n: int, rare: int, mine: np.ndarray, percent: int) -> np.ndarray:
    """The keys of one set; see step 4 above."""
    prefix = n - int(needed(np.int64(n), percent)) + 1 - (n - len(mine))
    if prefix <= 0:
        return mine[:0]
    single = mine[: min(prefix, rare)]
    if prefix <= rare:
        return single
    small = max(SMALL, -(-100 * (CLASSES + 1) // percent))
    if n * percent <= small * 100:
        single = mine[:prefix]
    if n < small:
        return single
    often = mine[rare : prefix + CLASSES]
    kind = t.mix(often) % np.uint64(CLASSES)
    often = often[np.argsort(kind, kind="stable")]
    kind = np.sort(kind)
    pairs = []
    for d in range(1, len(often)):
        same = kind[d:] == kind[:-d]
        if not same.any():
            break
        x, y = often[:-d][same], often[d:][same]
        pairs.append(t.mix(np.minimum(x, y)) ^ t.mix(t.mix(np.maximum(x, y)) + np.uint64(1)))
    return np.concatenate((single, *pairs))


def contacts(active: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of components with a common index key, and the members (key, component, size) of crowded keys.

    ``active`` has a column component. The keys of one passage lie in many buckets and mostly have the same sets, so a bucket
    names each list of sets that meet (component and size) once, and pairs are made of the lists that differ. A list is short:
    a set has at most CROWD others in reach, so there are few of them for each size.
    """
    buckets = parts(active.sparkSession)

    def indexed(batches):
        def pieces():
            for batch in batches:
                comp, size, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for c, n, rare, body in zip(*(batch.column(x).to_pylist() for x in ("component", "n", "rare", "tokens")), strict=True):
                    got = t.mix(index_keys(n, rare, tokens_of(body), percent))
                    keys.append(got)
                    comp.append(np.full(len(got), c, np.int64))
                    size.append(np.full(len(got), n, np.int64))
                comp, size, keys = np.concatenate(comp), np.concatenate(size), np.concatenate(keys)
                order = np.lexsort((size, keys, comp))
                comp, size, keys = comp[order], size[order], keys[order]
                new = distinct(comp, size, keys)
                yield comp[new], size[new], keys[new]

        yield from pack_all(pieces(), buckets)

    def met(batches):
        comp, n, h = unpack(packed_rows(batches))
        order = np.lexsort((comp, n, h))
        comp, n, h = comp[order], n[order], h[order]
        new = distinct(comp, n, h)
        comp, n, h = comp[new], n[new], h[new]
        head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))[: len(h)]
        key = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
        # how many of its key follow that are not too long for it
        near = np.searchsorted(key * (1 << 32) + n, key * (1 << 32) + n * 100 // percent, "right") - np.arange(len(h)) - 1
        most, apart = near, near > 0
        if len(head):
            most, apart = np.maximum.reduceat(near, head), np.minimum.reduceat(comp, head) != np.maximum.reduceat(comp, head)
        crowd = most[key] > CROWD
        a, b = h[crowd].view(np.int64), comp[crowd]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = distinct(a, b)
        a, b = a[new], b[new]
        head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))[: len(a)]
        size = np.diff(np.append(head, len(a)))
        for lo in range(0, len(a), 1 << 16):
            rows = [pa.array(x[lo : lo + (1 << 16)], pa.int64()) for x in (a, b, np.repeat(size, size))]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(rows[0]), pa.binary())], names=MET)
        few = np.flatnonzero(apart & (most > 0) & (most <= CROWD))
        begin, end = np.searchsorted(key, few), np.searchsorted(key, few, "right")
        alike = sorted({comp[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(begin, end, strict=True)})
        for lo in range(0, len(alike), 1 << 12):
            sets = pa.array(alike[lo : lo + (1 << 12)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(sets), pa.int64()) for _ in MET[:-1]), sets], names=MET)

    def paired(batches):
        for batch in batches:
            pairs = [np.zeros((0, 2), np.int64)]
            for body in batch.column("sets").to_pylist():
                comp, n = np.frombuffer(body, np.int64).reshape(2, -1)
                near = np.searchsorted(n, n * 100 // percent, "right") - np.arange(len(n)) - 1
                x = np.repeat(np.arange(len(n)), near)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(near) - near, near)
                x, y = comp[x], comp[y]
                pairs.append(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1)[x != y])
            pairs = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs.T], schema=PAIR)

    found = materialise(active.mapInArrow(indexed, PACKED).repartitionById(buckets, F.col("bucket")).mapInArrow(met, MET_DDL))
    pairs = found.where("sets IS NOT NULL").select("sets").distinct().mapInArrow(paired, "a long, b long").distinct()
    return pairs, found.where("sets IS NULL").select("key", "component", "size")


MET = ["key", "component", "size", "sets"]
MET_DDL = "key long, component long, size long, sets binary"


def distinct(*sorted_by: np.ndarray) -> np.ndarray:
    """The first of each run of rows that are equal in all columns."""
    n = len(sorted_by[0])
    return np.concatenate(([True], np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)))[:n] if n else np.zeros(0, bool)


def crowds(members: DataFrame) -> DataFrame:
    """(key, component): the components of crowded keys, those of keys that overlap by half put together.

    Each key is held against one other: the largest that its smallest component has. If at least half of its components
    have that too, both make one crowd, so that the keys of one passage compare their sets once.
    """
    largest = members.groupBy("component").agg(F.max(F.struct("size", "key")).alias("top"))
    first = members.groupBy("key").agg(F.min("component").alias("component"))
    over = first.join(largest, "component").select("key", F.col("top.key").alias("over")).where("key != over")
    both = members.join(over, "key").join(members.select(F.col("key").alias("over"), "component"), ["over", "component"])
    merged = both.groupBy("key", "over", "size").agg(F.count("*").alias("common")).where("2 * common >= size")
    named = materialise(components(merged, "key", "over").select(F.col("node").alias("key"), F.col("component").alias("name")))
    return members.join(named, "key", "left").select(F.coalesce("name", "key").alias("key"), "component").distinct()


def dealt(c: str) -> Column:
    """How many tiles c sets make."""
    return F.ceil(F.col(c) / TILE).cast("int")


def own_tile(c: str) -> Column:
    return F.pmod(F.xxhash64("doc"), dealt(c)).cast("int")


def each_tile(c: str) -> Column:
    return F.explode(F.sequence(F.lit(0), dealt(c) - 1))


PLACE = ["crowd", "home", "i", "j"]
ROW = [*PLACE, "visits", "component", "n", "tokens"]


def linked(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between the components of homes and visitors that link in a tile; rows have the columns ROW."""

    def compared(batches):
        key, homes, visitors = None, [], []

        def done():
            if homes and visitors:
                yield from compare(homes, visitors, percent)

        for batch in batches:
            out = []
            for *place, visits, component, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != key or len(visitors) >= TILE:
                    out += done()
                    homes, visitors = homes if place == key else [], []
                    key = place
                (visitors if visits else homes).append((component, n, body))
            if out:
                yield to_batch(out, PAIR)
        if out := list(done()):
            yield to_batch(out, PAIR)

    rows = rows.select(*ROW).repartition(parts(rows.sparkSession), *PLACE).sortWithinPartitions(*PLACE, "visits")
    return rows.mapInArrow(compared, "a long, b long")


def crowd_links(active: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) found by holding every set of a crowd against about CENTRES of them, the same for all.

    Each component takes part in the largest crowd it is in. What these links join need not be compared any more, so
    that a group of near copies does not meet itself pair by pair.
    """
    top = members.groupBy("component").agg(F.max(F.struct("size", "key")).alias("top")).select("component", F.col("top.key").alias("home"))
    rows = materialise(active.join(top, "component").withColumn("crowd", F.lit(True)))
    size = rows.groupBy("home").agg(F.count("*").alias("k"))
    rows = rows.join(size, "home").withColumn("i", F.lit(0))
    centres = rows.where(F.pmod(F.xxhash64("doc", F.lit(1)), F.col("k")) < CENTRES).withColumns({"j": each_tile("k"), "visits": F.lit(False)})
    return linked(centres.select(*ROW).unionByName(rows.withColumns({"j": own_tile("k"), "visits": F.lit(True)}).select(*ROW)), percent)


def tile_links(active: DataFrame, pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components that met and have sets that link.

    A tile is named by (crowd, home, i, j): of a crowd, or of the component ``home`` and all that visit it.
    """
    size = materialise(active.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("k")))
    sized = pairs.join(size.select(F.col("c").alias("a"), F.col("k").alias("ka")), "a").join(size.select(F.col("c").alias("b"), F.col("k").alias("kb")), "b")
    swap = F.col("kb") > F.col("ka")
    sized = sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("home"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("component"), F.greatest("ka", "kb").alias("k"), F.least("ka", "kb").alias("v"))
    visited = sized.groupBy("home").agg(F.max("k").alias("k"), F.sum("v").alias("v"))
    homes = active.join(visited.withColumnRenamed("home", "component"), "component").withColumns({"crowd": F.lit(False), "home": F.col("component"), "i": own_tile("k"), "j": each_tile("v"), "visits": F.lit(False)})
    visitors = active.join(sized.drop("v", "k").join(visited, "home"), "component").withColumns({"crowd": F.lit(False), "i": each_tile("k"), "j": own_tile("v"), "visits": F.lit(True)})
    crowd = materialise(crowds(members))
    k = crowd.join(size.withColumnRenamed("c", "component"), "component").groupBy("key").agg(F.sum("k").alias("k"))
    within = active.join(crowd.join(k, "key"), "component").withColumns({"crowd": F.lit(True), "home": F.col("key"), "at": own_tile("k")}).withColumn("other", each_tile("k"))
    as_home = within.where("at <= other").withColumns({"i": F.col("at"), "j": F.col("other"), "visits": F.lit(False)})
    as_visitor = within.where("at >= other").withColumns({"i": F.col("other"), "j": F.col("at"), "visits": F.lit(True)})
    return linked(homes.select(*ROW).unionByName(visitors.select(*ROW)).unionByName(as_home.select(*ROW)).unionByName(as_visitor.select(*ROW)), percent)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(doc, uid, n, group, first) for each row of docs.

    doc is doc_id with NO_ID for null, uid a hash of doc_id and text, n the size of the set, group the same for all rows
    that links connect (null for an empty set), and first the smallest doc of the group.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(doc_id), F.col(text)).alias("uid"), F.col(text).alias("body"))

    def sized(batches):
        for doc, which, h in shingle_sets(batches, words):
            n, node = class_names(len(doc), which, h)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[:, 0], doc[:, 1], n, node)], schema=SETS)

    sets = materialise(rows.mapInArrow(sized, "doc long, uid long, n long, node long"))
    # written, so that Spark can split the joins at a very common set
    classes = materialise(sets.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("doc").alias("first")))
    active = materialise(active_sets(rows, classes.select(F.col("node").alias("doc"), "n"), words, percent))
    edges = materialise(first_links(active, percent))

    def marked():
        label = components(edges).select(F.col("node").alias("doc"), "component")
        return materialise(active.join(label, "doc", "left").withColumn("component", F.coalesce("component", "doc")))

    now = marked()
    pairs, members = contacts(now, percent)
    if not members.isEmpty():
        edges = materialise(edges.unionByName(crowd_links(now, members, percent)))
        now = marked()
        pairs, members = contacts(now, percent)
    label = components(edges.unionByName(materialise(tile_links(now, pairs, members, percent))))
    grouped = materialise(classes.join(label, "node", "left").select("node", "first", F.coalesce("component", "node").alias("group")))
    lowest = grouped.groupBy("group").agg(F.min("first").alias("first"))
    named = materialise(grouped.select("node", "group").join(lowest, "group"))
    empty = sets.where("n = 0").select("doc", "uid", "n", F.lit(None).cast("long").alias("group"), F.col("doc").alias("first"))
    return sets.where("n > 0").join(named, "node").select("doc", "uid", "n", "group", "first").unionByName(empty)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    found = groups(docs, doc_id, text, words, percent)
    return found.select(F.nullif("doc", F.lit(NO_ID)).alias(doc_id), F.col("n").alias("n_shingles"), F.nullif("first", F.lit(NO_ID)).alias("component_id"))
