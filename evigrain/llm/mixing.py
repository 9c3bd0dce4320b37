"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, document after document, are packed into blocks of ``block`` words.
The mix is a sequence of slots, dealt to output shards of ``shard`` slots; a slot holds
one block. Per shard, source counts are drawn from a multinomial distribution (one hashed
draw per slot). Slots of a source are numbered through all shards; slot j takes block
perm(j mod N) of the source's N blocks, perm being a pseudorandom index permutation
(an affine map, coprime to N) of the source and of the pass j div N. Joining blocks to
slots by index gives the mix, ``Mix.slots`` and ``Mix.pieces``.

Plain draws miss the targets by chance and could repeat a block a fourth time, so the last
slots of over-drawn sources are handed to the under-drawn ones: each source gets exactly
the whole number of blocks nearest to its target.

The numbering needs no sort of a whole source: sums per hash bucket of documents, and per
group of shards, come first. The table of sources (name, weight, size) is held by the
driver: like the weights it belongs to the mix's settings.

Defined cases: null or wordless text has size 0 and takes nothing. Null is a source of its
own, last in order. Rows with the same doc_id are separate. Equal rows take what their
place in the order gives them; results don't depend on the input's order. Empty tables
give an empty mix. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents to a hash bucket of one source, shards to a group; only sizes of tasks.
BUCKET, GROUP = 1000, 1024
REPEATS = 3


@dataclass
class Source:
    sid: int
    name: str | None
    size: int
    weight: float
    target: float = 0.0
    blocks: int = 0
    slots: int = 0


@dataclass
class Mix:
    #: (row, doc_id, sid, size, at): documents with their place in their source's words
    docs: DataFrame
    #: (shard, sid, slot, block): the slots of each source, numbered through all shards
    slots: DataFrame
    #: (row, doc_id, sid, block, n): the words of each document in each block
    pieces: DataFrame
    sources: list[Source]


def fill(sources: list[Source], repeats: int = REPEATS) -> None:
    """Targets by weight, none above ``repeats`` times its source; what is cut goes to the others by weight."""
    left, weight = float(sum(s.size for s in sources)), float(sum(s.weight for s in sources))
    for s in sorted(sources, key=lambda s: (repeats * s.size / s.weight, s.sid)):
        s.target = min(float(repeats * s.size), left * s.weight / weight)
        left, weight = left - s.target, weight - s.weight


def lookup(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds are at most x, by bisection written out as nested conditions."""

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= bounds[mid], within(mid + 1, hi)).otherwise(within(lo, mid))

    return within(0, len(bounds))


def affine(sid: int, turn: int, n: int, seed: int) -> tuple[int, int]:
    """Factor and offset of a permutation of range(n)."""
    h = int.from_bytes(hashlib.sha256(f"{seed}/{sid}/{turn}".encode()).digest()[:8], "big")
    a = 1 + h % (min(max(n, 2), 1 << 24) - 1)
    while math.gcd(a, n) != 1:
        a += 1
    return a, (h >> 24) % max(n, 1)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=(1.0, 2.0, 3.0), block: int = 64, shard: int = 4096, seed: int = 1) -> Mix:
    """Plan a mix as long as the corpus. ``weights``: repeated over the sources in code-point order, null last."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    sized = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(body, F.lit(WORDS)).cast("long").alias("size"), F.xxhash64(body).alias("tie")))
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row for each source
    names = sorted((r for r in found), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sources = [Source(i, r["source"], r["size"], weights[i % len(weights)]) for i, r in enumerate(names)]
    if sources:
        fill(sources)
    for s in sources:
        s.blocks = -(-s.size // block)
        s.slots = min(math.floor(s.target / (s.size / s.blocks) + 0.5), REPEATS * s.blocks) if s.blocks else 0
    total = sum(s.slots for s in sources)
    buckets = max(1, sum(r["n"] for r in found) // BUCKET)

    # documents' places in their sources
    listed = spark.createDataFrame([(s.sid, s.name) for s in sources], "sid int, source string")
    placed = sized.join(F.broadcast(listed.withColumnRenamed("source", "name")), sized["source"].eqNullSafe(F.col("name")))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    before = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    before = before.select("sid", "bucket", (F.sum("s").over(W.partitionBy("sid").orderBy("bucket")) - F.col("s")).alias("before"))
    order = W.partitionBy("sid", "bucket").orderBy("doc_id", "size", "tie")
    placed = placed.withColumn("run", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("turn", F.row_number().over(order))
    placed = placed.join(before, ["sid", "bucket"]).select(F.struct("sid", "bucket", "turn").alias("row"), "doc_id", "sid", "size", (F.col("before") + F.col("run")).alias("at"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").select("row", "doc_id", "sid", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    pieces = pieces.select("row", "doc_id", "sid", "block", (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)).alias("n"))

    # multinomial counts per shard
    ends = [sum(s.slots for s in sources[: i + 1]) for i in range(len(sources))]
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1)))
    drawn = spark.range(total).select(F.floor(F.col("id") / shard).alias("shard"), (lookup(ends[:-1], draw) if sources else F.lit(0)).alias("sid"))
    counts = materialise(drawn.groupBy("shard", "sid").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("shard") / GROUP)))
    groups = counts.groupBy("sid", "group").agg(F.sum("n").alias("s"))
    groups = groups.select("sid", "group", (F.sum("s").over(W.partitionBy("sid").orderBy("group")) - F.col("s")).alias("before"))
    inside = F.sum("n").over(W.partitionBy("sid", "group").orderBy("shard")) - F.col("n")
    counts = counts.withColumn("inside", inside).join(groups, ["sid", "group"]).select("shard", "sid", "n", (F.col("before") + F.col("inside")).alias("slot"))
    got = {r["sid"]: r["c"] for r in counts.groupBy("sid").agg(F.sum("n").alias("c")).collect()}

    # hand what sources drew beyond their slots to those that drew too few
    more, less, over, under = [], [], 0, 0
    for s in sources:
        c = got.get(s.sid, 0)
        more.append((s.sid, s.slots, over - s.slots))
        over += max(0, c - s.slots)
        if c < s.slots:
            less.append((s.sid, under, under + s.slots - c, c - under))
            under += s.slots - c
    bounds = spark.createDataFrame(more, "sid int, slots long, shift long")
    counts = counts.join(F.broadcast(bounds), "sid")
    kept = counts.select("shard", "sid", "slot", F.least(F.col("n"), F.greatest(F.col("slots") - F.col("slot"), F.lit(0))).alias("n")).where("n > 0")
    if less:
        lo, hi = F.greatest("slot", "slots") + F.col("shift"), F.col("slot") + F.col("n") + F.col("shift")
        spare = counts.where("slot + n > slots").select("shard", lo.alias("lo"), hi.alias("hi"))
        table = F.array(*(F.struct(F.lit(d).alias("sid"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c")) for d, a, b, c in less))
        spare = spare.select("shard", "lo", "hi", F.explode(F.filter(table, lambda d: (d["a"] < F.col("hi")) & (d["b"] > F.col("lo")))).alias("d"))
        given = spare.select("shard", "d.sid", (F.greatest("lo", "d.a") + F.col("d.c")).alias("slot"), (F.least("hi", "d.b") - F.greatest("lo", "d.a")).alias("n"))
        kept = kept.unionByName(given)

    # slots to blocks by the permutation of each source and pass
    maps = [(s.sid, s.blocks, [list(affine(s.sid, turn, s.blocks, seed)) for turn in range(REPEATS)]) for s in sources if s.blocks]
    perms = spark.createDataFrame(maps, "sid int, blocks long, perm array<array<long>>")
    slots = kept.select("shard", "sid", F.explode(F.sequence("slot", F.col("slot") + F.col("n") - 1)).alias("slot")).join(F.broadcast(perms), "sid")
    perm = F.get("perm", F.floor(F.col("slot") / F.col("blocks")).cast("int"))
    slots = slots.select("shard", "sid", "slot", F.pmod(F.get(perm, F.lit(0)) * F.pmod("slot", "blocks") + F.get(perm, F.lit(1)), F.col("blocks")).alias("block"))
    return Mix(placed, slots, pieces, sources)


def taken(plan: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document: the words the mix takes of it, repeats counted."""
    times = plan.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    words = plan.pieces.join(times, ["sid", "block"]).groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    table = plan.docs.sparkSession.createDataFrame([(s.sid, s.size, s.target) for s in plan.sources], "sid int, source_size long, target double")
    got = plan.docs.join(words, "row", "left").join(F.broadcast(table), "sid")
    return got.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
