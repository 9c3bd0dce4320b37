"""Centroid clustering over space-filling-curve zone maps, in exact integers.

Components become integers, ``floor(scale * x)``. Vectors are ordered by their place on a
Hilbert curve (``LEVELS`` bits a component, by how far it is from its mean) and cut into
blocks of ``BLOCK`` with the smallest and largest value of each component. A round sends the
centroids to all tasks. For each block the box gives bounds of every centroid's distance;
those whose lower bound exceeds another's upper bound are out, and only the rest are
compared with the block's vectors, exactly. A task returns one row, the count and component
sums of all clusters, and ``FEW`` tasks add these rows up; the driver holds the centroids and
as many sums. Sums are kept in two halves of ``LIMB`` bits and more, exact for 2^32 vectors of
the largest size and for 2^50 of ordinary ones.

The curve only decides which vectors share a block, never a result. Vectors at one place of
the curve are spread by a hash of id and vector, so that equal vectors don't meet in one
task.

Defined cases: a null vector, one with another number of components than ``size``, and one
with null or non-finite components is left out. Rows with the same or no vec_id are separate
vectors; ties for a first centroid go to the smaller vector, null ids come last. With fewer
vectors than clusters there are as many clusters as vectors. Integers saturate at 2^62 and
distances and their sums at 2^63 - 1; large ones are compared as Python integers. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import materialise, parts

BLOCK = 256
LEVELS = 2
MOST = (1 << 63) - 1
#: Below this size, squared distances of 64 components fit 64 bits.
SAFE = 1 << 26
LIMB = 31
#: Tasks that add up the rows of all tasks.
FEW = 16


def added_up(rows: DataFrame, kind: str) -> np.ndarray | None:
    """The sum of the arrays of a kind in rows of one binary column, as Python integers if they are such."""

    def add(batches):
        total = None
        for batch in batches:
            for body in batch.column(0):
                x = np.frombuffer(body.as_buffer(), kind)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["body"])

    got = [np.frombuffer(r["body"], kind) for r in rows.repartition(FEW).mapInArrow(add, "body binary").collect()]  # FEW rows at most
    return sum(x.astype(object) if kind == "<i8" else x for x in got) if got else None


def one_row(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["body"])


def hilbert_keys(places: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of each row of coordinates of so many bits, as rows of bytes, first byte first.

    Skilling's transform, on all rows at once.
    """
    x = places.T.astype(np.uint64)
    level = 1 << (bits - 1)
    while level > 1:
        low = np.uint64(level - 1)
        for row in x:
            flip = row & np.uint64(level) > 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ row) & low)
            row ^= swap
            x[0] ^= np.where(flip, low, swap)
        level >>= 1
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint64(b) & np.uint64(1) > 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    return np.packbits(np.concatenate([(x >> np.uint64(b) & np.uint64(1)).T.astype(np.uint8) for b in range(bits - 1, -1, -1)], axis=1), axis=1)


def exact(*arrays: np.ndarray):
    """The arrays in a type in which squared distances are exact."""
    if all(not a.size or max(-int(a.min()), int(a.max())) < SAFE for a in arrays) and arrays[0].shape[-1] <= 256:
        return arrays
    return tuple(a.astype(object) for a in arrays)


def near_centroids(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that can be nearest to a vector of the box."""
    low, high, centroids = exact(low, high, centroids)
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(abs(below), abs(above)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number of equals."""
    some = near_centroids(low, high, centroids)
    x, c = exact(x, centroids[some])
    d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    best = d.argmin(axis=1)
    return some[best], d[np.arange(len(x)), best]


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, size: int, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, as integers."""
    limit = float(1 << 62)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
    good = F.col("x").isNotNull() & (F.size("x") == size) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.coalesce(good, F.lit(False))).select("id", F.transform("x", lambda v: F.floor(F.greatest(F.least(v * float(scale), F.lit(limit)), F.lit(-limit)))).alias("v"))


def matrix(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    return t.column(batch, name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("body", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])
BLOCKS_DDL = "ids array<long>, body binary, low array<long>, high array<long>"


def zone_maps(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of neighbours on the curve, with their boxes."""
    spark = rows.sparkSession

    def measured(batches):
        total = np.zeros((3, size))
        for batch in batches:
            x = matrix(batch, "v", size).astype(np.float64)
            total += [np.full(size, len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
        yield one_row(total)

    total = added_up(rows.select("v").mapInArrow(measured, "body binary"), "<f8")
    n, sums, squares = np.zeros((3, size)) if total is None else total.reshape(3, size)
    mean = sums / np.maximum(n, 1)
    by = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean * mean, 0))
    steps = spark.sparkContext.broadcast([mean + by * z for z in np.linspace(-1, 1, (1 << LEVELS) - 1)])

    def placed(batches):
        for batch in batches:
            x = matrix(batch, "v", size)
            keys = hilbert_keys(sum((x > step).astype(np.uint64) for step in steps.value), LEVELS) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([t.column(batch, "id"), t.column(batch, "v"), pa.array([k.tobytes() for k in keys], pa.binary())], names=["id", "v", "key"])

    def cut(batches):
        for batch in batches:
            x, ids = matrix(batch, "v", size), t.column(batch, "id")
            out = [(ids.slice(a, BLOCK).to_pylist(), x[a : a + BLOCK].tobytes(), x[a : a + BLOCK].min(axis=0), x[a : a + BLOCK].max(axis=0)) for a in range(0, len(x), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), BLOCKS, strict=True)], schema=BLOCKS) if out else pa.RecordBatch.from_pylist([], BLOCKS)

    ordered = rows.mapInArrow(placed, "id long, v array<long>, key binary").withColumn("salt", F.xxhash64("id", "v"))
    ordered = ordered.repartitionByRange(parts(spark), "key", "salt").sortWithinPartitions("key", "salt").select("id", "v")
    return materialise(ordered.mapInArrow(cut, BLOCKS_DDL))


def assigned(batches, centroids: np.ndarray):
    """(ids, vectors, cluster, distance) of each block."""
    size = centroids.shape[1]
    for batch in batches:
        low, high = matrix(batch, "low", size), matrix(batch, "high", size)
        for ids, body, lo, hi in zip(batch.column("ids"), batch.column("body"), low, high, strict=True):
            x = np.frombuffer(body.as_buffer(), np.int64).reshape(-1, size)
            yield ids.values, x, *nearest(x, lo, hi, centroids)


def next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters; a cluster without vectors keeps its centroid."""
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)

    def summed(batches):
        now = sent.value
        high, low, n = np.zeros(now.shape, np.int64), np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for _, x, cluster, _ in assigned(batches, now):
            for c in np.unique(cluster):
                own = x[cluster == c]
                high[c] += (own >> LIMB).sum(axis=0)
                low[c] += (own & ((1 << LIMB) - 1)).sum(axis=0)
                n[c] += len(own)
        yield one_row(np.concatenate((n, high.ravel(), low.ravel())))

    total = added_up(blocks.mapInArrow(summed, "body binary"), "<i8")
    out = centroids.copy()
    if total is not None:
        n, halves = total[: len(centroids)], total[len(centroids) :].reshape(2, *centroids.shape)
        for c in np.flatnonzero(n > 0):
            out[c] = ((halves[0, c] << LIMB) + halves[1, c]) // n[c]
    return out


def first_centroids(rows: DataFrame, clusters: int, seed: str, size: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in order of these."""
    drawn = rows.select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(clusters)
    return np.array([r["v"] for r in drawn.collect()], np.int64).reshape(-1, size)


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int = 64, clusters: int = 8, rounds: int = 10, seed: str = "3:", scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part."""
    rows = integer_vectors(vectors, vec_id, embedding, size, scale)
    centroids = first_centroids(rows, clusters, seed, size)
    blocks = zone_maps(rows, size)
    for _ in range(rounds):
        centroids = next_centroids(blocks, centroids) if len(centroids) else centroids
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)

    def last(batches):
        for ids, _, cluster, distance in assigned(batches, sent.value):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(np.minimum(distance, MOST).astype(np.int64))], names=["id", "cluster", "distance"])

    got = materialise(blocks.mapInArrow(last, "id long, cluster int, distance long"))
    sums = [0] * max(len(centroids), 1)
    for r in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).toLocalIterator():  # a row for each cluster
        sums[r["cluster"]] = int(r["d"])
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()] or [""]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    inertia = of([min(s, MOST) for s in sums]).cast("long")
    return got.select(F.col("id").alias(vec_id), "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(min(sum(sums), MOST)).cast("long").alias("inertia"), of(names).alias("centroid_sha256"))
