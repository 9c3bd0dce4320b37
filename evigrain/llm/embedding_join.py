"""Embedding near-dedup: exact metric range join on unit vectors.

Cosine ``least`` between unit vectors is Euclidean distance ``eps = sqrt(2 - 2 least)``.
Pivots (vectors with the smallest hashes, up to ``PIVOTS`` in all) partition the vectors
of each label: a vector lives in the cell of its nearest pivot. It also visits every cell
that a neighbour within eps can live in: by the triangle inequality those whose pivot is
at most 2 eps farther than its own, and at most eps farther than the cell reaches; and
those whose bisecting plane with its own pivot is within eps. Cells join independently:
visitors against residents, both dealt to tiles, about ``TILE`` residents each, so that
no cell or label has to fit into one task. A tile returns link counts and one label for
each vector, not its pairs; the labels' edges go through connected components.

Equal vectors of a label collapse first to a numbered class with their count.

Defined cases: a null label, a null, empty or zero vector, and one with null or non-finite
components link with nothing. Vectors of different lengths don't link. Rows with the same
or no vec_id are separate vectors, each with its own links. A null vec_id sorts first and
stays null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t
from .common import components, materialise, parts, tile_labels
from .window_dedup import NO_ID

PIVOTS = 4096
CELL = 1024
TILE = 512


def unit(vectors: pa.Array) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray, pivots: np.ndarray, eps: float, reach: np.ndarray | None = None):
    """(home cell, row and cell of each visit, distance to the home pivot)."""
    dot = x @ pivots.T
    d = np.sqrt(np.maximum(2 - 2 * dot, 0))
    home = d.argmin(axis=1)
    own = d[np.arange(len(x)), home]
    if reach is None:
        return home, None, None, own
    # a distance from a dot product can be 1e-7 too small, as between nearly equal pivots
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0)) + 1e-7
    slack = eps + 1e-7
    near = (d - own[:, None] <= 2 * slack) & (d <= reach[None, :] + slack) & (dot[np.arange(len(x)), home][:, None] - dot <= slack * apart[home] + 1e-12)
    row, cell = np.nonzero(near)
    return home, row, cell, own


def tile_result(home_id, home_n, home_x, visit_id, visit_x, least: float):
    """(id, links, label): links counted for visitors, label the smallest id linked in this tile."""
    same = visit_x @ home_x.T >= least
    same &= visit_id[:, None] != home_id[None, :]  # class numbers, so never two different vectors
    if not same.any():
        return None
    node, label = tile_labels(same, visit_id, home_id)
    links = np.concatenate((same @ home_n, np.zeros(len(node), np.int64)))
    keep = np.concatenate((links[: len(visit_id)] > 0, label != node))
    return tuple(np.concatenate(x)[keep] for x in ((visit_id, node), (links[: len(visit_id)], links[len(visit_id) :]), (visit_id, label)))


RESULT = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    spark = vectors.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * least)))
    rows = vectors.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(embedding).cast("array<double>").alias("x"), F.col(label).cast("string").alias("label"))
    good = F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    usable = rows.where("good").withColumn("kind", F.concat_ws(":", F.size("x"), "label"))
    # numbered once and written; ids can be shared by unlike vectors
    classes = materialise(usable.groupBy("kind", "x").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))

    # pivots: the share of a kind above one cell, PIVOTS at most in all
    sizes = classes.groupBy("kind").agg(F.count("*").alias("rows")).where(F.col("rows") > CELL)
    many = sizes.agg(F.sum("rows")).first()[0] or 0
    wanted = F.least(F.ceil(F.col("rows") / CELL), F.greatest(F.lit(2), F.floor(F.lit(PIVOTS / 2) * F.col("rows") / F.lit(max(many, 1))))).alias("k")
    sizes = sizes.select("kind", "rows", wanted).orderBy(F.desc("rows"), "kind").limit(PIVOTS // 4)
    drawn = classes.select("kind", "node", "x", F.xxhash64("x").alias("h")).join(F.broadcast(sizes), "kind")
    # a hash bound that lets about twice the wanted number through, then the smallest of them
    share = F.col("k") * 2.0 / F.col("rows") + 0.002
    drawn = drawn.where((F.col("h").cast("double") / 2.0**64 + 0.5) < share)
    drawn = drawn.groupBy("kind").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "node", "x"))), 1, PIVOTS).alias("p"), F.first("k").alias("k"))
    pivots = {r["kind"]: np.array([p["x"] for p in r["p"][: r["k"]]], np.float64) for r in drawn.toLocalIterator()}
    pivots = {kind: p / np.sqrt((p * p).sum(axis=1, keepdims=True)) for kind, p in pivots.items()}
    sent = spark.sparkContext.broadcast(pivots)

    def per_kind(batch):
        kinds = t.column(batch, "kind")
        names = kinds.dictionary_encode()
        code = names.indices.to_numpy()
        for c, name in enumerate(names.dictionary.to_pylist()):
            at = np.flatnonzero(code == c)
            yield name, at, unit(t.column(batch, "x").take(pa.array(at)))

    def reached(batches):
        for batch in batches:
            for name, _, x in per_kind(batch):
                if name in sent.value:
                    home, _, _, own = cells(x, sent.value[name], eps)
                    far = np.full(len(sent.value[name]), -1.0)
                    np.maximum.at(far, home, own)
                    n = np.bincount(home, minlength=len(far))
                else:
                    far, n = np.array([3.0]), np.array([len(x)])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(far)), pa.array(np.arange(len(far)), pa.int32()), pa.array(far), pa.array(n)], names=["kind", "cell", "far", "n"])

    cell = materialise(classes.select("kind", "x").mapInArrow(reached, "kind string, cell int, far double, n long").groupBy("kind", "cell").agg(F.max("far").alias("far"), F.sum("n").alias("n")))
    reach: dict[str, np.ndarray] = {kind: np.full(len(p), -1.0) for kind, p in pivots.items()}
    if pivots:  # at most PIVOTS rows
        listed = spark.createDataFrame([(k,) for k in pivots], "kind string")
        for r in cell.join(F.broadcast(listed), "kind", "left_semi").toLocalIterator():
            reach[r["kind"]][r["cell"]] = r["far"]
    far = spark.sparkContext.broadcast(reach)

    def dealt(batches):
        for batch in batches:
            node, n = (t.column(batch, c).to_numpy() for c in ("node", "n"))
            for name, at, x in per_kind(batch):
                if name in sent.value:
                    home, row, to, _ = cells(x, sent.value[name], eps, far.value[name])
                else:
                    home, row, to = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), np.int64)
                for lo in range(0, len(row) + len(x), 4096):
                    pick = np.arange(lo, min(lo + 4096, len(row) + len(x)))
                    who = np.where(pick < len(x), pick, row[np.maximum(pick - len(x), 0)] if len(row) else 0)
                    where = np.where(pick < len(x), home[np.minimum(pick, len(x) - 1)], to[np.maximum(pick - len(x), 0)] if len(row) else 0)
                    body = x[who].astype("<f8")
                    width = body.shape[1] * 8
                    packed = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer((np.arange(len(who) + 1) * width).astype("<i4")), pa.py_buffer(np.ascontiguousarray(body))])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(who)), pa.array(where, pa.int32()), pa.array(pick >= len(x)), pa.array(node[at[who]]), pa.array(n[at[who]]), packed], names=["kind", "cell", "visits", "id", "n", "x"])

    def joined(batches):
        key, homes, visitors = None, [], []

        def done():
            if homes and visitors:
                xs = [np.frombuffer(b"".join(r[2] for r in side), "<f8").reshape(len(side), -1) for side in (homes, visitors)]
                ids = [np.array([r[0] for r in side], np.int64) for side in (homes, visitors)]
                if (got := tile_result(ids[0], np.array([r[1] for r in homes], np.int64), xs[0], ids[1], xs[1], least)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], schema=RESULT)

        for batch in batches:
            for kind, c, tile, visits, i, n, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (kind, c, tile) != key or len(visitors) >= TILE:
                    yield from done()
                    homes, visitors = homes if (kind, c, tile) == key else [], []
                    key = (kind, c, tile)
                (visitors if visits else homes).append((i, n, x))
        yield from done()

    tiles = F.ceil(F.col("rows") / TILE).cast("int")
    placed = classes.mapInArrow(dealt, "kind string, cell int, visits boolean, id long, n long, x binary")
    placed = placed.join(cell.select("kind", "cell", F.col("n").alias("rows")).where("rows > 0"), ["kind", "cell"])
    own = F.pmod(F.xxhash64("id"), tiles).cast("int")
    i, j = F.when(F.col("visits"), F.col("other")).otherwise(own), F.when(F.col("visits"), own).otherwise(F.col("other"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    placed = placed.select("kind", "cell", F.struct(i.alias("i"), j.alias("j")).alias("tile"), "visits", "id", "n", "x").select("kind", "cell", (F.col("tile.i").cast("long") * (1 << 31) + F.col("tile.j")).alias("tile"), "visits", "id", "n", "x")
    placed = placed.repartition(parts(spark), "kind", "cell", "tile").sortWithinPartitions("kind", "cell", "tile", "visits")
    found = materialise(placed.mapInArrow(joined, "id long, links long, label long"))

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("label").alias("b")))
    info = classes.join(links.withColumnRenamed("id", "node"), "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    info = materialise(info.select("kind", "x", "first", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")))
    lowest = info.groupBy("component").agg(F.min("first").alias("lowest"))
    info = info.join(lowest, "component").select("kind", "x", "links", F.col("lowest").alias("component"))
    with_links = usable.join(info, ["kind", "x"]).select("id", "links", "component")
    alone = rows.where("NOT good").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = with_links.unionByName(alone)
    return out.select(F.nullif("id", F.lit(NO_ID)).alias(vec_id), F.col("links").alias("n_links"), F.nullif("component", F.lit(NO_ID)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
