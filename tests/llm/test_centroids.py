"""Centroid clustering against plain Python integers."""

import hashlib
import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrain.llm import centroids

DATA = "/root/testdata/sf0.001"
LIMIT, MOST = 1 << 62, (1 << 63) - 1


def brute(rows, size, clusters, rounds):
    kept = [(i, [math.floor(max(min(1024 * float(x), float(LIMIT)), -float(LIMIT))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest())
    now = [v for i, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(now)):
            mine = [v for (_, v), c in zip(kept, own) if c == k]
            if mine:
                now[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [near(v) for _, v in kept]
    inertia = Counter()
    for d, k in last:
        inertia[k] += min(d, MOST)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return Counter((i, k, min(d, MOST), min(inertia[k], MOST), min(sum(inertia.values()), MOST), sha[k]) for (i, _), (d, k) in zip(kept, last))


def made(size, n, seed=0):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(middle)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(3, rows[5][1]), (None, rows[1][1]), (None, [0.0] * size)]
    bad = [None, [], [1.0] * (size + 1), [None] * size, [float("nan")] * size, [float("inf")] + [0.0] * (size - 1)]
    return rows + [(5000 + i, v) for i, v in enumerate(bad)]


def found(got):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect())


def frame(spark, rows, kind="double"):
    docs = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return docs.withColumns({c: F.lit("x") for c in ("id", "v", "x", "cluster", "key")})


@pytest.mark.parametrize("size,clusters,rounds", [(6, 8, 10), (3, 3, 4), (64, 8, 2)])
def test_clusters(spark, monkeypatch, size, clusters, rounds):
    monkeypatch.setattr(centroids, "BLOCK", 16)
    rows = made(size, 250)
    assert found(centroids.cluster_vectors(frame(spark, rows), size=size, clusters=clusters, rounds=rounds)) == brute(rows, size, clusters, rounds)


def test_huge_components_and_few_vectors(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 5e7]), (3, [1e10, -3.5]), (4, [0.1, -0.1])]
    assert found(centroids.cluster_vectors(frame(spark, rows), size=2, clusters=3, rounds=3)) == brute(rows, 2, 3, 3)
    assert found(centroids.cluster_vectors(frame(spark, rows[2:]), size=2)) == brute(rows[2:], 2, 8, 10)


def test_empty(spark):
    assert centroids.cluster_vectors(frame(spark, [])).count() == 0
    assert centroids.cluster_vectors(frame(spark, [(1, None)])).count() == 0


def test_hilbert_curve_visits_neighbours():
    places = np.array(list(itertools.product(range(4), repeat=3)))
    keys = centroids.hilbert_keys(places, 2)
    order = sorted(range(len(places)), key=lambda i: keys[i].tobytes())
    assert len({k.tobytes() for k in keys}) == 64
    assert (np.abs(np.diff(places[order], axis=0)).sum(axis=1) == 1).all()


def test_boxes_keep_the_nearest():
    rng = np.random.default_rng(0)
    some = 0
    for _ in range(200):
        x = rng.integers(-50, 50, (20, 4)) + rng.integers(-200, 200, 4)
        c = rng.integers(-250, 250, (8, 4))
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        got, distance = centroids.nearest(x, x.min(axis=0), x.max(axis=0), c)
        assert got.tolist() == d.argmin(axis=1).tolist() and distance.tolist() == d.min(axis=1).tolist()
        some += len(centroids.near_centroids(x.min(axis=0), x.max(axis=0), c))
    assert some < 200 * 8


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    duckdb = pytest.importorskip("duckdb")
    from evigrain.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet{'/*' if os.path.isdir(DATA + '/embeddings.parquet') else ''}')")
    result = con.execute(queries.ORACLE_SQL["op11_centroid_clusters"])
    names = [c[0] for c in result.description]
    want = Counter(tuple(r[names.index(c)] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in result.fetchall())
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, DATA, "embeddings").collect()]
    assert found(queries.op11_centroid_clusters(spark, DATA)) == want == brute(rows, 64, 8, 10)
