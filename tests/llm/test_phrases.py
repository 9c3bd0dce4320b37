"""Collocations against a brute-force version."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigrain.llm import phrases

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = "/root/testdata/sf0.001"


def brute(rows, least, top, most=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in often.items():
            for k in range(2, len(p)):
                inside |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= 100 * count[p[i : i + k]]}
        scored = []
        for p, a in often.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def made(seed=0, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "ß", "日本", "The", "THE", "a-b", "\x0b"]
    fixed = ["the red fox jumps over it", "one two", "New York City", "a a a a a a", "x y x y x y"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t ", ". ", ",", "\n", "!?"]) for p in parts)
        rows.append((text, rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), (" . ", "en"), (" ".join(rng.choice(words) for _ in range(20_000)), "de"), rows[0], rows[0]]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string")
    return docs.withColumns({c: F.lit("x") for c in ("body", "phrase", "prefix", "n", "a", "rank")})


def as_rows(got):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())


@pytest.mark.parametrize("least,top,most", [(5, 2000, 5), (3, 7, 5), (2, 50, 3)])
def test_collocations(spark, monkeypatch, least, top, most):
    monkeypatch.setattr(phrases, "SPAN", 3000)
    monkeypatch.setattr(phrases, "SLICE", {5: 1 << 16, 3: 7, 2: 100}[least])
    monkeypatch.setattr(phrases, "ENTRIES", {5: 1 << 20, 3: 400, 2: 3000}[least])
    rows = made(least)
    assert as_rows(phrases.collocations(frame(spark, rows), least=least, top=top, most=most)) == brute(rows, least, top, most)


def test_a_full_bitmap_and_small_slices_change_nothing(spark, monkeypatch):
    rows = made(9, 60)
    monkeypatch.setattr(phrases, "frequent_bits", lambda found, words: np.full(1 << phrases.BITS - 3, 255, np.uint8))
    assert as_rows(phrases.collocations(frame(spark, rows), least=4)) == brute(rows, 4, 2000)


@pytest.mark.parametrize("least", [3, 300])
def test_countable_keeps_every_frequent_pair(spark, monkeypatch, least):
    monkeypatch.setattr(phrases, "SPAN", 2000)
    monkeypatch.setattr(phrases, "HELD", 2)
    rows = [("a b " * 200 + f"x{i} y{i}", "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "lang string, body string").selectExpr("body AS lang", "lang AS body").repartition(3)
    everything = np.full(1 << phrases.BITS - 3, 255, np.uint8)
    bits, bitmap = phrases.countable(docs, 1, everything, least, 2010)
    seed = phrases.seeds(pa.array(["en"]))
    pair = lambda p: phrases.phrase_hashes(np.repeat(seed, 2), phrases.t.word_hashes(np.frombuffer(p.encode(), np.uint8), np.array([0, p.index(" ") + 1]), np.array([p.index(" "), len(p)])), 2)
    assert [bool(phrases.is_set(bitmap, pair(p), bits)[0]) for p in ("a b", "b a")] == [True, True]
    assert np.unpackbits(bitmap).sum() <= 3


def test_merging_in_small_slices():
    rng = random.Random(1)
    stripes, want = [], defaultdict(Counter)
    for _ in range(300):
        key = (rng.choice(["en", "fr"]), rng.choice(["", "a", "b c"]), rng.randint(0, 2))
        nexts = sorted(set(rng.choices("xyzuvw", k=rng.randint(0, 4))))
        counts, other = [rng.randint(1, 5) for _ in nexts], rng.randint(0, 3)
        stripes.append((*key, nexts, counts, other))
        want[key].update(dict(zip(nexts, counts)))
        want[key][None] += other
    stripes.sort(key=lambda r: r[:3])
    for size in (1, 3, 50, 1000):
        got, held = [], []
        for i in range(0, len(stripes), size):
            held.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stripes[i : i + size]), phrases.STRIPE)], schema=phrases.STRIPE))
            out, kept = phrases.merge_slice(pa.Table.from_batches(held), 4, False)
            got += out.to_pylist() if out else []
            held = [kept]
        got += phrases.merge_slice(pa.Table.from_batches(held), 4, True)[0].to_pylist()
        sums = Counter((r["lang"], r["prefix"], r["n"], r["top"]) for r in got if r["next"] is None)
        assert sums == Counter((k[0], k[1], sum(c.values()), max((n for w, n in c.items() if w), default=0)) for k, c in want.items())
        found = Counter((r["lang"], r["prefix"], r["next"], r["n"]) for r in got if r["next"] is not None)
        assert found == Counter((k[0], k[1], w, n) for k, c in want.items() for w, n in c.items() if w and n >= 4)


def test_counts_beyond_64_bits_in_products(spark):
    rows = spark.range(1).select(F.expr("cast(4e12 as bigint) AS a"), F.expr("cast(9e15 as bigint) AS n"), F.expr("cast(4e12 as bigint) AS l"), F.expr("cast(7e12 as bigint) AS r"))
    score = "(1000 * cast(a AS decimal(18,0)) * cast(n AS decimal(18,0))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))"
    assert rows.selectExpr(f"{score} AS s").first().s == 1000 * 4 * 10**12 * 9 * 10**15 // (4 * 10**12 * 7 * 10**12)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    duckdb = pytest.importorskip("duckdb")
    from evigrain.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet{'/*' if os.path.isdir(DATA + '/documents.parquet') else ''}')")
    result = con.execute(queries.ORACLE_SQL["op12_phrase_collocations"])
    names = [c[0] for c in result.description]
    got = as_rows(queries.op12_phrase_collocations(spark, DATA))
    want = sorted(tuple(r[names.index(c)] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in result.fetchall())
    rows = [(r.text, r.lang) for r in queries.table(spark, DATA, "documents").select("text", "lang").collect()]
    assert got == want == brute(rows, 100, 2000) and got
