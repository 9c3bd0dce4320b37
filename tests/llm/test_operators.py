"""Each operator against a brute-force version on small, awkward fixtures."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evigrain.llm import chat_format, decontaminate, embedding_join, jaccard_join, mixing, quality, suffix_dedup, text, toxicity, url_rules, window_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed=0, n=60):
    """(doc_id, text): copies, near copies, shared passages, odd characters, null, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "Ünï", "日本", "A", "a,b"]
    fresh = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base, out = fresh(60), fresh(120), []
    for i in range(n):
        kind = i % 6
        words = fresh(rng.randint(0, 150))
        if kind == 1:
            words[len(words) // 2 : len(words) // 2] = passage
        elif kind == 2:
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind == 3 and out:
            words = (out[rng.randrange(len(out))][1] or "").split()
        elif kind == 4:
            words = fresh(rng.randint(0, 6)) * rng.randint(1, 30)
        out.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return [*out, (1000, None), (1001, ""), (1002, "   "), (None, "w1 w2"), (1003, " ".join(fresh(5000)))]


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


def with_clashes(df):
    from pyspark.sql import functions as F

    for name in ("doc", "n", "body", "kept", "score", "bucket", "component_id", "rest"):
        df = df.withColumn(name, F.lit("x"))
    return df


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_window_dedup(spark):
    rows = texts(1)
    seen, want = set(), {}
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall(x or "")
        gone = [False] * len(w)
        for s in range(len(w) - 9):
            k = tuple(w[s : s + 10])
            if k in seen:
                gone[s : s + 10] = [True] * 10
            seen.add(k)
        want[i] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g).encode())
    got = window_dedup.remove_windows(with_clashes(frame(spark, rows)), window=10).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in got} == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_window_dedup_empty_and_repeated_rows(spark):
    assert window_dedup.remove_windows(frame(spark, [])).count() == 0
    x = " ".join(map(str, range(30)))
    got = window_dedup.remove_windows(frame(spark, [(1, x), (1, x), (2, x)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 30)]


def test_window_dedup_tells_apart_windows_that_share_48_hash_bits(spark):
    pair = "00ecfed1", "008022af"
    h = [int(text.range_hash(text.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([8])), np.array([0]), np.array([1]))[0]) for w in pair]
    assert h[0] >> 16 == h[1] >> 16 and h[0] != h[1]
    got = window_dedup.remove_windows(frame(spark, [(1, pair[0]), (2, pair[1]), (3, pair[1])]), window=1).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 1)]


def test_window_dedup_equal_hash_but_other_check_byte():
    h, check = np.full(3, 7, np.uint64), np.array([1, 2, 2], np.uint64)
    rows = [r[1:] for r in window_dedup.pack_held([(np.arange(3), np.zeros(3, np.int64), h, check)], 1)]
    assert [x.tolist() for x in window_dedup.unpack_wide(rows)] == [[0, 1, 2], [0, 0, 0], [0, 0, 0], [7, 7, 7], [1, 2, 2]]


@pytest.mark.parametrize("shared", [5, None])
def test_window_dedup_unlike_texts_under_one_id(spark, shared):
    fresh = lambda tag: " ".join(f"{tag}{i}" for i in range(25))
    rows = [(1, fresh("a")), (shared, fresh("a")), (shared, fresh("b")), (shared, fresh("b")), (9, fresh("b")), (shared, fresh("c"))]
    got = Counter((r.doc_id, bytes(r.kept), r.n_removed) for r in window_dedup.remove_windows(frame(spark, rows), window=20).collect())
    a_first = shared is None
    want = [(1, fresh("a") * (not a_first), 25 * a_first), (shared, fresh("a") * a_first, 25 * (not a_first)), (shared, fresh("b"), 0), (shared, fresh("b"), 0), (9, "", 25), (shared, fresh("c"), 0)]
    assert got == Counter((i, x.encode(), n) for i, x, n in want)


def test_window_dedup_every_row_under_one_id(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(7, " ".join([*base, f"x{i}"])) for i in range(20)]
    got = window_dedup.remove_windows(frame(spark, rows), window=20).collect()
    assert sorted(r.n_removed for r in got) == [0] + [40] * 19


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_regular_words_and_strings_do_not_collide(spark, size):
    x, y = thue_morse(size)
    tail = [f"t{i}" for i in range(19)]
    one, two = " ".join([x, *tail]), " ".join([y, *tail])
    got = window_dedup.remove_windows(frame(spark, [(1, one), (2, two)]), window=20).collect()
    assert [r.n_removed for r in got] == [0, 0]
    assert sorted(r.component_id for r in jaccard_join.near_duplicates(frame(spark, [(1, x), (2, y)])).collect()) == [1, 2]
    items = spark.createDataFrame([("i", " ".join([x, *tail[:12]]))], "item_id string, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate.contamination(frame(spark, [(1, one), (2, two)]), items).collect()) == [(1, 13), (2, 0)]
    got = suffix_dedup.remove_repeats(frame(spark, [(1, x), (2, y)]), least=size).collect()
    assert [r.n_removed for r in got] == [0, 0]
    for codes in (text.BYTE_CODES, text.CHECK_CODES):
        h = [text.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([size]), codes)[0] for w in (x, y)]
        assert h[0] != h[1]


def test_prime_hash():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, text.PRIME, 500, dtype=np.uint64) for _ in range(2))
    assert text.prime_product(a, b).tolist() == [int(x) * int(y) % text.PRIME for x, y in zip(a, b)]
    buf = rng.integers(0, 256, 3000, dtype=np.uint8)
    buf[1000:1400] = buf[2000:2400]
    s, e = np.array([1000, 2000, 1001, 1000]), np.array([1400, 2400, 1401, 1399])
    h = text.PrimeHash(buf).of(s, e).tolist()
    assert h[0] == h[1] and len(set(h)) == 3


def test_repeats_block():
    rng = random.Random(3)
    for _ in range(200):
        least = rng.choice([3, 5, 9, 20])
        base = [bytes(rng.choice(b"abc\x00\xff") for _ in range(rng.randint(1, 40))) for _ in range(3)]
        strings = [b"".join(rng.choice(base)[: rng.randint(1, 40)] for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))]
        count = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
        for s, hit in zip(strings, suffix_dedup.repeats(strings, least)):
            assert hit.tolist() == [count[s[i : i + least]] > 1 for i in range(len(s) - least + 1)]


@pytest.mark.parametrize("hot", [suffix_dedup.BLOCK, 300])
def test_suffix_dedup(spark, hot):
    rows = texts(2)
    least, count, want = 50, Counter(), []
    for _, x in rows:
        b = (x or "").encode()
        count.update(b[s : s + least] for s in range(len(b) - least + 1))
    for i, x in rows:
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - least + 1):
            if count[b[s : s + least]] > 1:
                gone[s : s + least] = True
        want.append((str(i), len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    got = suffix_dedup.remove_repeats(with_clashes(frame(spark, rows)), least=least, gram=12, hot=hot, carry=("rest", "doc")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == sorted(want)
    assert all(r.rest == r.doc == "x" for r in got)
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in got)


def test_suffix_dedup_segments_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    pieces = [b for b in suffix_dedup.segments(pa.array(["a" * 5000]), 100)]
    assert sum(len(p[2]) - 99 for p in pieces) == 4901
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    x = "".join(map(str, range(400)))
    got = suffix_dedup.remove_repeats(frame(spark, [(1, x), (1, x), (None, None)])).collect()
    assert sorted(r.n_removed for r in got) == [0, len(x), len(x)]


def test_suffix_dedup_holds_little_at_a_time():
    rng = np.random.default_rng(3)
    body = pa.array([rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode() for n in [3000] * 1000 + [3_000_000]])
    list(suffix_dedup.stretches(np.zeros(1000, np.uint8), np.array([0, 1000]), 400, 32))  # the tables of powers
    tracemalloc.start()
    for _, _, buf, offs in suffix_dedup.segments(body, 400):
        suffix_dedup.stretches(buf, offs, 400, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_suffix_dedup_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ROOM", 1000)
    rng = random.Random(5)
    rows = [(a, i, bytes(rng.randint(1, 400))) for a in range(200) for i in range(rng.choice([1, 2, 20]))]
    batch = pa.RecordBatch.from_pylist([{"anchor": a, "n": n, "body": b} for a, n, b in rows])
    got = list(suffix_dedup.blocks([batch.slice(0, 33), batch.slice(33)], rows=7))
    assert [r for b in got for r in b] == rows
    anchors = [{r[0] for r in b} for b in got]
    assert sum(map(len, anchors)) == 200
    assert all(len(a) == 1 or sum(len(r[-1]) for r in b) <= 1000 for a, b in zip(anchors, got, strict=True))
    assert list(suffix_dedup.blocks([])) == []


def test_suffix_dedup_keeps_whole_characters(spark):
    x = "é" * 300
    got = suffix_dedup.remove_repeats(frame(spark, [(1, "a" + x), (2, x + "b")]), least=401, carry=()).collect()
    assert all("\ufffd" not in r.kept_text for r in got)


def brute_groups(rows, k=5, percent=75):
    sets = {}
    for i, x in rows:
        w = WORD.findall((x or "").translate(ASCII))
        sets[i] = {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = lambda v: (v is not None, v or 0)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b], key=low)
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("seed,settings", [(1, {}), (2, {"FREQUENT": 2, "CROWD": 2, "TILE": 4, "CLASSES": 3, "SMALL": 6}), (3, {"FREQUENT": 1, "CROWD": 16, "CLASSES": 2, "SMALL": 5, "GRID": 300})])
def test_near_duplicates(spark, monkeypatch, seed, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = texts(seed, 90)
    got = jaccard_join.near_duplicates(with_clashes(frame(spark, rows)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_groups(rows)


def test_sets_that_meet_at_many_keys_are_listed_once_a_bucket(spark, monkeypatch):
    written, write = [], jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df: written.append(write(df)) or written[-1])
    body = lambda i: b"".join(k.to_bytes(6, "little") for k in [*range(26), *range(1000 * i, 1000 * i + 74)])
    rows = [(i, 100, 26, body(i), i) for i in range(1, 21)] + [(30, 300, 26, body(30), 30), (31, 100, 26, body(20), 20)]
    pairs, members = jaccard_join.contacts(frame(spark, rows, "doc long, n long, rare int, tokens binary, component long"), 75)
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in range(1, 21) for b in range(a + 1, 21)]
    assert members.count() == 0
    assert written[0].count() <= jaccard_join.parts(spark)  # 190 a bucket, were they pairs


def test_near_duplicates_edges(spark):
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    got = jaccard_join.near_duplicates(frame(spark, [(5, "a b"), (3, "A  b"), (3, "A  b"), (4, None)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 1, 3), (3, 1, 3), (4, 0, 4), (5, 1, 3)]


def test_contamination(spark, monkeypatch):
    rows = texts(4)
    items = [(1, "w1 w2"), (2, None), (3, "..."), (4, rows[1][1]), (5, rows[1][1]), (6, "Ünï"), (7, " ".join(f"w{i}" for i in range(40)))]
    rows = [*rows, (2000, "x " * 30 + "W1, w2 x")]
    cut = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda x: cut.findall((x or "").translate(ASCII))
    windows = {}
    for i, x in items:
        w = words(x)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    want = []
    for i, x in rows:
        w = words(x)
        hit, found = [0] * len(w), set()
        for k, ids in windows.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit[s : s + len(k)] = [1] * len(k)
                    found |= ids
        want.append((str(i), len(w), sum(hit), sorted(found)))
    bench = frame(spark, items, "item_id long, text string")
    for block in (decontaminate.BLOCK, 20):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        got = decontaminate.contamination(with_clashes(frame(spark, rows)), bench, carry=("rest", "n")).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)
    assert decontaminate.contamination(frame(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.normal(size=8) * (0.02 if i % 3 else 0.3)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(300 + i, rows[0][1], 0) for i in range(20)] + [(400, None, 0), (401, [], 1), (402, [0.0] * 8, 1), (403, [float("nan")] * 8, 0), (404, rows[1][1], None), (405, [1.0] * 4, 1), (406, [None, 1.0], 1), (7, rows[7][1], 1)]
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) for r in ok]
    link = [[j for j in range(len(ok)) if j != i and ok[i][2] == ok[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(len(ok))]
    label = [r[0] for r in ok]
    for _ in range(len(ok)):
        new = [min([label[i], *(label[j] for j in link[i])]) for i in range(len(ok))]
        if new == label:
            break
        label = new
    want = sorted([(r[0], len(n), c) for r, n, c in zip(ok, link, label)] + [(r[0], 0, r[0]) for r in rows if r not in ok])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("zz", "zz")
    for cell in (1024, 20):
        monkeypatch.setattr(embedding_join, "CELL", cell)
        monkeypatch.setattr(embedding_join, "TILE", cell // 2)
        got = embedding_join.near_vectors(df).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_join.near_vectors(df.limit(0)).count() == 0


def test_quality(spark):
    good = [(i, f"The story number {i} tells of one day, and then of another. It ends well {i}.", 1) for i in range(60)]
    bad = [(100 + i, "BUY NOW!! " * (3 + i % 5), 0) for i in range(60)]
    docs = frame(spark, [(a, b) for a, b, _ in good + bad] + [(999, None), (998, "")])
    labels = spark.createDataFrame([(a, c) for a, _, c in good + bad] + [(5, None)], "doc_id long, quality int")
    measured = quality.statistics(docs).persist()
    rules = quality.train(measured, labels)
    got = {r.doc_id: r.s for r in measured.select("doc_id", rules.score().alias("s")).collect()}
    assert len(got) == 122 and all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i in range(60)) > 0.7 > max(got[100 + i] for i in range(60))
    none = quality.train(measured, labels.limit(0))
    assert measured.select(none.score().alias("s")).distinct().count() == 1


def test_toxicity(spark):
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice(["red", "house", "walk", "sun", "bread", "tree"]) for _ in range(30))
    rows = [(i, plain() + (" vileword" + str(i % 7) if i % 3 == 0 else "")) for i in range(300)]
    docs = frame(spark, [*rows, (999, None), (998, "")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(5000, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(with_clashes(docs), model).collect()}
    assert len(got) == 302 and all((got[i] >= 0.7) == (i % 3 == 0) for i in range(200, 300))
    assert got[999] == got[998] < 0.7
    assert toxicity.train(docs, labels.limit(0)).bias == pytest.approx(0)
    again = toxicity.train(docs.repartition(7), labels)
    assert again.bias == model.bias and (again.slots == model.slots).all() and (again.weights == model.weights).all()


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("x" * rng.randint(0, 300)), rng.choice(["a", "b", "B", None])) for i in range(300)] + [(500, None, "c"), (501, "", "a"), (0, "x y", "a")]
    df = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.taken(mixing.mix(with_clashes(df), block=8)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    again = mixing.taken(mixing.mix(df.repartition(7), block=8)).toPandas()
    order = ["doc_id", "size", "source_size", "taken"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))
    per = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((per.taken - per.target).abs() <= 8).all() and got.groupby("source_size").target.first().sum() == pytest.approx(got["size"].sum())
    assert mixing.taken(mixing.mix(df.limit(0))).count() == 0


def test_targets_refill():
    s = [mixing.Source(0, "a", 100, 1.0), mixing.Source(1, "b", 10, 2.0), mixing.Source(2, "c", 200, 3.0), mixing.Source(3, None, 0, 1.0)]
    mixing.fill(s)
    assert s[1].target == 30 and s[3].target == 0 and s[0].target == pytest.approx(70) and s[2].target == pytest.approx(210)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_affine_is_a_permutation(n):
    for turn in range(3):
        a, b = mixing.affine(4, turn, n, 1)
        assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_url_rules(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/e", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = [None, "", "no scheme", "http://A.example.NET/en/x?q#f", "http://net/", "http://net", "http://xnet/", "https://example.net/ex", "a://b.net/?u=http://c.org/", "http://a.net#x"]
    got = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[0] == by[1] == by[2] == ("", "", None, "allow")
    assert by[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[4] == ("net", "/", "net/", "block") and by[5] == ("net", "", None, "allow") and by[6][2] is None
    assert by[7][2:] == ("example.net/e", "block") and by[8] == ("b.net", "/", "net/", "block") and by[9] == ("a.net", "", None, "allow")
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BATCH_BYTES", 200)
    odd = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> <<s>", "plain \\ text\n", "<|im_start|>x<|im_end|>\n", "", None, "日本\u0001", "é" * 50]
    rng = random.Random(4)
    rows = [(c, k, rng.choice(["user", "assistant", "system", "a\nb\\", None]), rng.choice(odd)) for c in [*range(40), None] for k in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df.repartition(5)).collect()}
    for c in [*range(40), None]:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: r[1])
        assert chat_format.read_back(got[c].formatted) == [(r[2] or "", r[3] or "") for r in own]
        loss = [chat_format.unescape(got[c].formatted[m.start : m.end]) for m in got[c].mask]
        assert loss == [r[3] or "" for r in own if r[2] == "assistant"] and got[c].n_turns == len(own)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    fresh = lambda k: " ".join(f"v{rng.randrange(5000)}" for _ in range(k))
    passage, item, base, half = fresh(120), fresh(30), fresh(200), [fresh(150), fresh(150)]
    rows = [(i, fresh(150) + (" vileword" if i % 5 == 0 else "")) for i in range(150)]
    rows += [(200, base), (201, base + " tail"), (202, base), (203, fresh(20) + " " + item), (204, fresh(90) + " " + passage), (205, passage + " " + fresh(90)), (206, None), (207, "")]
    rows += [(208, fresh(900) + " " + passage), (209, passage + " " + fresh(900)), (209, passage + " " + fresh(900)), (None, fresh(60)), (None, fresh(60)), (200, base)]
    # each half of these repeats in the other, but few shingles of five words are in the same order
    rows += [(210, half[0] + " v1 " + half[1]), (211, half[0] + " v2 " + half[1] + " v3 v4 " + passage)]
    docs = spark.createDataFrame([(i, x, "en", f"s{(i or 0) % 3}", len(x or ""), "x") for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.read(spark, str(tmp_path), "documents")
    from evigrain.llm.common import materialise

    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = materialise(stage(spark, got, str(tmp_path)))
        assert got.columns == docs.columns
    got = got.collect()
    left = {r.doc_id: r.text for r in got}
    # 204, 205, 208 and 209 are cut; 210 and 211 lose nearly all and go; repeated ids with other texts are other documents
    assert Counter(r.doc_id for r in got) == Counter([*(i for i in range(150) if i % 5), 200, 204, 205, 206, 207, 208, 209, 209, None, None])
    assert passage not in left[204] and 300 < len(left[204]) < 1000
    assert passage not in left[208] and passage not in left[209] and left[200] == base and len(left[208]) > 900
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in run) == Counter(r.doc_id for r in got)
    size = lambda rows: Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    assert Counter((r.doc_id, r.size) for r in run) == size(got) and all(r.taken <= 3 * r.size for r in run)


def test_pipeline_stages_on_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_vector_visits_the_cell_of_a_pivot_nearly_equal_to_its_own():
    x = np.array([[1, 0.001], [1, -0.099]])
    pivots = np.array([[1, 0], [1, 1e-8]])
    x, pivots = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (x, pivots))
    home, row, cell, _ = embedding_join.cells(x, pivots, 0.2, np.full(2, 0.2))
    assert home.tolist() == [1, 0] and (1, 1) in zip(row.tolist(), cell.tolist())


def brute_vectors(rows, least=0.98):
    """[(id, links, component)] of (id, vector, label) rows, each a vector of its own."""
    unit = [None if l is None or x is None or any(v is None or not np.isfinite(v) for v in x) or not any(x) else np.array(x, float) / np.sqrt((np.array(x, float) ** 2).sum()) for _, x, l in rows]
    near = [[b for b in range(len(rows)) if b != a and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least] for a in range(len(rows))]
    group, low = list(range(len(rows))), lambda i: (i is not None, i or 0)
    for _ in rows:
        group = [min([group[a], *(group[b] for b in near[a])]) for a in range(len(rows))]
    lowest = {g: min((rows[a][0] for a in range(len(rows)) if group[a] == g), key=low) for g in set(group)}
    return sorted(((str(rows[a][0]), len(near[a]), str(lowest[group[a]])) for a in range(len(rows))))


@pytest.mark.parametrize("tile", [embedding_join.TILE, 3])
def test_vectors_that_share_an_id_or_have_none(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_join, "TILE", tile)
    rng = np.random.default_rng(4)
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(7, x, 1), (7, y, 1), (1, [1.0, 0.01, 0.0], 1), (2, [0.01, 1.0, 0.0], 1), (3, [0.0, 1.0, 0.01], 1), (9, [0.0, 0.0, 1.0], 1), (9, [0.01, 0.0, 1.0], 1)]
    rows += [(None, [0.5, 0.5, 0.5], 1), (None, [1.0, 0.02, 0.0], 1), (None, [-1.0, 0.0, 0.3], 1), (8, None, 1), (8, x, None), (8, [0.0, 0.0, 0.0], 1), (5, x, 1), (5, x, 1)]
    rows += [(int(i % 5), (np.eye(3)[i % 3] + 0.05 * rng.normal(size=3)).tolist(), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = embedding_join.near_vectors(with_clashes(df)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embedding_join.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("flush", [window_dedup.FLUSH, 50])
def test_a_window_in_every_document(spark, monkeypatch, flush):
    monkeypatch.setattr(window_dedup, "FLUSH", flush)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"{passage} own{i} {passage}") for i in range(300)] + [(0, f"{passage} own0 {passage}")]
    got = window_dedup.remove_windows(frame(spark, rows)).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got} == {(i, 51, 25 if i == 0 else 50, f"{passage} own0" if i == 0 else f"own{i}") for i in range(300)}
    assert len(got) == 301
