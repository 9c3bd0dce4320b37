"""Token counts against the library that the vocabulary is from."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigrain.llm import text, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda texts: [len(x) for x in model.encode([x or "" for x in texts], num_threads=1)]


@pytest.fixture(scope="module")
def vocabulary():
    return token_count.read_vocabulary(MODEL)


def counts(machine, texts, size=text.CHUNK):
    out = [token_count.count_tokens(machine, buf, offs) for _, _, buf, offs in text.chunks(pa.array(texts, pa.string()), size)]
    return np.concatenate(out).tolist()


def odd_texts():
    rng = random.Random(1)
    alphabet = "aabcdeeriost  \n\t.,<>s/unk0▁　日本é€😀\x00A'"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return ["", " ", "   ", None, "a", " a", "a ", "▁", "<s>", "</s><unk> <0x41>", "<pad>", *made]


def long_texts():
    rng = random.Random(2)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    return [letters, "a" * 5000, " " * 5000, "ab" * 3000, "日" * 1000, "é" * 1001, "erer" * 700, " a" * 1000, "😀" * 400, "x" + " " * 900 + "y"]


def test_counts_are_the_librarys(vocabulary, library):
    machine = token_count.Transducer(vocabulary)
    for texts in (odd_texts(), long_texts()):
        assert counts(machine, texts) == library(texts)
        assert counts(machine, texts) == library(texts)


def test_a_full_table_starts_anew(vocabulary, library):
    machine = token_count.Transducer(vocabulary, limit=200)
    assert counts(machine, odd_texts(), 500) == library(odd_texts())
    assert counts(machine, long_texts(), 500) == library(long_texts())


def test_any_chunk_length(vocabulary, library, monkeypatch):
    machine, cuts = token_count.Transducer(vocabulary), token_count.cuts
    texts = odd_texts()[:300] + long_texts()
    for step in (4, 7, 64, 10_000):
        monkeypatch.setattr(token_count, "cuts", lambda buf, offs, lead, step=step: cuts(buf, offs, lead, step))
        assert counts(machine, texts) == library(texts)


def test_pairs_against_encoding(vocabulary):
    v, rng = vocabulary, random.Random(3)
    short = [i for i, p in enumerate(v.tokens) if len(p) <= 4]
    spaces = [i for i, p in enumerate(v.tokens) if set(p) <= set("▁ae")]
    pairs = [(rng.choice(short), rng.choice(short)) for _ in range(8000)] + [(a, b) for a in spaces for b in spaces]
    pairs += [(rng.randrange(len(v.tokens)), rng.randrange(len(v.tokens))) for _ in range(8000)]
    for a, b in pairs:
        x, y = v.tokens[a], v.tokens[b]
        assert v.follows(a, b) == (v.encode(x + y) == [x, y])


def test_vocabulary_whose_scores_are_out_of_order():
    scores = {"a": -1.0, "b": -2.0, "ab": -9.0, "aba": -3.0, "bb": -4.0, "abab": -5.0, "ba": -7.0, "▁": -1.0, "▁a": -8.0}
    v = token_count.Vocabulary(scores)
    machine, rng = token_count.Transducer(v), random.Random(4)
    texts = ["".join(rng.choice("aabb c") for _ in range(rng.randint(1, 30))) for _ in range(600)]
    cost = lambda p: 1 if p in scores else len(p.encode())
    assert counts(machine, texts) == [sum(map(cost, v.encode("▁" + x.replace(" ", "▁")))) for x in texts]


def test_scan_composes_neighbours():
    _, sums = token_count.scan(np.zeros(7, np.int64), np.arange(1, 8), np.array([0, 0, 0, 2, 2, 2, 2]))
    assert sums.tolist() == [1, 3, 6, 4, 9, 15, 22]


def test_token_counts(spark, library):
    texts = [*odd_texts()[:200], "word " * 30_000, *long_texts()]
    rows = [(i if i % 50 else None, x) for i, x in enumerate(texts)] + [(1, texts[1]), (2, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "body", "rest", "n_tokens", "n_bytes")})
    got = token_count.token_counts(docs, MODEL, carry=("rest", "body")).collect()
    want = library([x for _, x in rows])
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=key) == sorted(((i, len((x or "").encode()), n, n > 4096) for (i, x), n in zip(rows, want)), key=key)
    assert all(r.rest == r.body == "x" for r in got)
    assert token_count.token_counts(docs.limit(0), MODEL).count() == 0


def test_query_on_the_smallest_tables(spark, library):
    from evigrain.llm import queries

    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    rows = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    want = library([r.text for r in rows])
    assert got == {r.doc_id: (len((r.text or "").encode()), n, n > 4096) for r, n in zip(rows, want)}
