"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .window_dedup import remove_windows

    got = remove_windows(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    got = remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: The rules that the query's contract names.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    import pyarrow as pa

    from .chat_format import format_conversations, read_back, unescape

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)

    def digests(batches):
        for batch in batches:
            out = []
            for conv, whole, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
                back = read_back(whole)
                text = "".join(f"{role}\n{said}\n" for role, said in back)
                loss = "".join(unescape(whole[m["start"] : m["end"]]) for m in mask)
                out.append((conv, len(back), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return format_conversations(turns).mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated, contamination

    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, contaminated().alias("contaminated"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_join import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    from .common import materialise
    from .toxicity import remainder

    measured = materialise(quality.statistics(table(spark, sf_dir, "documents")))
    model = quality.train(measured, table(spark, sf_dir, "labels"), allowed=remainder("doc_id", 4) != 2)
    got = measured.withColumn("score", model.score())
    return got.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken

    return taken(mix(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.remainder("doc_id", 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), allowed=~held_out)
    got = toxicity.score(docs, model)
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_suffix_dedup, op3_embedding_near_dedup, op4_quality_rules, op5_source_mixing, op6_toxicity, op7_ngram_jaccard_join, op8_url_rules, op9_chat_format, op10_decontamination, op11_centroid_clusters, op12_phrase_collocations, op13_token_counts)}

ORACLE_SQL: dict[str, str] = {
    "op12_phrase_collocations": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
size AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT * FROM f WHERE k >= 2),
inside AS (
    SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN candidates x ON x.lang = c.lang AND x.k > c.k AND 100 * x.a >= 100 * c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ')),
kept AS (SELECT * FROM candidates ANTI JOIN inside USING (lang, phrase)),
cuts AS (
    SELECT lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS front, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS back
    FROM kept, (SELECT unnest(range(1, 5)) AS j) WHERE j < k),
scored AS (
    SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, s.n, CAST((1000::HUGEINT * c.a * s.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score, j
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.front JOIN f y ON y.lang = c.lang AND y.phrase = c.back JOIN size s ON s.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest QUALIFY rank <= 2000
""",
    "op8_url_rules": r"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (
    SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path
    FROM rest),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
    SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
    FROM parsed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1
""",
}


def _centroid_sql(rounds: int = 10) -> str:
    """All rounds written out."""
    ctes = [
        "k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "e AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM k)",
        "first AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM k QUALIFY c < 8)",
        "c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM first)",
    ]
    for r in range(rounds + 1):
        # 8 * distance + number: its least is the nearest centroid, the smaller number of equals
        ctes.append(f"d{r} AS (SELECT vec_id, c, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{r} c USING (i) GROUP BY vec_id, c)")
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, min(d * 8 + c) % 8 AS c, min(d * 8 + c) // 8 AS d FROM d{r} GROUP BY vec_id)")
        if r < rounds:
            mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
            ctes.append(f"m{r} AS (SELECT c, i, CAST({mean} AS BIGINT) AS x FROM e JOIN a{r} USING (vec_id) GROUP BY c, i)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m ON m.c = o.c AND m.i = o.i)")
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) FROM c{rounds} z WHERE z.c = a.c) AS centroid_sha256
FROM a{rounds} a"""
    )


ORACLE_SQL["op11_centroid_clusters"] = _centroid_sql()
