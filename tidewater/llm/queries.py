"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import chat, collocations, cosine, decontaminate, jaccard, lloyd, pii, quality, token_counts, token_files, topk, toxicity, transducer
from tidewater.llm.common import new_path

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"
#: For the registered query only; users bring their own key.
PII_KEY = b"tidewater example key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), 4096)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), quality.fold(F.col("doc_id"), 4) == 2
    network = quality.train(docs, _table(spark, sf_dir, "labels"), held_out)
    return quality.quality_scores(docs, network).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size("items").cast("long").alias("n_items"), "items")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    windows = chat.chat_windows(rows.unionByName(extra), public_tokenizers.path(PIECES), budget=2048, history=256)
    return chat.window_digests(windows)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), percent=75, size=5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), quality.fold(F.col("doc_id"), 5) == 0
    field = toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out)
    return toxicity.toxicity(docs, field).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans",
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(
        _table(spark, sf_dir, "documents"), new_path(spark, "token-files"), public_tokenizers.path(BYTES), end_id=0
    )
    return token_files.read_token_files(spark, files)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep_ids=False)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", F.size("pii").cast("long").alias("n_pii"), "pii", "text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=100, top=2000)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.95)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, size=64, seed=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_topk": op2_exact_topk,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_chat_windows": op5_chat_windows,
    "op6_jaccard": op6_jaccard,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_pii": op10_pii,
    "op11_collocations": op11_collocations,
    "op12_near_vectors": op12_near_vectors,
    "op13_centroids": op13_centroids,
}

#: Rounds of Lloyd's algorithm, each as two common table expressions.
LLOYD_ROUNDS = "".join(
    f"""
        a{i} AS MATERIALIZED (
          SELECT vec_id, x, arg_min(c, (d, c)) AS c FROM (
            SELECT x.vec_id, x.x, c.c, list_sum(list_transform(range(1, 65), lambda i: (x.x[i] - c.x[i]) ** 2)) AS d FROM x, c{i} c)
          GROUP BY ALL
        ), m{i} AS (
          SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i
        ), c{i + 1} AS MATERIALIZED (
          SELECT c.c, coalesce(f.x, c.x) AS x FROM c{i} c
          LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{i} GROUP BY c) f USING (c)
        ),"""
    for i in range(10)
)

ORACLE: dict[str, str] = {
    "op6_jaccard": """
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS items
          FROM d
        ), c AS (SELECT items, min(doc_id) AS v FROM (SELECT doc_id, list_sort(items) AS items FROM s WHERE len(items) > 0) GROUP BY items),
        e AS (SELECT v, len(items) AS n, unnest(items) AS item FROM c),
        r AS (SELECT item FROM e GROUP BY item HAVING count(*) > 1),
        p AS (
          SELECT a.v AS a, b.v AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
          FROM e a JOIN r USING (item) JOIN e b USING (item) WHERE a.v <> b.v GROUP BY a.v, b.v
        ), l AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
        reach(v, u) AS (SELECT v, v FROM c UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.u),
        m AS (SELECT v, min(u) AS u FROM reach GROUP BY v)
        SELECT s.doc_id, len(s.items) AS n_shingles, coalesce(m.u, s.doc_id) AS component_id
        FROM s LEFT JOIN c ON list_sort(s.items) = c.items LEFT JOIN m ON m.v = c.v""",
    "op2_exact_topk": """
        WITH e AS (
          SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
          FROM e q JOIN e x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
        ), r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",    "op11_collocations": r"""
        WITH p AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (
          SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k:
            list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS g FROM w
        ), f AS MATERIALIZED (SELECT lang, g, count(*) AS a FROM g GROUP BY lang, g HAVING count(*) >= 100),
        s AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        longer AS (
          SELECT x.lang, x.g[i:i + k - 1] AS g, max(x.a) AS a
          FROM f x, (SELECT unnest(range(2, 5)) AS k) ks, (SELECT unnest(range(1, 5)) AS i) st
          WHERE len(x.g) > k AND i + k - 1 <= len(x.g) GROUP BY ALL
        ), c AS (
          SELECT f.lang, f.g, f.a FROM f LEFT JOIN longer l ON l.lang = f.lang AND l.g = f.g
          WHERE len(f.g) > 1 AND (l.a IS NULL OR 100 * l.a < 100 * f.a)
        ), t AS (
          SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, s.n, (1000 * c.a::HUGEINT * s.n) // (x.a::HUGEINT * y.a) AS score
          FROM c JOIN s USING (lang), (SELECT unnest(range(1, 5)) AS k) ks, f x, f y
          WHERE k < len(c.g) AND x.lang = c.lang AND x.g = c.g[1:k] AND y.lang = c.lang AND y.g = c.g[k + 1:]
        ), b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM t),
        r AS (
          SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score,
                 row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
          FROM b WHERE o = 1
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000""",
    "op12_near_vectors": """
        WITH RECURSIVE e AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS MATERIALIZED (
          SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
        ), reach(v, u) AS (SELECT DISTINCT a, a FROM l UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.u),
        m AS (SELECT v, min(u) AS u FROM reach GROUP BY v), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT t.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.u, t.vec_id) AS component_id, coalesce(m.u, t.vec_id) = t.vec_id AS kept
        FROM embeddings t LEFT JOIN m ON m.v = t.vec_id LEFT JOIN n ON n.a = t.vec_id""",
    "op13_centroids": f"""
        WITH x AS MATERIALIZED (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM x ORDER BY sha256('3:' || vec_id) LIMIT 8
        ),{LLOYD_ROUNDS} z AS (
          SELECT vec_id, CAST(arg_min(c, (d, c)) AS INTEGER) AS cluster, CAST(min(d) AS BIGINT) AS distance FROM (
            SELECT x.vec_id, c.c, list_sum(list_transform(range(1, 65), lambda i: (x.x[i] - c.x[i]) ** 2)) AS d FROM x, c10 c)
          GROUP BY vec_id
        )
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.x, ',')) AS centroid_sha256
        FROM z JOIN c10 ON c10.c = z.cluster""",
}
