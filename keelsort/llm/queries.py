"""The queries of this package's operators over the standard tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelsort.llm import backoff, bpe, chosen, cover, fuzzy_lines, lsm, pack, pages, rabit, toxic

#: Folder of public tokenizer files; never copied.
TOKENIZERS = os.environ.get("KEELSORT_TOKENIZERS", "/opt/tokenizers")


def word_bpe() -> str:
    """Path of the word-end BPE file: the installed package's, else the folder's."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/word_bpe_49k.json"
    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.near_lines(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return rabit.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.removal_digests(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen.near_groups(table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), word_bpe())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxic.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return toxic.scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(table(spark, sf_dir, "documents"), word_bpe())


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
}

ORACLES = {
    "op2_lm_scoring": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), t AS (
            SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d
        ), g AS (
            SELECT doc_id, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] END AS w0 FROM t
        ), u AS (SELECT w1, count(*) AS c FROM g GROUP BY w1),
        b AS (SELECT w0, w1, count(*) AS c FROM g WHERE w0 IS NOT NULL GROUP BY w0, w1),
        s AS (
            SELECT g.doc_id,
                   CASE WHEN b.c >= 2 THEN ln(b.c / x.c::DOUBLE)
                        ELSE ln(u.c / (SELECT count(*) FROM g)::DOUBLE) + CASE WHEN g.w0 IS NULL THEN 0 ELSE ln(0.4) END END AS score,
                   CASE WHEN g.w0 IS NOT NULL AND b.c < 2 THEN 1 ELSE 0 END AS off
            FROM g JOIN u ON u.w1 = g.w1 LEFT JOIN b ON b.w0 = g.w0 AND b.w1 = g.w1 LEFT JOIN u AS x ON x.w1 = g.w0
        ), p AS (SELECT doc_id, count(*) AS n_words, sum(off) AS n_backoff, sum(score) AS score FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff, round(coalesce(score, 0), 4) AS log_score
        FROM d LEFT JOIN p USING (doc_id)""",
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d""",
    "op5_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
        ), g AS (
            SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM s
        ), m AS (
            SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM g
        ), gone AS (
            SELECT DISTINCT doc_id, i + j AS word_no FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM m WHERE least < doc_id)
        ), r AS (
            SELECT doc_id, list(word_no) AS ats FROM gone GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ats), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(list_filter(w, lambda x, p: ats IS NULL OR NOT list_contains(ats, p)), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)""",
    "op6_minhash_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ), r AS (
            SELECT doc_id, doc_id AS node FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node
        ), c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op3_nearest_neighbours": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v JOIN v AS q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
