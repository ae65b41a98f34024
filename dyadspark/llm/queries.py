"""The queries opN_<name> and pipeline, and what of them SQL can say."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm import ball_tree, fingerprint, jaccard_join, language_id, line_dedup, ngram_lm, packing, piece_bpe, quality, substring_dedup, suffix_dedup, whitening
from dyadspark.llm.common import fold, table

#: Where a page's markup ends a line of text.
PAGE_LINES = r"\n|</(?:p|li|h1|title|div|nav|footer|article|head|script|style)>|<br>"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_groups(docs, "doc_id", "text", 4, (85, 100)).drop("text")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = line_dedup.line_dedup(pages, "html", line_dedup.host_of(F.col("url")), PAGE_LINES, counts=("n_lines", "n_removed"))
    return out.select("page_id", "n_lines", "n_removed", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, html, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '') AS host,
         string_split_regex(html, '\n|</(?:p|li|h1|title|div|nav|footer|article|head|script|style)>|<br>') AS parts
  FROM pages),
l AS (SELECT DISTINCT host, rid, trim(x) AS line FROM (SELECT host, rid, unnest(parts) AS x FROM p WHERE host IS NOT NULL) WHERE trim(x) <> ''),
t AS (SELECT host, count(*) AS total FROM p WHERE host IS NOT NULL GROUP BY host),
b AS (SELECT l.host, list(line) AS boiler FROM (SELECT host, line, count(*) AS n FROM l GROUP BY host, line) l JOIN t USING (host)
      WHERE n >= 3 AND n > 0.1 * total GROUP BY l.host),
k AS (SELECT p.*, CASE WHEN boiler IS NULL THEN parts ELSE list_filter(parts, lambda x: trim(x) = '' OR NOT list_contains(boiler, trim(x))) END AS kept
      FROM p LEFT JOIN b USING (host))
SELECT page_id, CAST(coalesce(len(list_filter(parts, lambda x: trim(x) <> '')), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(list_filter(parts, lambda x: trim(x) <> '')) - len(list_filter(kept, lambda x: trim(x) <> '')), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN len(kept) = len(parts) THEN html ELSE array_to_string(kept, chr(10)) END, '')) AS kept_sha256
FROM k
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    out = quality.classify(docs, model, "doc_id", "text")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_bpe.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ball_tree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding")


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.best_fit_packing(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, "doc_id", "text", "lang")
    out = language_id.predict(docs.select("doc_id", "text"), model, "text")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_document_fingerprints": op2_document_fingerprints,
        "op3_line_dedup": op3_line_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_language_id": op12_language_id,
    }


def oracle_sql() -> dict:
    import corpus_pipeline

    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | {"op3_line_dedup": OP3_SQL, "op8_exact_top_k": OP8_SQL}
