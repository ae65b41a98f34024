"""From raw documents to packed training sequences, in five stages of the operators in dyadspark.llm.

A stage begins by deleting what the stages before it have left in the shared folder and its documents don't read: nothing, if they
are still a plan over it; all, once they have been written and read back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.llm import jaccard_join, line_dedup, packing, quality, substring_dedup
from dyadspark.llm.common import owned, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    @wraps(f)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with owned(spark, "pipeline", docs):
            return f(spark, docs, sf_dir)

    return tidy


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF predicts to be good, fitted to `labels`; texts that are empty or null get its prior.

    Repeated rows fare alike, null ids are scored like any; no documents give none. Without labels all stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return quality.good(docs, model, "doc_id", "text")


@stage
def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand in over a tenth of their source's documents; sources that are null keep all.

    Each row counts, repeated ones too; null texts stay null and empty ones empty, as do texts that lose every line.
    """
    return _recounted(line_dedup.line_dedup(docs, "text", F.col("source")))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a Jaccard similarity of 0.8 or more, the least id.

    Repeated rows and rows that share the least id leave one; rows without words, null texts among them, all stay.
    """
    return jaccard_join.one_of_each(docs, "doc_id", "text")


@stage
def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 35 words or more that recur; one that loses all its words stays with what is left.

    Passages are judged on the input, so all copies go, repeated rows' among them. Null texts stay null.
    """
    return _recounted(substring_dedup.without_passages(docs, "text"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; null and empty texts are an end token, no documents no rows."""
    return packing.best_fit_packing(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack),
]

#: The classifier can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with owned(spark, "pipeline documents", docs):  # frees the documents of the step before the last
            docs = written(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
