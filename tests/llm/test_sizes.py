"""Settings that bound a task, forced so small that the tables of tests exceed them: results stay as they are."""

import numpy as np
from pyspark.sql import functions as F
from tests.conftest import DATA

from dyadspark.llm import ball_tree, jaccard_join, line_dedup, ngram_lm, recurrence, suffix_dedup
from dyadspark.llm.textvec import in_parts


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")


def test_in_parts():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64) << np.uint64(1))
    for bits in (1, 6, 40):
        cut = in_parts(keys, bits)
        assert [p for p in cut for _ in range(cut[p][1] - cut[p][0])] == [int(k) >> (64 - bits) for k in keys]
        assert list(cut) == sorted(cut) and len(cut) <= len(keys)
    assert in_parts(keys[:0], 6) == {}


def test_language_model_of_more_parts_than_keys(spark, monkeypatch):
    """A batch asks the parts that it has keys of, so many parts cost no more than its keys."""
    want = {r.id: r for r in ngram_lm.score_documents(_docs(spark), "doc_id", "text").collect()}
    monkeypatch.setattr(ngram_lm, "PARTS", 1 << 10)
    got = {r.id: r for r in ngram_lm.score_documents(_docs(spark), "doc_id", "text").collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        w = want[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (w.held_out, w.n_tokens, w.n_known, w.train_tokens)
        assert abs(r.base_score - w.base_score) < 1e-6 and abs(r.score - w.score) < 1e-3


def test_jaccard_join_of_many_parts(spark, monkeypatch):
    want = _rows(jaccard_join.jaccard_groups(_docs(spark), "doc_id", "text"))
    monkeypatch.setattr(jaccard_join, "PARTS", 1 << 9)
    assert _rows(jaccard_join.jaccard_groups(_docs(spark), "doc_id", "text")) == want


def test_top_k_in_blocks_of_bytes(spark, monkeypatch):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 10 = 0")
    want = _rows(ball_tree.top_k(vectors, asked, "vec_id", "embedding"))
    passes, written = [], ball_tree.written
    monkeypatch.setattr(ball_tree, "written", lambda df, what: (passes.append(what), written(df, what))[1])
    monkeypatch.setattr(ball_tree, "BLOCK_BYTES", 8 * 64 * 5)
    assert _rows(ball_tree.top_k(vectors, asked, "vec_id", "embedding")) == want
    assert len(passes) > 1


def test_line_dedup_shares(spark, monkeypatch):
    """A share stops growing with the table, and hosts that are dealt out stay fewer than LARGEST."""
    assert [line_dedup.share_of(n) for n in (0, 5_000, 10**6, 10**8, 10**10)] == [1, 5, 1000, 20_000, 100_000]
    pages = spark.read.parquet(f"{DATA}/documents.parquet")
    want = _rows(line_dedup.line_dedup(pages, "text", F.col("source")))
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    monkeypatch.setattr(line_dedup, "PAGES", 7)
    monkeypatch.setattr(line_dedup, "SHARES", 2)
    assert _rows(line_dedup.line_dedup(pages, "text", F.col("source"))) == want


def test_recurrence_in_parts_of_texts(spark, monkeypatch):
    want = _rows(suffix_dedup.dedup(_docs(spark), "text"))
    monkeypatch.setattr(recurrence, "TEXTS", 3)
    assert _rows(suffix_dedup.dedup(_docs(spark), "text")) == want
