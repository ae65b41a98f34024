"""The queries' own windows on a whole table by brute force, wide vectors, and repeated rows of a large host."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.conftest import DATA

from dyadspark.llm import ball_tree, line_dedup
from dyadspark.llm import queries as Q


def test_suffix_dedup_at_400_bytes(spark):
    """Every window of 400 bytes of every document, by Python's own hash of the bytes."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    seen = Counter(hash(t[i : i + 400]) for t in docs.values() for i in range(len(t) - 399))
    got = {r.doc_id: r for r in Q.op7_suffix_array_dedup(spark, DATA).collect()}
    assert set(got) == set(docs)
    removed = 0
    for i, t in docs.items():
        gone = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
        removed += int(mask.sum())
    assert removed > 0


def test_top_k_of_wide_vectors(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(0, 1, (40, 3000)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(v)], "vec_id long, v array<float>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ball_tree.top_k(df, df.where("vec_id % 10 = 0"), "vec_id", "v", block=2).collect()}
    x = np.floor(256 * v.astype(float)).astype(np.int64)
    for q in range(0, 40, 10):
        s = x @ x[q]
        best = sorted((i for i in range(40) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(s[i])) for i in best]


def test_line_dedup_of_equal_rows_in_a_large_host(spark, monkeypatch):
    """Rows that are alike in every column share a salt; each counts, on the path for many boilerplate lines too."""
    rows = [(1, "h", "menu\nbody")] * 40 + [(k, "h", f"menu\nbody {k}") for k in range(2, 30)] + [(99, "g", "menu")] * 2
    df = spark.createDataFrame(rows, "page_id long, host string, html string").repartition(4)
    want = sorted((r.page_id, r.html) for r in line_dedup.line_dedup(df, "html", F.col("host")).collect())
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    got = sorted((r.page_id, r.html) for r in line_dedup.line_dedup(df, "html", F.col("host")).collect())
    assert got == want and len(got) == len(rows) and (1, "") in got and (2, "body 2") in got
