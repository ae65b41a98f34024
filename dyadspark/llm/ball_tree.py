"""Exact top-k by inner product: ball trees over shards of the vectors, searched by branch and bound.

A node's vectors lie within `radius` of its centre, so none scores more than q . centre + |q| radius. Nodes are opened from
the highest bound down until the bound falls below the query's kth score. That score is shared: it starts from the best
among a few candidates that every task knows, and a task carries it from each shard to the next. Scores are 64-bit integers;
products of doubles are exact for all that the bound shows to stay below 2**53, and where it doesn't, integers multiply.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadspark.llm.common import written

SHARD, LEAF, BLOCK, K = 16_384, 128, 16_384, 5
#: Candidates that give each query its first kth score.
SEEDS = 1024
#: Bytes of a block of queries as doubles: wide vectors pass the driver in blocks of fewer rows.
BLOCK_BYTES = 64_000_000
EXACT, WIDEST, LEAST = 2.0**53, 2.0**63, np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinity."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whole(vectors: list[np.ndarray], scale: float, width: int) -> np.ndarray:
    """floor(scale * x) as doubles, which hold these integers and their products exactly; short vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = np.floor(scale * np.asarray(v, np.float64))[:width]
    return out


@dataclass
class Tree:
    vectors: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    span: np.ndarray
    child: np.ndarray  # of the left child; the right one follows. 0: a leaf


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.arange(len(ids))
    span, child, centre, radius = [(0, len(ids))], [0], [], []
    at = 0
    while at < len(span):
        a, b = span[at]
        own = vectors[order[a:b]]
        c = own.mean(0)
        centre.append(c)
        radius.append(np.sqrt(((own - c) ** 2).sum(1).max()))
        if b - a > leaf and radius[-1] > 0:
            d = int(np.argmax(np.ptp(own, axis=0)))
            m = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, d], m)]
            child[at] = len(span)
            span += [(a, a + m), (a + m, b)]
            child += [0, 0]
        at += 1
    return Tree(vectors[order], ids[order], np.array(centre), np.array(radius), np.array(span), np.array(child))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products with the query as 64-bit integers; beyond 64 bits, the ends of their range."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if most < EXACT:
        return (vectors @ query).astype(np.int64)
    if most < WIDEST and max(np.abs(vectors).max(), np.abs(query).max()) < WIDEST:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.nan_to_num(vectors @ query, nan=0.0, posinf=WIDEST, neginf=-WIDEST)
    return np.where(out >= WIDEST, np.iinfo(np.int64).max, np.clip(out, -WIDEST, WIDEST - 2048).astype(np.int64))


class Best:
    """The k best so far of each query: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), LEAST), np.full((n, k), np.iinfo(np.int64).max)
        self.found = np.zeros((n, k), bool)
        self.floor = np.full(n, LEAST)

    def kth(self, q: int) -> int:
        return max(int(self.score[q, -1]), int(self.floor[q]))

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.kth(q)
        if some.any():
            found = np.concatenate([self.found[q], np.ones(int(some.sum()), bool)])
            s, i = np.concatenate([self.score[q], scores[some]]), np.concatenate([self.id[q], ids[some]])
            top = np.lexsort((i, ~s, ~found))[: self.k]
            self.score[q], self.id[q], self.found[q] = s[top], i[top], found[top]


def search(tree: Tree, q: int, query: np.ndarray, own: int, best: Best) -> None:
    with np.errstate(over="ignore", invalid="ignore"):
        bound = tree.centre @ query + np.sqrt(query @ query) * tree.radius
        bound += 1e-6 * (1 + np.abs(bound))
    bound = np.nan_to_num(bound, nan=np.inf)
    heap = [(-bound[0], 0)]
    while heap:
        least, node = heapq.heappop(heap)
        if -least < best.kth(q):
            return
        if tree.child[node]:
            for c in (tree.child[node], tree.child[node] + 1):
                heapq.heappush(heap, (-bound[c], int(c)))
        else:
            a, b = tree.span[node]
            ids, scores = tree.ids[a:b], products(tree.vectors[a:b], query)
            if (ids == own).any():
                ids, scores = ids[ids != own], scores[ids != own]
            best.offer(q, scores, ids)


def _floors(ids: np.ndarray, queries: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k of the seeds other than its own reach, if there are k."""
    out = np.full(len(ids), LEAST)
    for i in range(len(ids) if len(seed_ids) >= k else 0):
        scores = products(seeds, queries[i])[seed_ids != ids[i]]
        if len(scores) >= k:
            out[i] = np.partition(scores, -k)[-k]
    return out


def _collected(df: DataFrame) -> tuple[np.ndarray, list]:
    got = df.toArrow()
    return got.column(0).to_numpy(), list(got.column(1).to_numpy())


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = K, scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank int, vec_id, score long: each query's k best rows of vectors other than those with its own id.

    Queries needn't be rows of vectors. Vectors that are null or hold null, NaN or infinity take no part, on either side, nor
    do null ids. Vectors of different lengths meet as if the shorter ended in zeros. Of queries with one id the least vector
    asks; candidates with one id all stand. Fewer than k candidates give as many rows; without queries or candidates there
    are none. Scores are exact within 64 bits and stand at the range's ends beyond. No other column is read.

    Queries pass the driver in blocks of about `block` rows, fewer where vectors are wide (BLOCK_BYTES), one at a time: each is
    a job over all vectors, whose best rows are written before the next begins. SEEDS candidates at most pass it, too.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = pick(vectors), pick(queries).groupBy("id").agg(F.min("v").alias("v"))
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    block = max(1, min(block, BLOCK_BYTES // (8 * max(1, width))))
    seed_ids, seed_vectors = _collected(rows.limit(SEEDS)) if n else (np.zeros(0, np.int64), [])
    out = None
    for i in range(-(-n // block)):
        ids, own = _collected(asked.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // block))) == i))
        width = max(map(len, own), default=0)
        q = whole(own, scale, width)
        shared = spark.sparkContext.broadcast((ids, q, _floors(ids, q, seed_ids, whole(seed_vectors, scale, width), k)))
        found = written(rows.mapInArrow(_searcher(shared, scale, k), "query_id long, vec_id long, score long"), "best")
        shared.destroy()
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # k rows a query and task at most
    return out.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, scale: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, floor = shared.value
        best = Best(len(ids), k)
        best.floor = floor

        def shard(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
            tree = build(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
            for j in range(len(ids)):
                search(tree, j, q[j], int(ids[j]), best)

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                held.append((part.column(0).to_numpy(), whole(part.column(1).to_numpy(zero_copy_only=False), scale, q.shape[1])))
                n += part.num_rows
                if n >= SHARD:
                    shard(held)
                    held, n = [], 0
        if held:
            shard(held)
        j, r = np.nonzero(best.found)
        cols = [pa.array(ids[j]), pa.array(best.id[j, r]), pa.array(best.score[j, r])]
        yield pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])

    return run
