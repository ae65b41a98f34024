"""Statistics over all pairs of vectors of a group, by pairs of blocks: no pair is a row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
#: Pairs of blocks that a task computes at about.
TASK = 64
#: Squared distances under this share of the squared lengths are taken from differences.
NEAR = 1e-3


def block_statistics(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[int, float, float, float, float, float]:
    """pairs, sums of distance, cosine and its square, least and greatest cosine over rows of a with rows of b (same: i < j)."""
    square_a, square_b = (a * a).sum(1), (b * b).sum(1)
    take = np.triu(np.ones((len(a), len(a)), bool), 1) if same else np.ones((len(a), len(b)), bool)
    n = int(take.sum())
    if not n:
        return 0, 0.0, 0.0, 0.0, np.inf, -np.inf
    dot, length, both = a @ b.T, np.sqrt(square_a)[:, None] * np.sqrt(square_b), square_a[:, None] + square_b
    cosine = np.divide(dot, length, out=np.zeros(dot.shape), where=length > 0)[take]
    square = both - 2 * dot
    # near copies would lose their digits in dot products: their distances are of differences, as are those of what isn't finite
    i, j = np.nonzero(take & ~(square >= NEAR * both))
    step = max(1, 4_000_000 // max(1, a.shape[1]))
    for k in range(0, len(i), step):
        p, q = i[k : k + step], j[k : k + step]
        square[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    distance = np.sqrt(square[take])
    return n, float(distance.sum()), float(cosine.sum()), float((cosine * cosine).sum()), float(cosine.min()), float(cosine.max())


def pair_statistics(vectors: DataFrame, within: list[str], key: list[str], vector: str, block: int = BLOCK) -> DataFrame:
    """within, n, n_pairs, mean_distance, and mean, sd (population), least and greatest cosine over all pairs of a group's vectors.

    A group's rows are dealt to blocks by a hash of their key and each block meets each: a row goes to as many tasks as its group
    has blocks, and one row of sums comes back from each two. All pairs are quadratic work: tasks are as many as the pairs of blocks
    ask for, so that one stays as long as it is. Rows that share a key share a block. Groups of one vector have 0 pairs, distance 0 and null cosines; null vectors
    take no part; a vector of zeros has cosine 0 with any. Vectors of a group have one length.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(*within, F.xxhash64(*key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    # counts of the sizes that blocks are made for: one small row a group
    sizes = rows.groupBy(*within).agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = rows.join(sizes.drop("n"), within).withColumn("own", F.pmod("key", F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*within, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "v")
    pairs = sizes.agg(F.sum(F.col("blocks").cast("double") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    dealt = dealt.repartition(max(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK)), *within, "p", "q")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    sums = "pairs long, d double, c double, cc double, low double, high double"

    def run(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        p, q = key[-2:]
        own = got["own"].to_numpy()
        a = np.array(got["v"][own == p].tolist(), float)
        b = a if p == q else np.array(got["v"][own == q].tolist(), float)
        s = block_statistics(a, b, p == q) if len(a) and len(b) else (0, 0.0, 0.0, 0.0, np.inf, -np.inf)
        return pd.DataFrame([[*key[:-2], *s]], columns=[*within, "pairs", "d", "c", "cc", "low", "high"]).astype({c: object for c in within})

    parts = dealt.groupBy(*within, "p", "q").applyInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in within], sums]))
    total = parts.groupBy(*within).agg(*[F.sum(c).alias(c) for c in ("pairs", "d", "c", "cc")], F.min("low").alias("low"), F.max("high").alias("high"))
    n = F.col("pairs")
    mean = F.try_divide(F.col("c"), n)
    out = sizes.drop("blocks").join(total, within)
    return out.select(
        *within, "n", n.alias("n_pairs"), F.coalesce(F.try_divide(F.col("d"), n), F.lit(0.0)).alias("mean_distance"), mean.alias("mean_cosine"),
        F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("cc"), n) - mean * mean))).alias("sd_cosine"), F.when(n > 0, F.col("low")).alias("min_cosine"), F.when(n > 0, F.col("high")).alias("max_cosine"),
    )


def spread(vectors: DataFrame, within: list[str], vector: str) -> DataFrame:
    """within, n, centroid_distance, spread_variance: mean and variance (population) of the distances to the group's mean vector.

    The mean vector is one row a group, an array of means by place, which each vector then meets whole.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = vectors.where(F.col(vector).isNotNull()).select(*within, F.col(vector).cast("array<double>").alias("v"))
    centre = rows.groupBy(*within).agg(Summarizer.mean(array_to_vector("v")).alias("m")).withColumn("m", vector_to_array("m"))
    square = F.aggregate(F.zip_with("v", "m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    d = rows.join(centre, within).withColumn("d", F.sqrt(square))
    return d.groupBy(*within).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("centroid_distance"), F.var_pop("d").alias("spread_variance"))
