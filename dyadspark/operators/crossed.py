"""Correlations of all features with all targets at all lags, by blocks of positions.

A block of positions is a matrix of features and one of targets, with as many positions more on either side as there are lags.
It gives sums of products for all pairs and lags at once; r follows from the sums over blocks. A row for each pair, lag and block
is what moves: in proportion to the positions divided by the block, where a self join would make a row for each pair and position.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadspark.functions.special import r_p

BLOCK = 512
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def positions(features: DataFrame, targets: DataFrame, within: list[str], on: list[str], index: str = "bin") -> tuple[DataFrame, DataFrame]:
    """Both with pos, which counts from 0 the indexes of an entity (within) that features and targets have both.

    on: columns of the targets that single out an entity's, a part of within or none; targets come back by entity.
    """
    both = features.select(*within, index).distinct().join(targets.select(*on, index).distinct(), [*on, index])
    both = both.withColumn("pos", F.row_number().over(Window.partitionBy(*within).orderBy(index)) - 1)
    return features.join(both, [*within, index]), targets.join(both, [*on, index])


def _matrix(names: np.ndarray, pos: np.ndarray, values: np.ndarray, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, and a matrix positions x names with NaN where there is no value."""
    own, at = np.unique(names.astype(str), return_inverse=True)
    out = np.full((size, len(own)), np.nan)
    out[pos - first, at] = values
    return own, out


def _extremes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest x (columns) where y has a value (rows: columns of y); without any, inf and -inf."""
    low, high = np.empty((y.shape[1], x.shape[1])), np.empty((y.shape[1], x.shape[1]))
    a, b = np.where(np.isnan(x), np.inf, x), np.where(np.isnan(x), -np.inf, x)
    has = ~np.isnan(y)
    whole = has.all(0)
    low[whole], high[whole] = a.min(0, initial=np.inf), b.max(0, initial=-np.inf)
    for k in np.flatnonzero(~whole):
        low[k], high[k] = a[has[:, k]].min(0, initial=np.inf), b[has[:, k]].max(0, initial=-np.inf)
    return low, high


def block_sums(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """For each column of x (rows) and of y (columns): number, sums and products of complete pairs, and extremes of both."""
    hx, hy = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    x0, y0 = np.nan_to_num(x), np.nan_to_num(y)
    low_x, high_x = _extremes(x, y)
    low_y, high_y = _extremes(y, x)
    return {
        "n": hx.T @ hy, "sx": x0.T @ hy, "sy": hx.T @ y0, "sxx": (x0 * x0).T @ hy, "syy": hx.T @ (y0 * y0), "sxy": x0.T @ y0,
        "lx": low_x.T, "hx": high_x.T, "ly": low_y, "hy": high_y,
    }


def _centred(long: DataFrame, within: list[str], name: str) -> DataFrame:
    """Less the mean of each series, so that no large squares are subtracted."""
    return long.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*within, name)))


def correlations(features: DataFrame, targets: DataFrame, within: list[str], low: int = 0, high: int = 0, block: int = BLOCK, symmetric: bool = False) -> DataFrame:
    """within, dimension, target, lag, n, correlation: r of each feature at pos with each target at pos + lag.

    features: within, feature, pos, value; targets: within, target, pos, value; one value a position. r is null under three
    complete pairs or where one side doesn't vary; pairs and lags without any complete pair are left out. symmetric: only
    pairs with dimension <= target, for features against themselves.
    """
    x = _centred(features, within, "feature").select(*within, F.col("feature").alias("name"), "pos", F.col("value").cast("double").alias("value"), F.lit(0).alias("side"), F.floor(F.col("pos") / block).alias("block"))
    ends = F.sequence(F.floor((F.col("pos") - high) / block), F.floor((F.col("pos") - low) / block))
    y = _centred(targets, within, "target").select(*within, F.col("target").alias("name"), "pos", F.col("value").cast("double").alias("value"), F.lit(1).alias("side"), F.explode(ends).alias("block"))
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    columns = ["dimension", "target", "lag", *SUMS, "lx", "hx", "ly", "hy"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in within], "dimension string", "target string", "lag int", *[f"{c} double" for c in columns[3:]]])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = int(key[-1]) * block
        side = rows["side"].to_numpy()
        name, pos, value = rows["name"].to_numpy(), rows["pos"].to_numpy(), rows["value"].to_numpy(float)
        a, left = _matrix(name[side == 0], pos[side == 0], value[side == 0], first, block)
        b, right = _matrix(name[side == 1], pos[side == 1], value[side == 1], first + low, block + high - low)
        parts = []
        for lag in range(low, high + 1) if len(a) and len(b) else []:
            s = block_sums(left, right[lag - low : lag - low + block])
            i, j = np.nonzero((s["n"] > 0) & (a[:, None] <= b[None, :] if symmetric else True))
            parts.append(pd.DataFrame({"dimension": a[i], "target": b[j], "lag": lag} | {k: v[i, j] for k, v in s.items()}))
        out = pd.concat(parts) if parts else pd.DataFrame({c: [] for c in columns})
        for k, c in enumerate(within):
            out[c] = key[k]
        return out[[*within, *columns]].astype({c: object for c in [*within, "dimension", "target"]})

    parts = x.unionByName(y).groupBy(*within, "block").applyInPandas(run, schema)
    sums = parts.groupBy(*within, "dimension", "target", "lag").agg(*[F.sum(c).alias(c) for c in SUMS], F.min("lx").alias("lx"), F.max("hx").alias("hx"), F.min("ly").alias("ly"), F.max("hy").alias("hy"))
    return sums.select(*within, "dimension", "target", "lag", F.col("n").cast("long").alias("n"), _r().alias("correlation"))


def _r() -> Column:
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy, xy = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n, F.col("sxy") - sx * sy / n
    varies = reduce(lambda a, b: a & b, [n >= 3, F.col("lx") < F.col("hx"), F.col("ly") < F.col("hy"), vx > 0, vy > 0])
    return F.when(varies, xy / F.sqrt(vx * vy))


def with_p(correlated: DataFrame, bin_size: float) -> DataFrame:
    """The two-sided p of each r, and the lag in seconds."""
    return correlated.withColumn("p", r_p(F.col("correlation"), F.col("n"))).withColumn("lag_seconds", F.col("lag") * F.lit(float(bin_size)))
