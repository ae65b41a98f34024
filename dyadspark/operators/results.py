"""Results of several methods as one table, dimensions by method, and rows from nested or per-frame columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dyadspark.operators import align, describe, kernels


def stacked(tables: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """All rows under one another with the table's name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(name, F.lit(k)) for k, t in tables.items()])


def merged(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer merge: every key of any table once for each match."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), tables)


def planned(methods: dict[str, Callable[[], DataFrame]], chosen: list[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Plans of the chosen methods by name, and why the others aren't there: unknown, or what planning them raised.

    Plans are lazy, so a method that fails on data fails when its own table is read, not the others'.
    """
    plans, errors = {}, {}
    for name in chosen:
        if name not in methods:
            errors[name] = "unknown method"
            continue
        try:
            plans[name] = methods[name]()
        except Exception as e:  # whatever one method raises, the others go on
            errors[name] = f"{type(e).__name__}: {e}"
    return plans, errors


def dimensions(series: DataFrame, method: str, within: list[str], index: str = "bin", k: int = 3, groups: dict[str, list[str]] | None = None, movement: DataFrame | None = None, bin_size: float = 1.0) -> DataFrame:
    """(within, dimension, index, value, method) by every feature, grouped composites, pca, fa, ica or cluster; the reductions have the
    grouped composites as well, where groups are given. Movement energy (within, t, movement_energy), where given, is a composite
    more: it is rebinned, and the index must then be bin."""
    cols = [*within, "dimension", index, "value"]
    grouped = describe.grouped_dimensions(series, groups, within, index).select(*cols) if groups else None
    if grouped is not None and movement is not None:
        grouped = describe.with_movement(grouped, movement, series, within, bin_size).select(*cols)
    if method == "every":
        out = series.withColumnRenamed("feature", "dimension").select(*cols)
    elif method == "grouped":
        if grouped is None:
            raise ValueError("grouped dimensions need groups")
        out = grouped
    elif method == "cluster":
        out = kernels.cluster_components(series, k, within, index).withColumn("dimension", F.concat(F.lit("cluster"), F.col("cluster"))).select(*cols)
    elif method in kernels.REDUCTIONS:
        out = kernels.reduced(series, method, k, within, index).withColumnRenamed("component", "dimension").select(*cols)
        out = out if grouped is None else out.unionByName(grouped)
    else:
        raise ValueError(f"unknown method {method}")
    return out.withColumn("method", F.lit(method))


def targets(series: DataFrame, method: str, within: list[str], index: str = "bin", k: int = 3, rois: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """(within, target, index, value): the channels of a target as they are (none), means of regions (roi-average), or its
    components, named T_ and the component; cca gives the target's side against features of the same index."""
    cols = [*within, "target", index, "value"]
    if method == "none":
        return series.withColumnRenamed("feature", "target").select(*cols)
    if method == "roi-average":
        if rois is None:
            raise ValueError("regions are needed")
        return describe.roi_means(series, rois, within, index).withColumnRenamed("roi", "target").select(*cols)
    if method == "cca":
        if features is None:
            raise ValueError("features are needed")
        at = [*within, index]
        common = features.select(*at).distinct().join(series.select(*at).distinct(), at)
        x, y = (s.select(*at, "feature", "value").join(common, at, "left_semi") for s in (features, series))
        loaded = kernels.cca(x.withColumn("person", F.lit("A")).unionByName(y.withColumn("person", F.lit("B"))), k, within, index=index)
        weights = loaded.where("member = 'B'").select(*within, "component", "feature", "loading")
        z = align.z_scored(y, ["value"], [*within, "feature"]).join(weights, [*within, "feature"])
        scores = z.groupBy(*within, "component", index).agg(F.sum(F.col("value") * F.col("loading")).alias("value"))
        return scores.withColumn("target", F.concat(F.lit("T_"), F.col("component"))).select(*cols)
    if method in kernels.REDUCTIONS:
        return kernels.reduced(series, method, k, within, index).withColumn("target", F.concat(F.lit("T_"), F.col("component"))).select(*cols)
    raise ValueError(f"unknown method {method}")


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs, at any depth, as columns named by their path."""

    def leaves(schema: StructType, path: tuple[str, ...] = ()) -> list[Column]:
        out = []
        for f in schema:
            at = (*path, f.name)
            out += leaves(f.dataType, at) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at))]
        return out

    return df.select(*leaves(df.schema))


def per_frame(df: DataFrame, ids: list[str], arrays: list[str]) -> DataFrame:
    """A row a frame from arrays of one value a frame; shorter arrays end in nulls."""
    return df.select(*ids, F.posexplode(F.arrays_zip(*arrays)).alias("frame", "__x")).select(*ids, "frame", *[F.col("__x")[c].alias(c) for c in arrays])


def first_existing(df: DataFrame, candidates: list[str]) -> Column:
    """The first value that isn't null among the candidate columns that there are; null if there are none."""
    there = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def prefix_means(df: DataFrame, within: list[str], prefixes: list[str]) -> DataFrame:
    """Mean over rows of all columns that start with a prefix."""
    names = [c for c in df.columns if c not in within and c.startswith(tuple(prefixes))]
    return df.groupBy(*within).agg(*[F.avg(c).alias(c) for c in names])
