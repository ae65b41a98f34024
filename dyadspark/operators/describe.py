"""Descriptives, composites and functionals of recordings: one aggregation each over long series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadspark.functions.columns import finite
from dyadspark.operators import crossed

#: Feature groups by prefix.
GROUPS = ("oc_", "lbrs_", "osm_", "GMP_", "pf_", "eln_")


def unpivoted(wide: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    """Numeric columns as rows (ids, feature, value)."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    columns = columns or [c for c, k in wide.dtypes if c not in ids and (k in kinds or k.startswith("decimal"))]
    return wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, "feature", "value")


def descriptives(series: DataFrame, entity: list[str]) -> DataFrame:
    """mean, sd, min, max, median, skewness, excess kurtosis (population, over two values and variance), shares of zeros and gaps."""
    v = finite(F.col("value"))
    shape = lambda f: F.when((F.count(v) > 2) & (F.min(v) < F.max(v)), f(v))
    return series.groupBy(*entity, "feature").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"), shape(F.skewness).alias("skewness"), shape(F.kurtosis).alias("kurtosis"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("variance"),
        F.coalesce(100 * F.avg((v == 0).cast("double")), F.lit(100.0)).alias("percent_zero"), (100 * F.avg(F.when(v.isNull(), 1.0).otherwise(0.0))).alias("percent_nan"), F.coalesce(F.min(v) == F.max(v), F.lit(True)).alias("is_constant"),
    )


def feature_groups(described: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """n_features, mean variance, mean range and number of constant features by prefix; groups without features are left out."""
    prefix = reduce(lambda acc, g: acc.when(F.col("feature").startswith(g), g), groups[1:], F.when(F.col("feature").startswith(groups[0]), groups[0]))
    return described.withColumn("prefix", prefix).where("prefix IS NOT NULL").groupBy("prefix").agg(F.count(F.lit(1)).alias("n_features"), F.avg("variance").alias("mean_variance"), F.avg(F.col("max") - F.col("min")).alias("mean_range"), F.count_if("is_constant").alias("n_constant"))


def correlation_matrix(dense: DataFrame, within: list[str], index: str) -> DataFrame:
    """r of each two features of an entity, by blocks of a whole-numbered index: rows in proportion to bins, none a pair and bin."""
    x = dense.withColumn("pos", F.col(index).cast("long"))
    out = crossed.correlations(x, x.withColumnRenamed("feature", "target"), within, symmetric=True)
    return out.select(*within, F.col("dimension").alias("feature_a"), F.col("target").alias("feature_b"), F.col("correlation").alias("r"))


def movement_energy(landmarks: DataFrame, within: list[str], point: str, frame: str, axes: list[str]) -> DataFrame:
    """Mean over landmarks of the step length since the last frame; a landmark's first frame counts 0."""
    w = Window.partitionBy(*within, point).orderBy(frame)
    step = F.sqrt(sum((F.pow(F.coalesce(F.col(a) - F.lag(a).over(w), F.lit(0.0)), 2) for a in axes), F.lit(0.0)))
    return landmarks.withColumn("__step", step).groupBy(*within, frame).agg(F.avg("__step").alias("movement_energy"))


def composite(binned: DataFrame, within: list[str], index: str, name: str) -> DataFrame:
    """Mean over features of their z-scores (sample sd; 0 where a feature is constant)."""
    w = Window.partitionBy(*within, "feature")
    sd = F.when(F.min("value").over(w) < F.max("value").over(w), F.stddev_samp("value").over(w))
    z = F.coalesce(F.try_divide(F.col("value") - F.avg("value").over(w), sd), F.when(F.col("value").isNotNull(), F.lit(0.0)))
    return binned.withColumn("__z", z).groupBy(*within, index).agg(F.avg("__z").alias(name))


def roi_means(series: DataFrame, rois: DataFrame, within: list[str], index: str) -> DataFrame:
    """Mean of each region's channels; rois: roi, feature."""
    return series.join(rois, "feature").groupBy(*within, index, "roi").agg(F.avg("value").alias("value"))


def functionals(frames: DataFrame, within: list[str], index: str = "i", value: str = "value") -> DataFrame:
    """Mean, spread, percentiles, relative places of extremes, and the regression line's slope, intercept and error."""
    v, i = F.col(value), F.col(index).cast("double")
    q = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    names = ["p1", "p5", "quartile1", "quartile2", "quartile3", "p95", "p99"]
    out = frames.where(v.isNotNull()).groupBy(*within).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.array(*map(F.lit, q))).alias("__q"),
        F.min_by(i, F.struct(v, i)).alias("__min"), F.max_by(i, F.struct(v, -i)).alias("__max"), F.regr_slope(v, i).alias("slope"), F.regr_intercept(v, i).alias("intercept"), F.regr_syy(v, i).alias("__syy"), F.regr_sxy(v, i).alias("__sxy"), F.regr_sxx(v, i).alias("__sxx"),
    )
    out = out.select(*within, "n", "mean", "std", "min", "max", *[F.col("__q")[k].alias(n) for k, n in enumerate(names)], (F.col("__min") / F.col("n")).alias("minPos"), (F.col("__max") / F.col("n")).alias("maxPos"), "slope", "intercept",
                     F.sqrt(F.greatest(F.lit(0.0), F.col("__syy") - F.coalesce(F.try_divide(F.col("__sxy") * F.col("__sxy"), F.col("__sxx")), F.lit(0.0))) / F.col("n")).alias("rmse"))
    return out.withColumn("range", F.col("max") - F.col("min")).withColumn("iqr", F.col("quartile3") - F.col("quartile1"))


def array_summary(values: Column, most: int = 20) -> list[Column]:
    """mean, std (population), min, max over the finite elements of an array, and the elements where there are few."""
    v = F.filter(F.transform(values, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    n = F.size(v)
    mean = F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), n)
    var = F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), n) - mean * mean
    std = F.sqrt(F.greatest(F.lit(0.0), var))
    return [mean.alias("mean"), std.alias("std"), F.array_min(v).alias("min"), F.array_max(v).alias("max"), F.when(F.size(values) <= most, values).alias("elements")]


def large_array_json(values: Column, most: int = 1000, step: int = 10) -> Column:
    """An array as JSON; a long one as its statistics, length and every `step`-th element."""
    mean, std, low, high, _ = array_summary(values)
    some = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / step)).cast("int")), lambda i: F.element_at(values, (i * step + 1).cast("int")))
    return F.when(F.size(values) > most, F.to_json(F.struct(mean, std, low, high, F.size(values).alias("shape"), some.alias("samples")))).otherwise(F.to_json(values))


def frame_differences(frames: DataFrame, within: list[str], index: str, value: str = "value") -> DataFrame:
    """Change since the last frame; the first is 0."""
    return frames.withColumn("diff", F.coalesce(F.col(value) - F.lag(value).over(Window.partitionBy(*within).orderBy(index)), F.lit(0.0)))


def volume_pitch(frames: DataFrame, within: list[str], order: str, amplitude: str, pitch: str) -> DataFrame:
    """Loudness in dB of the greatest amplitude (80 dB below it at least), pitch in semitones from 440 Hz over voiced frames
    (above 50 Hz), both with spread, extremes and frame-to-frame change; 0 where there is no voiced frame or no change."""
    w, o = Window.partitionBy(*within), Window.partitionBy(*within).orderBy(order)
    db = F.greatest(F.lit(-80.0), 20 * F.log10(F.greatest(F.col(amplitude), F.lit(1e-5)) / F.greatest(F.max(amplitude).over(w), F.lit(1e-5))))
    semitone = F.when(F.col(pitch) > 50, 12 * F.log2(F.col(pitch) / 440))
    x = frames.withColumn("__v", db).withColumn("__p", semitone)
    before = F.last("__p", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1))  # the voiced frame before
    x = x.withColumn("__dv", F.col("__v") - F.lag("__v").over(o)).withColumn("__dp", F.col("__p") - before)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    of = lambda c, d, n: [zero(F.avg(c)).alias(n), zero(F.stddev_pop(c)).alias(f"{n}_std"), zero(F.max(c)).alias(f"{n}_max"), zero(F.min(c)).alias(f"{n}_min"), zero(F.avg(F.abs(d))).alias(f"{n}_diff"), zero(F.stddev_pop(d)).alias(f"{n}_diff_std")]
    out = x.groupBy(*within).agg(*of("__v", "__dv", "oc_audvol"), *of("__p", "__dp", "oc_audpit"))
    return out.withColumn("oc_audpit_range", F.col("oc_audpit_max") - F.col("oc_audpit_min"))


def framed_rms(samples: DataFrame, within: list[str], index: str, value: str, hop: int) -> DataFrame:
    """Root mean square and zero crossings of each hop."""
    w = Window.partitionBy(*within).orderBy(index)
    x = samples.withColumn("frame", F.floor(F.col(index) / hop).cast("long")).withColumn("__cross", F.when(F.signum(value) * F.signum(F.lag(value).over(w)) < 0, 1.0).otherwise(0.0))
    return x.groupBy(*within, "frame").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.avg("__cross").alias("zero_crossing_rate"))


def first_present(rows: DataFrame, within: list[str], order: str, columns: list[str]) -> DataFrame:
    """The first value of each column that isn't null, by an explicit order."""
    return rows.groupBy(*within).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def merged_sources(rows: DataFrame, within: list[str], priority: str) -> DataFrame:
    """One row for each name, of the source that comes first."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*within).orderBy(priority))).where("__k = 1").drop("__k")


def batch_summary(dense: DataFrame, entity: list[str], index: str, dims: list[str], bin_size: float) -> DataFrame:
    """duration, n_frames, n_features, and mean_ and var_ (population) of each given dimension; one conditional aggregation."""
    of = lambda d: F.when(F.col("feature") == d, F.col("value"))
    return dense.groupBy(*entity).agg(
        ((F.max(index) - F.min(index) + 1) * F.lit(bin_size)).alias("duration"), F.count_distinct(index).alias("n_frames"), F.count_distinct("feature").alias("n_features"),
        *[x for d in dims for x in (F.avg(of(d)).alias(f"mean_{d}"), F.var_pop(of(d)).alias(f"var_{d}"))],
    )


#: Statistics looked for in the names of functionals, in lower case.
STATISTICS = (
    "mean", "stddev", "skewness", "kurtosis", "percentile1.0", "percentile5.0", "percentile25.0", "percentile50.0", "percentile75.0", "percentile95.0", "percentile99.0",
    "min", "max", "minPos", "maxPos", "range", "quartile1", "quartile3", "interquartileRange", "linregc1", "linregc2", "linregerr",
)


def by_statistic(rows: DataFrame, within: list[str], name: str, value: str) -> DataFrame:
    """Mean of all functionals whose lower-case name holds a statistic's; statistics written with capitals thus match none."""
    found = F.filter(F.array(*map(F.lit, STATISTICS)), lambda s: F.contains(F.lower(name), s))
    return rows.select(*within, F.explode(found).alias("statistic"), F.col(value).alias("__v")).groupBy(*within, "statistic").agg(F.avg("__v").alias("value"))


def loudness(rms: Column) -> Column:
    """Loudness by frame, from the root mean square."""
    return F.pow(F.lit(2.0), 20 * F.log10(rms + 1e-8) / 10 - 40) / 10


def spectral_decrease(spectrum: Column) -> Column:
    """Mean change from the first magnitude, weighted by 1 / k, over the sum of all others; 0 for one magnitude, null where they are 0."""
    first, rest = spectrum[0], F.slice(spectrum, F.lit(2), F.greatest(F.size(spectrum) - 1, F.lit(1)))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(spectrum) > 1, F.try_divide(add(F.transform(rest, lambda x, i: (x - first) / (i + 1))), add(rest))).otherwise(F.lit(0.0))


def stretched(duration: Column, frames: Column, ratio: float) -> list[Column]:
    """Duration and whole frames of a signal stretched by a ratio."""
    return [(duration * ratio).alias("output_duration_sec"), F.floor(frames * F.lit(float(ratio))).cast("long").alias("output_nframes")]


def shapes(frames: DataFrame, within: list[str], value: str = "value") -> DataFrame:
    """Skewness and excess kurtosis (population) of functionals; null without variance."""
    v = F.col(value)
    of = lambda f: F.when(F.min(v) < F.max(v), f(v))
    return frames.where(v.isNotNull()).groupBy(*within).agg(of(F.skewness).alias("skewness"), of(F.kurtosis).alias("kurtosis"))


def with_movement(composites: DataFrame, movement: DataFrame, bins: DataFrame, within: list[str], bin_size: float) -> DataFrame:
    """Composites (within, dimension, bin, value) and movement energy (within, t, movement_energy) as one more of them, first by name
    in the order of groups: the mean of its bins, where an entity's other features (bins: within, bin) have a row as well."""
    own = F.floor(F.col("t") / F.lit(float(bin_size))).cast("long").alias("bin")
    binned = movement.groupBy(*within, own).agg(F.avg("movement_energy").alias("value"))
    common = binned.join(bins.select(*within, "bin").distinct(), [*within, "bin"], "left_semi")
    return common.withColumn("dimension", F.lit("movement_energy")).unionByName(composites)


def grouped_dimensions(series: DataFrame, groups: dict[str, list[str]], within: list[str], index: str) -> DataFrame:
    """One composite a group of features by prefix, all groups in one pass; a feature counts in the first group that takes it."""
    name = None
    for group, prefixes in groups.items():
        takes = reduce(lambda a, b: a | b, [F.col("feature").startswith(p) for p in prefixes])
        name = F.when(takes, group) if name is None else name.when(takes, group)
    named = series.withColumn("dimension", name).where(F.col("dimension").isNotNull())
    return composite(named, [*within, "dimension"], index, "value")
