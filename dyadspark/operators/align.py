"""Long series: binning, densifying, filtering, filling, pairing, z-scores, sliding windows and resampling.

series: entity columns, feature, t (seconds), value. binned: bin instead of t. pair: dyad, dimension, pos, bin, a, b.
Missing is null throughout. Everything after the first aggregation is keyed by entity and feature, so one shuffle serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY = ["dyad", "person"]


def bin_series(series: DataFrame, bin_size: float, entity: list[str] = ENTITY) -> DataFrame:
    """Mean of each feature in bins floor(t / bin_size); bin_time is a bin's start."""
    b = F.floor(F.col("t") / F.lit(float(bin_size))).cast("long")
    return series.groupBy(*entity, "feature", b.alias("bin")).agg(F.avg("value").alias("value")).withColumn("bin_time", F.col("bin") * F.lit(float(bin_size)))


def densify(binned: DataFrame, entity: list[str] = ENTITY) -> DataFrame:
    """A row for each of an entity's bins and features; null where there was none.

    A bin's features meet in one map, and the entity's names are laid over it: one small join on the entity, no grid.
    """
    wide = binned.groupBy(*entity, "bin").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("__cells"))
    names = binned.groupBy(*entity).agg(F.collect_set("feature").alias("__names"))
    out = wide.join(names, entity).select(*entity, F.explode("__names").alias("feature"), "bin", "__cells")
    return out.withColumn("value", F.try_element_at("__cells", F.col("feature"))).drop("__cells")


def time_varying(dense: DataFrame, most_missing: float = 0.5, entity: list[str] = ENTITY) -> DataFrame:
    """Rows of features that vary and aren't missing in more than the share of their entity's bins."""
    kept = dense.groupBy(*entity, "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg(F.col("value").isNull().cast("double")).alias("gone"))
    return dense.join(kept.where((F.col("lo") < F.col("hi")) & (F.col("gone") <= most_missing)).select(*entity, "feature"), [*entity, "feature"], "left_semi")


def filled(dense: DataFrame, entity: list[str] = ENTITY, order: str = "bin") -> DataFrame:
    """Forward, then backward fill."""
    w = Window.partitionBy(*entity, "feature").orderBy(order)
    before = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return dense.withColumn("value", F.coalesce(before, after))


def pairs(filled_series: DataFrame, dyad: str = "dyad", person: str = "person", names: tuple[str, str] = ("A", "B")) -> DataFrame:
    """A's and B's values in the bins and features that both have; pos counts a dyad's common bins from 0.

    One aggregation puts both side by side, in place of a self join.
    """
    of = lambda who, c: F.max(F.when(F.col(person) == who, c))
    both = filled_series.groupBy(dyad, F.col("feature").alias("dimension"), "bin").agg(of(names[0], F.col("value")).alias("a"), of(names[1], F.col("value")).alias("b"), of(names[0], F.lit(1)).alias("__a"), of(names[1], F.lit(1)).alias("__b"))
    both = both.where("__a = 1 AND __b = 1").drop("__a", "__b")
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(dyad, "dimension").orderBy("bin")) - 1)


def with_target(binned: DataFrame, target: DataFrame, entity: list[str]) -> DataFrame:
    """Feature bins that the target has as well: entity, dimension, pos, bin, a (feature), b (target)."""
    both = binned.withColumnRenamed("feature", "dimension").withColumnRenamed("value", "a").join(target.withColumnRenamed("value", "b"), [*entity, "bin"])
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(*entity, "dimension").orderBy("bin")) - 1)


def z_scored(df: DataFrame, columns: list[str], within: list[str], ddof: int = 0) -> DataFrame:
    """(x - mean) / sd within groups; x - mean where nothing varies (ddof 1: 0)."""
    w = Window.partitionBy(*within)
    out = {}
    for c in columns:
        sd = (F.stddev_samp if ddof else F.stddev_pop)(c).over(w)
        flat = F.min(c).over(w) == F.max(c).over(w)
        centred = F.col(c) - F.avg(c).over(w)
        out[c] = F.when(flat, F.lit(0.0)).otherwise(F.try_divide(centred, sd))
    return df.withColumns(out)


def sliding(df: DataFrame, within: list[str], width: int, step: int, pos: str = "pos") -> DataFrame:
    """Each row once for every window that holds it: window (index), start, stop. Full windows each step, and one partial.

    The windows of a position follow from arithmetic, so there is no range join.
    """
    n = F.max(pos).over(Window.partitionBy(*within)) + 1
    full = F.when(n >= width, F.floor((n - width) / step) + 1).otherwise(0)
    last = F.when(full * step < n, full).otherwise(full - 1)
    lo = F.greatest(F.lit(0), F.ceil((F.col(pos) - width + 1) / F.lit(step)))
    hi = F.least(F.floor(F.col(pos) / step), F.col("__last"))
    out = df.withColumn("__n", n).withColumn("__last", last.cast("long"))
    out = out.withColumn("window", F.explode(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long")))))
    start = F.col("window") * step
    return out.withColumn("start", start).withColumn("stop", F.least(start + width, F.col("__n"))).drop("__n", "__last")


def rolling_mean(df: DataFrame, within: list[str], width: int, column: str = "value", pos: str = "pos") -> DataFrame:
    """Mean of each full window of `width` rows, stride 1, at its first row."""
    w = Window.partitionBy(*within).orderBy(pos)
    n = F.max(pos).over(Window.partitionBy(*within)) + 1
    out = df.withColumn("__n", n).withColumn("mean", F.avg(column).over(w.rowsBetween(0, width - 1)))
    return out.where(F.col(pos) <= F.col("__n") - width).drop("__n")


def negate_left(series: DataFrame, facing: Column, prefixes: tuple[str, ...] = ("GMP_world_x_", "GMP_land_x_", "pf_facerectx")) -> DataFrame:
    """x-axis features mirrored where the subject faces left; other or unknown directions change nothing."""
    x_axis = F.lit(False)
    for p in prefixes:
        x_axis = x_axis | F.col("feature").startswith(p)
    return series.withColumn("value", F.when((facing == "left") & x_axis, -F.col("value")).otherwise(F.col("value")))


def chosen(series: DataFrame, patterns: list[str]) -> DataFrame:
    """Features that match one of the globs; the patterns are translated in the planner."""
    import fnmatch

    any_of = F.lit(False)
    for p in patterns:
        any_of = any_of | F.col("feature").rlike("^" + fnmatch.translate(p).replace("(?s:", "(?:").replace("\\z", "\\Z").replace("\\Z", "$"))
    return series.where(any_of)


def interpolated(points: DataFrame, grid: DataFrame, within: list[str], x: str, y: str) -> DataFrame:
    """Linear interpolation of points at the grid's x; beyond the ends the end values hold. Null y are no points.

    Both are laid in one order and looked at forward and back by windows: no inequality join.
    """
    known = points.where(F.col(y).isNotNull()).select(*within, F.col(x).alias("__x"), F.col(y).alias("__y"), F.lit(False).alias("__ask"))
    asked = grid.select(*within, F.col(x).alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(True).alias("__ask"))
    w = Window.partitionBy(*within).orderBy("__x", "__ask")
    p = F.when(~F.col("__ask"), F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))
    out = known.unionByName(asked).withColumn("l", F.last(p, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("r", F.first(p, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("__ask")
    between = F.col("l.y") + (F.col("r.y") - F.col("l.y")) * F.try_divide(F.col("__x") - F.col("l.x"), F.col("r.x") - F.col("l.x"))
    value = F.when(F.col("l").isNull(), F.col("r.y")).when(F.col("r").isNull() | (F.col("l.x") == F.col("r.x")) | (F.col("l.x") == F.col("__x")), F.col("l.y")).otherwise(between)
    return out.select(*within, F.col("__x").alias(x), value.alias(y))


def audio_at_frames(values: Column, n_frames: Column, fps: Column, hop: int = 512, rate: int = 16000) -> Column:
    """An array of one value an audio hop at the times of video frames, linear in between; beyond its ends the end values hold.

    The place of a frame in the array follows from its number, so nothing is joined. Null under two values.
    """
    last = F.size(values) - 1

    def at(k: Column) -> Column:
        x = F.least(k / fps * F.lit(rate / hop), last.cast("double"))
        i = F.least(F.floor(x).cast("int"), last - 1)
        left, right = F.element_at(values, i + 1), F.element_at(values, i + 2)
        return left + (right - left) * (x - i)

    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), n_frames.cast("int") - 1), at))


def frame_tracks(samples: DataFrame, recordings: DataFrame, within: list[str], frame: str, value: str, n_frames: str) -> DataFrame:
    """within, frame_idx, value for each frame of recordings (within, n_frames): as many samples as frames are taken as they come;
    others, two at least, are interpolated at the frame numbers, the end values holding beyond. Recordings with one sample have no rows.
    """
    counts = samples.groupBy(*within).agg(F.count(F.lit(1)).alias("__n")).join(recordings.select(*within, n_frames), within)
    whole = samples.join(counts.where(F.col("__n") == F.col(n_frames)).select(*within), within, "left_semi")
    place = F.row_number().over(Window.partitionBy(*within).orderBy(frame)) - 1
    taken = whole.select(*within, place.cast("double").alias("frame_idx"), F.col(value).cast("double").alias("value"))
    sparse = counts.where((F.col("__n") != F.col(n_frames)) & (F.col("__n") >= 2))
    grid = sparse.select(*within, F.explode(F.transform(F.sequence(F.lit(0), F.col(n_frames).cast("int") - 1), lambda k: k.cast("double"))).alias("frame_idx"))
    some = samples.join(sparse.select(*within), within, "left_semi").select(*within, F.col(frame).cast("double").alias("frame_idx"), F.col(value).cast("double").alias("value"))
    return taken.unionByName(interpolated(some, grid, within, "frame_idx", "value")).withColumn("frame_idx", F.col("frame_idx").cast("long"))


def frame_grid(recordings: DataFrame, within: list[str], n_frames: str, fps: str) -> DataFrame:
    """frame_idx 0 to n - 1 and time_seconds of each recording."""
    return recordings.select(*within, fps, F.explode(F.sequence(F.lit(0), F.col(n_frames) - 1)).alias("frame_idx")).select(*within, "frame_idx", (F.col("frame_idx") / F.col(fps)).alias("time_seconds"))


def sampled_frames(frames: DataFrame, every: int, frame: str = "frame_idx") -> DataFrame:
    return frames.where(F.col(frame) % every == 0)


def spread_frames(recordings: DataFrame, within: list[str], n_frames: str, most: int) -> DataFrame:
    """At most `most` frames a recording, evenly spread from first to last, rounded down."""
    k = F.least(F.col(n_frames), F.lit(most))
    i = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(k > 1, F.floor(j * (F.col(n_frames) - 1) / (k - 1))).otherwise(0).cast("int"))
    return recordings.select(*within, F.explode(i).alias("frame_idx"))


def broadcast_scalars(frames: DataFrame, scalars: DataFrame, within: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """Finite scalar features of a recording on every frame; the named and `osm_` ones are left out."""
    kept = scalars.where(~F.col("feature").isin(*skip) & ~F.col("feature").startswith("osm_") & (~F.isnan("value")) & (F.abs("value") != float("inf")))
    return frames.join(kept, within)


def segments_of(df: DataFrame, within: list[str], order: str, k: int) -> DataFrame:
    """segment 0 to k - 1 by position; the first ones are one longer where k doesn't divide."""
    return df.withColumn("segment", F.ntile(k).over(Window.partitionBy(*within).orderBy(order)) - 1)


def chunks_of(df: DataFrame, index: str, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(index) / size).cast("long"))
