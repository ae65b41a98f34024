"""State sequences: runs, transitions, profiles, signals by state, slopes, smoothing, labels by energy and model selection."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTITY = ["dyad", "person"]


def with_runs(states: DataFrame, entity: list[str] = ENTITY, pos: str = "pos") -> DataFrame:
    """run: from 0, counts the stretches of one state in order."""
    w = Window.partitionBy(*entity).orderBy(pos)
    change = F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)
    return states.withColumn("__change", change).withColumn("run", F.sum("__change").over(w) - 1).drop("__change")


def durations(states: DataFrame, bin_size: float, entity: list[str] = ENTITY) -> DataFrame:
    """state, start_time, end_time, duration of each run; the end is that of its last bin."""
    out = with_runs(states, entity).groupBy(*entity, "run", "state").agg((F.min("bin") * F.lit(bin_size)).alias("start_time"), ((F.max("bin") + 1) * F.lit(bin_size)).alias("end_time"))
    return out.withColumn("duration", F.col("end_time") - F.col("start_time"))


def transitions(states: DataFrame, entity: list[str] = ENTITY) -> DataFrame:
    """Row-normalised transition shares for every ordered pair of an entity's states; rows without a successor are 0."""
    step = states.withColumn("next", F.lead("state").over(Window.partitionBy(*entity).orderBy("pos"))).where("next IS NOT NULL")
    counts = step.groupBy(*entity, "state", "next").agg(F.count(F.lit(1)).alias("n"))
    own = states.select(*entity, "state").distinct()
    grid = own.join(own.withColumnRenamed("state", "next"), entity)
    out = grid.join(counts, [*entity, "state", "next"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*entity, "state"))), F.lit(0.0)))


def profiles(states: DataFrame, dims: list[str], bin_size: float, entity: list[str] = ENTITY) -> DataFrame:
    """n, duration, share, and mean and population sd of each dimension by state."""
    stats = [x for d in dims for x in (F.avg(d).alias(f"{d}_mean"), F.stddev_pop(d).alias(f"{d}_sd"))]
    out = states.groupBy(*entity, "state").agg(F.count(F.lit(1)).alias("n_timepoints"), *stats)
    return out.withColumn("duration_seconds", F.col("n_timepoints") * F.lit(bin_size)).withColumn("proportion", F.col("n_timepoints") / F.sum("n_timepoints").over(Window.partitionBy(*entity)))


def signal_summary(states: DataFrame, signal: str, entity: list[str] = ENTITY) -> DataFrame:
    """n, mean, sd, sem and 95 % interval of a signal by state; a single bin has sd and sem 0."""
    out = states.where(F.col(signal).isNotNull()).groupBy(*entity, "state").agg(F.count(F.lit(1)).alias("n_bins"), F.avg(signal).alias("mean"), F.coalesce(F.stddev_samp(signal), F.lit(0.0)).alias("sd"))
    sem = F.when(F.col("n_bins") > 1, F.col("sd") / F.sqrt("n_bins")).otherwise(F.lit(0.0))
    return out.withColumn("sem", sem).withColumn("ci_lower", F.col("mean") - 1.96 * F.col("sem")).withColumn("ci_upper", F.col("mean") + 1.96 * F.col("sem"))


def segment_slopes(states: DataFrame, signal: str, bin_size: float, entity: list[str] = ENTITY) -> DataFrame:
    """Slope of the signal over time in each run with three points or more; runs are numbered over all."""
    t = F.col("bin") * F.lit(bin_size)
    out = with_runs(states, entity).groupBy(*entity, "run", "state").agg(F.count(signal).alias("n"), F.regr_slope(F.col(signal), t).alias("slope"))
    return out.where(F.col("n") >= 3)


def slope_summary(slopes: DataFrame, states: DataFrame, entity: list[str] = ENTITY) -> DataFrame:
    """Mean, sd (null under two segments) and number of slopes of every state there is."""
    agg = slopes.groupBy(*entity, "state").agg(F.avg("slope").alias("mean_slope"), F.stddev_samp("slope").alias("sd_slope"), F.count("slope").alias("n_segments"))
    return states.select(*entity, "state").distinct().join(agg, [*entity, "state"], "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))


def by_energy(states: DataFrame, dims: list[str], entity: list[str] = ENTITY) -> DataFrame:
    """States renumbered from 1 by mean absolute value of the dimensions, quietest first."""
    energy = F.avg(sum((F.abs(d) for d in dims), F.lit(0.0)) / len(dims))
    rank = states.groupBy(*entity, "state").agg(energy.alias("energy")).withColumn("label", F.row_number().over(Window.partitionBy(*entity).orderBy("energy", "state")))
    return states.join(rank.select(*entity, "state", "label"), [*entity, "state"]).drop("state").withColumnRenamed("label", "state")


def smoothed_runs(lengths: list[int], labels: list, least: int) -> list:
    """One label a point: the leftmost run under `least` joins its longer neighbour (left on ties), again and again."""
    runs = [[s, n] for s, n in zip(labels, lengths, strict=True)]
    while True:
        at = next((i for i, (_, n) in enumerate(runs) if n < least), None)
        if at is None or len(runs) == 1:
            break
        left = runs[at - 1][1] if at else 0
        right = runs[at + 1][1] if at + 1 < len(runs) else 0
        to = at - 1 if at and left >= right else at + 1
        runs[at][0] = runs[to][0]
        merged = [runs[0]]
        for s, n in runs[1:]:
            if s == merged[-1][0]:
                merged[-1][1] += n
            else:
                merged.append([s, n])
        runs = merged
    return [s for s, n in runs for _ in range(n)]


def min_duration(states: DataFrame, seconds: float, bin_size: float, entity: list[str] = ENTITY) -> DataFrame:
    """entity, pos, state after short runs have joined neighbours. The fixpoint runs on the table of runs, not of bins."""
    least = max(1, int(seconds / bin_size))
    runs = with_runs(states, entity).groupBy(*entity, "run", "state").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in states.schema}

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = pd.DataFrame({"state": smoothed_runs(pdf.n.tolist(), pdf.state.tolist(), least)})
        out["pos"] = [p + k for p, n in zip(pdf.pos, pdf.n, strict=True) for k in range(n)]
        for e in entity:
            out[e] = pdf[e].iloc[0]
        return out[[*entity, "pos", "state"]]

    schema = ", ".join([*(f"{e} {kinds[e]}" for e in entity), "pos long", f"state {kinds['state']}"])
    return runs.groupBy(*entity).applyInPandas(smooth, schema)


def elbow(selection: DataFrame, within: list[str], k: str = "n_states", score: str = "BIC") -> DataFrame:
    """The k farthest from the line through the first and last point of the score curve, both axes scaled to [0, 1]."""
    w = Window.partitionBy(*within)
    o = w.orderBy(k).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kn = (F.col(k) - F.min(k).over(w)) / F.when(F.max(k).over(w) > F.min(k).over(w), F.max(k).over(w) - F.min(k).over(w))
    bn = (F.col(score) - F.min(score).over(w)) / F.when(F.max(score).over(w) > F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w))
    x = selection.withColumn("kn", kn).withColumn("bn", bn).withColumn("n", F.count(F.lit(1)).over(w))
    x = x.withColumn("y0", F.first("bn").over(o)).withColumn("y1", F.last("bn").over(o))
    d = F.round(F.abs((F.col("y1") - F.col("y0")) * F.col("kn") - F.col("bn") + F.col("y0")) / F.sqrt(1 + F.pow(F.col("y1") - F.col("y0"), 2)), 12)
    best = F.row_number().over(w.orderBy(F.desc("d"), k))
    return x.withColumn("d", d).where((F.col("n") >= 3) & F.col("d").isNotNull()).withColumn("__k", best).where("__k = 1").select(*within, F.col(k).alias("selected"), F.col("d").alias("distance"))


def hmm_parameters(n_states, n_features, covariance: str):
    """Free parameters of a Gaussian HMM: start, transitions, means and covariances by type."""
    base = (n_states - 1) + n_states * (n_states - 1) + n_states * n_features
    cov = {"full": n_states * n_features * (n_features + 1) / 2, "diag": n_states * n_features, "spherical": n_states, "tied": n_features * (n_features + 1) / 2}[covariance]
    return base + cov




def segments_table(states: DataFrame, probabilities: str, bin_size: float) -> DataFrame:
    """time_seconds, frame_idx and state_probability of each bin: the assigned state's element, null beyond the array."""
    t = F.col("bin") * F.lit(bin_size)
    p = F.when((F.col("state") >= 1) & (F.col("state") <= F.size(probabilities)), F.element_at(probabilities, F.col("state")))
    return states.withColumn("time_seconds", t).withColumn("frame_idx", F.floor(t / bin_size)).withColumn("state_probability", p)
