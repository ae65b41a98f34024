"""Queries over state sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.operators import align, states
from dyadspark.plans.registry import query, rounded
from dyadspark.sources import fixtures as fx
from dyadspark.sources.fixtures import PAIRS_SQL, STATES_SQL

RUNS_SQL = STATES_SQL + """,
runs AS (SELECT *, sum(chg) OVER (PARTITION BY dyad, person ORDER BY pos) - 1 AS run FROM (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY dyad, person ORDER BY pos) = state THEN 0 ELSE 1 END AS chg FROM states))"""
D = "CAST(21600.0 AS DOUBLE)"


@query(f"WITH {RUNS_SQL} SELECT dyad, person, CAST(run AS BIGINT) AS run, state, min(bin) * {D} AS start_time, (max(bin) + 1) * {D} AS end_time, (max(bin) + 1 - min(bin)) * {D} AS duration FROM runs GROUP BY ALL")
def state_runs(spark: SparkSession, sf: str) -> DataFrame:
    return states.durations(fx.states(spark, sf), fx.BIN)


@query(f"""WITH {STATES_SQL}, c AS (SELECT dyad, person, state, nxt, count(*) AS n FROM (SELECT *, lead(state) OVER (PARTITION BY dyad, person ORDER BY pos) AS nxt FROM states) WHERE nxt IS NOT NULL GROUP BY ALL),
g AS (SELECT a.dyad, a.person, a.state, b.state AS nxt FROM (SELECT DISTINCT dyad, person, state FROM states) a JOIN (SELECT DISTINCT dyad, person, state FROM states) b USING (dyad, person))
SELECT g.dyad, g.person, g.state, g.nxt AS next, coalesce(n, 0) AS n, round(coalesce(CAST(coalesce(n, 0) AS DOUBLE) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g.dyad, g.person, g.state), 0), 0), 6) AS share FROM g LEFT JOIN c USING (dyad, person, state, nxt)""")
def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(states.transitions(fx.states(spark, sf)).select("dyad", "person", "state", "next", F.col("n").cast("long").alias("n"), "share"))


@query(f"""WITH {STATES_SQL} SELECT dyad, person, state, count(*) AS n_timepoints, round(avg(signal), 6) AS signal_mean, round(stddev_pop(signal), 6) AS signal_sd, count(*) * {D} AS duration_seconds,
round(count(*) / sum(count(*)) OVER (PARTITION BY dyad, person), 6) AS proportion FROM states GROUP BY dyad, person, state""")
def state_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(states.profiles(fx.states(spark, sf), ["signal"], fx.BIN))


SUMMARY = "count(*) AS n_bins, avg(signal) AS mean, coalesce(stddev_samp(signal), 0) AS sd"


@query(f"""WITH {STATES_SQL}, s AS (SELECT dyad, person, state, {SUMMARY} FROM states GROUP BY ALL), e AS (SELECT *, CASE WHEN n_bins > 1 THEN sd / sqrt(n_bins) ELSE 0 END AS sem FROM s)
SELECT dyad, person, state, n_bins, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sem, 6) AS sem, round(mean - 1.96 * sem, 6) AS ci_lower, round(mean + 1.96 * sem, 6) AS ci_upper FROM e""")
def state_signal_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(states.signal_summary(fx.states(spark, sf), "signal"))


SLOPES_SQL = RUNS_SQL + f""",
slopes AS (SELECT dyad, person, run, state, count(signal) AS n, regr_slope(signal, bin * {D}) AS slope FROM runs GROUP BY ALL HAVING count(signal) >= 3)"""


@query(f"WITH {SLOPES_SQL} SELECT dyad, person, CAST(run AS BIGINT) AS run, state, n, round(slope * 1e6, 4) + 0.0 AS slope FROM slopes")
def segment_slopes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(states.segment_slopes(fx.states(spark, sf), "signal", fx.BIN).withColumn("slope", F.col("slope") * 1e6), 4)


@query(f"""WITH {SLOPES_SQL} SELECT s.dyad, s.person, s.state, round(avg(slope) * 1e6, 4) + 0.0 AS mean_slope, round(stddev_samp(slope) * 1e6, 4) + 0.0 AS sd_slope, count(slope) AS n_segments FROM (SELECT DISTINCT dyad, person, state FROM states) s LEFT JOIN slopes USING (dyad, person, state) GROUP BY ALL""")
def state_slope_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.states(spark, sf)
    out = states.slope_summary(states.segment_slopes(s, "signal", fx.BIN), s)
    return rounded(out.select("dyad", "person", "state", (F.col("mean_slope") * 1e6).alias("mean_slope"), (F.col("sd_slope") * 1e6).alias("sd_slope"), "n_segments"), 4)


@query(f"""WITH {STATES_SQL}, e AS (SELECT dyad, person, state, CAST(row_number() OVER (PARTITION BY dyad, person ORDER BY avg(abs(signal)), state) AS INTEGER) AS label FROM states GROUP BY dyad, person, state)
SELECT s.dyad, s.person, bin, e.label AS state FROM states s JOIN e USING (dyad, person, state)""")
def states_by_energy(spark: SparkSession, sf: str) -> DataFrame:
    return states.by_energy(fx.states(spark, sf), ["signal"]).select("dyad", "person", "bin", "state")


@query()
def state_min_duration(spark: SparkSession, sf: str) -> DataFrame:
    return states.min_duration(fx.states(spark, sf).select("dyad", "person", "pos", "bin", "state"), 3 * fx.BIN, fx.BIN)


@query("""WITH c AS (SELECT l_returnflag AS g, CAST(l_linenumber AS BIGINT) AS n_states, sum(l_extendedprice) / (1 + l_linenumber * l_linenumber) AS BIC FROM lineitem GROUP BY l_returnflag, l_linenumber),
n AS (SELECT *, (n_states - min(n_states) OVER w) / CAST(max(n_states) OVER w - min(n_states) OVER w AS DOUBLE) AS kn, (BIC - min(BIC) OVER w) / (max(BIC) OVER w - min(BIC) OVER w) AS bn FROM c WINDOW w AS (PARTITION BY g)),
y AS (SELECT *, first_value(bn) OVER w AS y0, last_value(bn) OVER w AS y1 FROM n WINDOW w AS (PARTITION BY g ORDER BY n_states ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, round(abs((y1 - y0) * kn - bn + y0) / sqrt(1 + power(y1 - y0, 2)), 12) AS d FROM y)
SELECT g, n_states AS selected, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d DESC, n_states) AS k FROM d) WHERE k = 1""")
def elbow_select(spark: SparkSession, sf: str) -> DataFrame:
    l = fx.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").cast("long").alias("n_states")).agg(F.sum("l_extendedprice").alias("s"))
    return rounded(states.elbow(l.withColumn("BIC", F.col("s") / (1 + F.col("n_states") * F.col("n_states"))), ["g"]))


@query("SELECT k, CAST(k - 1 + k * (k - 1) + k * 3 + k * 3 * 4 / 2 AS DOUBLE) AS n_full, CAST(k - 1 + k * (k - 1) + k * 3 + k * 3 AS BIGINT) AS n_diag FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS k FROM lineitem)")
def hmm_parameter_count(spark: SparkSession, sf: str) -> DataFrame:
    k = fx.table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("k")).distinct()
    return k.select("k", states.hmm_parameters(F.col("k"), 3, "full").cast("double").alias("n_full"), states.hmm_parameters(F.col("k"), 3, "diag").cast("long").alias("n_diag"))


@query(f"""WITH {PAIRS_SQL}, n AS (SELECT *, max(pos) OVER (PARTITION BY dyad, dimension) + 1 AS n, avg(a) OVER (PARTITION BY dyad, dimension ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS mean FROM pair)
SELECT dyad, dimension, pos, round(mean, 5) + 0.0 AS mean FROM n WHERE pos <= n - 8""")
def rolling_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(align.rolling_mean(fx.pairs(spark, sf), ["dyad", "dimension"], 8, "a").select("dyad", "dimension", F.col("pos").cast("long").alias("pos"), "mean"), 5)


@query(f"WITH {STATES_SQL} SELECT dyad, person, bin * {D} AS time_seconds, CAST(bin AS BIGINT) AS frame_idx, state, CAST(CASE WHEN state BETWEEN 1 AND 3 THEN [0.5, 0.25, 0.125][state] END AS DOUBLE) AS state_probability FROM states")
def segments_table(spark: SparkSession, sf: str) -> DataFrame:
    """States with the probability of the one assigned, null where there is none for it."""
    s = fx.states(spark, sf).withColumn("probs", F.array(*map(F.lit, (0.5, 0.25, 0.125))))
    return states.segments_table(s, "probs", fx.BIN).select("dyad", "person", "time_seconds", "frame_idx", "state", "state_probability")
