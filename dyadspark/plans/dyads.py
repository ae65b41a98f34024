"""Queries over pairs: alignment, lagged and windowed coupling, recurrence, information flow and coupled dynamics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.functions.columns import clip, fisher_z
from dyadspark.operators import align, synchrony
from dyadspark.operators.multiple import benjamini_hochberg
from dyadspark.plans.registry import query, rounded
from dyadspark.sources import fixtures as fx
from dyadspark.sources.fixtures import BINNED_SQL, DENSE_SQL, EVENTS_SQL, PAIRS_SQL, RAW_PAIRS_SQL, ccc_sql, corr_sql, r_p_sql

LOW, HIGH, WIDTH, STEP = -3, 3, 28, 4


@query(f"WITH {BINNED_SQL} SELECT dyad, person, feature, bin, round(value, 6) AS value, bin * CAST(21600.0 AS DOUBLE) AS bin_time FROM binned")
def bin_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fx.binned(spark, sf))


@query(f"WITH {DENSE_SQL} SELECT dyad, person, feature, bin, round(value, 6) AS value FROM dense")
def ffill_bfill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fx.dense(spark, sf))


@query(f"""WITH {DENSE_SQL}, keep AS (SELECT dyad, person, feature FROM holed GROUP BY ALL HAVING min(value) < max(value) AND avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.45)
SELECT dyad, person, feature, count(*) AS bins, count(value) AS present FROM holed JOIN keep USING (dyad, person, feature) GROUP BY ALL""")
def filter_timevarying(spark: SparkSession, sf: str) -> DataFrame:
    kept = align.time_varying(align.densify(fx.binned(spark, sf)), 0.45)
    return kept.groupBy("dyad", "person", "feature").agg(F.count(F.lit(1)).alias("bins"), F.count("value").alias("present"))


@query(f"WITH {RAW_PAIRS_SQL} SELECT dyad, dimension, bin, pos, round(a, 6) AS a, round(b, 6) AS b FROM raw")
def align_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fx.raw_pairs(spark, sf)).select("dyad", "dimension", "bin", F.col("pos").cast("long").alias("pos"), "a", "b")


@query(f"WITH {PAIRS_SQL} SELECT dyad, dimension, pos, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM pair")
def zscore_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fx.pairs(spark, sf).select("dyad", "dimension", F.col("pos").cast("long").alias("pos"), "a", "b"))


LAGGED_SQL = PAIRS_SQL + f""",
lags AS (SELECT x.dyad, x.dimension, l.lag, {corr_sql("x.a", "y.b")} AS correlation, count(*) AS n
  FROM pair x CROSS JOIN (SELECT unnest(range({LOW}, {HIGH + 1})) AS lag) l JOIN pair y ON y.dyad = x.dyad AND y.dimension = x.dimension AND y.pos = x.pos + l.lag GROUP BY ALL)"""


@query(f"WITH {LAGGED_SQL} SELECT dyad, dimension, CAST(lag AS INTEGER) AS lag, round(correlation, 6) + 0.0 AS correlation, n, round({r_p_sql("correlation", "n")}, 6) AS p, lag * CAST(21600.0 AS DOUBLE) AS lag_seconds FROM lags")
def lagged_crosscorr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synchrony.lagged_correlation(fx.pairs(spark, sf), LOW, HIGH, fx.BIN))


PEAK_SQL = LAGGED_SQL + """,
peak AS (SELECT dyad, dimension, lag, correlation, n FROM (SELECT *, row_number() OVER (PARTITION BY dyad, dimension ORDER BY abs(correlation) DESC, lag) AS k FROM lags WHERE correlation IS NOT NULL) WHERE k = 1)"""


@query(f"WITH {PEAK_SQL} SELECT dyad, dimension, CAST(lag AS INTEGER) AS lag, round(correlation, 6) AS correlation FROM peak")
def peak_corr(spark: SparkSession, sf: str) -> DataFrame:
    c = synchrony.lagged_correlation(fx.pairs(spark, sf), LOW, HIGH, fx.BIN)
    return rounded(synchrony.peaks(c, ["dyad", "dimension"]).select("dyad", "dimension", "lag", "correlation"))


DIMENSIONS = ["click", "error", "purchase", "signup", "view"]


@query(f"""WITH {PEAK_SQL} SELECT dyad, {", ".join(f"CAST(max(lag) FILTER (dimension = '{d}') AS INTEGER) AS {d}" for d in DIMENSIONS)} FROM peak GROUP BY dyad""")
def heatmap_peak(spark: SparkSession, sf: str) -> DataFrame:
    """Peak lags of all dimensions."""
    c = synchrony.lagged_correlation(fx.pairs(spark, sf), LOW, HIGH, fx.BIN)
    return synchrony.peak_matrix(synchrony.peaks(c, ["dyad", "dimension"]), "dyad", "dimension", DIMENSIONS, "lag")


@query(f"WITH {PEAK_SQL} SELECT dyad, dimension, round(atanh(greatest(-0.9999, least(0.9999, correlation))), 6) AS z, round(tanh(avg(atanh(greatest(-0.9999, least(0.9999, correlation)))) OVER (PARTITION BY dimension)), 6) AS mean_r FROM peak")
def fisher_transform(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    p = synchrony.peaks(synchrony.lagged_correlation(fx.pairs(spark, sf), LOW, HIGH, fx.BIN), ["dyad", "dimension"])
    z = fisher_z(F.col("correlation"))
    return rounded(p.select("dyad", "dimension", z.alias("z"), F.tanh(F.avg(z).over(Window.partitionBy("dimension"))).alias("mean_r")))


FDR_SQL = LAGGED_SQL + f""",
tested AS (SELECT dyad, dimension, lag, correlation, {r_p_sql("correlation", "n")} AS p FROM lags WHERE correlation IS NOT NULL),
ranked AS (SELECT *, p * count(*) OVER (PARTITION BY dyad) / row_number() OVER (PARTITION BY dyad ORDER BY p) AS x FROM tested),
fdr AS (SELECT dyad, dimension, lag, correlation, p, least(1.0, min(x) OVER (PARTITION BY dyad ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS p_fdr FROM ranked)"""


def _tested(spark: SparkSession, sf: str) -> DataFrame:
    """Lagged correlations with p, and p_fdr over all tests of a dyad."""
    c = synchrony.lagged_correlation(fx.pairs(spark, sf), LOW, HIGH, fx.BIN).where("correlation IS NOT NULL")
    return benjamini_hochberg(c, "p", ["dyad"])


@query(f"WITH {FDR_SQL} SELECT dyad, dimension, CAST(lag AS INTEGER) AS lag, round(p, 6) AS p, round(p_fdr, 6) AS p_fdr FROM fdr")
def fdr_bh(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_tested(spark, sf).select("dyad", "dimension", "lag", "p", "p_fdr"))


@query(f"""WITH {FDR_SQL} SELECT dyad, dimension, CAST(lag AS INTEGER) AS lag, round(correlation, 6) AS correlation, round(p, 6) AS p, round(p_fdr, 6) AS p_fdr FROM (SELECT *, row_number() OVER (PARTITION BY dyad, dimension ORDER BY abs(correlation) DESC, lag) AS k FROM fdr) WHERE k = 1""")
def peak_tests(spark: SparkSession, sf: str) -> DataFrame:
    """The peak of each dimension with its p and the p_fdr it has among all lags of the dyad."""
    return rounded(synchrony.peaks(_tested(spark, sf), ["dyad", "dimension"]).select("dyad", "dimension", "lag", "correlation", "p", "p_fdr"))


WINDOWS_SQL = PAIRS_SQL + f""",
size AS (SELECT dyad, dimension, max(pos) + 1 AS n FROM pair GROUP BY ALL),
shape AS (SELECT *, CASE WHEN n >= {WIDTH} THEN (n - {WIDTH}) // {STEP} + 1 ELSE 0 END AS n_full FROM size),
win AS (SELECT dyad, dimension, n, unnest(range(0, n_full + CASE WHEN n_full * {STEP} < n THEN 1 ELSE 0 END)) AS "window" FROM shape),
held AS (SELECT dyad, dimension, "window", "window" * {STEP} AS start, least("window" * {STEP} + {WIDTH}, n) AS stop FROM win),
swept AS (SELECT h.dyad, h.dimension, h."window", h.start, l.lag, {corr_sql("x.a", "y.b")} AS r, {ccc_sql("x.a", "y.b")} AS ccc
  FROM held h CROSS JOIN (SELECT unnest(range({LOW}, {HIGH + 1})) AS lag) l JOIN pair x ON x.dyad = h.dyad AND x.dimension = h.dimension AND x.pos >= h.start AND x.pos < h.stop
  LEFT JOIN pair y ON y.dyad = h.dyad AND y.dimension = h.dimension AND y.pos = x.pos + l.lag AND y.pos >= h.start AND y.pos < h.stop GROUP BY ALL)"""


def _peaks_sql(of: str) -> str:
    return f"""top AS (SELECT dyad, dimension, "window", start, {of} AS peak, lag AS peak_lag FROM (SELECT *, row_number() OVER (PARTITION BY dyad, dimension, "window" ORDER BY abs({of}) DESC, lag) AS k FROM swept WHERE {of} IS NOT NULL) WHERE k = 1),
best AS (SELECT s.dyad, s.dimension, s."window", s.start, peak, coalesce(peak_lag, 0) AS peak_lag FROM (SELECT DISTINCT dyad, dimension, "window", start FROM swept) s LEFT JOIN top USING (dyad, dimension, "window", start))"""


def _swept(spark: SparkSession, sf: str) -> DataFrame:
    return synchrony.windowed(fx.pairs(spark, sf), WIDTH, STEP, LOW, HIGH)


@query(f"""WITH {WINDOWS_SQL}, {_peaks_sql("r")} SELECT dyad, dimension, CAST("window" AS BIGINT) AS "window", start * CAST(21600.0 AS DOUBLE) AS window_time, round(peak, 6) AS pearson_r, CAST(peak_lag AS INTEGER) AS pearson_peak_lag FROM best""")
def windowed_pearson(spark: SparkSession, sf: str) -> DataFrame:
    p = synchrony.windowed_peaks(_swept(spark, sf))
    return rounded(p.select("dyad", "dimension", "window", (F.col("start") * fx.BIN).alias("window_time"), F.col("peak").alias("pearson_r"), F.col("peak_lag").alias("pearson_peak_lag")))


@query(f"""WITH {WINDOWS_SQL}, {_peaks_sql("r")} SELECT dyad, dimension, CAST("window" AS BIGINT) AS "window", round(peak, 6) AS crosscorr_r, CASE WHEN peak_lag > 0 THEN 'A' WHEN peak_lag < 0 THEN 'B' ELSE 'sync' END AS crosscorr_leader FROM best""")
def windowed_crosscorr(spark: SparkSession, sf: str) -> DataFrame:
    p = synchrony.windowed_peaks(_swept(spark, sf))
    return rounded(p.select("dyad", "dimension", "window", F.col("peak").alias("crosscorr_r"), synchrony.leader(F.col("peak_lag")).alias("crosscorr_leader")))


@query(f"""WITH {WINDOWS_SQL}, {_peaks_sql("ccc")} SELECT dyad, dimension, CAST("window" AS BIGINT) AS "window", round(peak, 6) AS concordance_ccc, CAST(peak_lag AS INTEGER) AS concordance_peak_lag FROM best""")
def concordance(spark: SparkSession, sf: str) -> DataFrame:
    p = synchrony.windowed_peaks(_swept(spark, sf), of="ccc")
    return rounded(p.select("dyad", "dimension", "window", F.col("peak").alias("concordance_ccc"), F.col("peak_lag").alias("concordance_peak_lag")))


@query(f"""WITH {WINDOWS_SQL}, {_peaks_sql("r")}, m AS (SELECT dyad, dimension, median(peak_lag) AS peak_lag, avg(peak) AS effect_size FROM best GROUP BY ALL)
SELECT dyad, dimension, CAST(peak_lag AS DOUBLE) AS peak_lag, round(effect_size, 6) AS effect_size, CASE WHEN peak_lag > 0 THEN 'A' WHEN peak_lag < 0 THEN 'B' ELSE 'sync' END AS leader FROM m""")
def leader_follower(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synchrony.leaders(synchrony.windowed_peaks(_swept(spark, sf))))


OVERALL_SQL = PAIRS_SQL + f""",
ov AS (SELECT dyad, dimension, {corr_sql("a", "b")} AS r, {ccc_sql("a", "b")} AS c, count(*) AS n FROM pair GROUP BY ALL)"""


@query(f"""WITH {OVERALL_SQL} SELECT dyad, dimension, round(r, 6) AS pearson_pearson_r_overall, round({r_p_sql("r", "n")}, 6) AS pearson_pearson_p_overall, round(c, 6) AS concordance_concordance_ccc_overall FROM ov""")
def overall_synchrony(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synchrony.overall(fx.pairs(spark, sf)))


@query(f"""WITH {PAIRS_SQL}, cells AS (SELECT x.dyad, x.dimension, x.pos AS i, y.pos AS j, round(abs(x.a - y.b), 9) AS d FROM pair x JOIN pair y USING (dyad, dimension)),
lim AS (SELECT dyad, dimension, quantile_cont(d, 0.1) AS lim, count(*) AS n FROM cells GROUP BY ALL),
hits AS (SELECT c.*, j - i AS k FROM cells c JOIN lim USING (dyad, dimension) WHERE d <= lim + 1e-10),
dl AS (SELECT dyad, dimension, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY dyad, dimension, k ORDER BY i) AS run FROM hits) GROUP BY dyad, dimension, k, run),
vl AS (SELECT dyad, dimension, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY dyad, dimension, j ORDER BY i) AS run FROM hits) GROUP BY dyad, dimension, j, run),
ent AS (SELECT dyad, dimension, -sum(p * ln(p + 1e-12)) AS e FROM (SELECT dyad, dimension, c / sum(c) OVER (PARTITION BY dyad, dimension) AS p FROM (SELECT dyad, dimension, len, count(*) AS c FROM dl WHERE len >= 2 GROUP BY ALL)) GROUP BY ALL),
d AS (SELECT dyad, dimension, sum(len) AS hits, coalesce(sum(len) FILTER (len >= 2) / sum(len), 0) AS det, coalesce(avg(len) FILTER (len >= 2), 0) AS l, coalesce(max(len) FILTER (len >= 2), 0) AS lmax FROM dl GROUP BY ALL),
v AS (SELECT dyad, dimension, coalesce(sum(len) FILTER (len >= 2) / sum(len), 0) AS lam, coalesce(avg(len) FILTER (len >= 2), 0) AS tt FROM vl GROUP BY ALL)
SELECT dyad, dimension, round(CAST(hits AS DOUBLE) / n, 4) AS rqa_rqa_RR, round(CAST(det AS DOUBLE), 4) AS rqa_rqa_DET, round(l, 4) AS rqa_rqa_L, CAST(lmax AS DOUBLE) AS rqa_rqa_Lmax, round(coalesce(e, 0) + 0.0, 4) AS rqa_rqa_ENTR, round(CAST(lam AS DOUBLE), 4) AS rqa_rqa_LAM, round(tt, 4) AS rqa_rqa_TT
FROM lim JOIN d USING (dyad, dimension) JOIN v USING (dyad, dimension) LEFT JOIN ent USING (dyad, dimension)""")
def rqa(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synchrony.recurrence(fx.pairs(spark, sf)), 4)


@query(f"""WITH {PAIRS_SQL}, m AS (SELECT *, a - avg(a) OVER (PARTITION BY dyad, dimension) AS ma, b - avg(b) OVER (PARTITION BY dyad, dimension) AS mb, count(*) OVER (PARTITION BY dyad, dimension) AS n FROM pair),
y AS (SELECT dyad, dimension, pos, n, sum(ma) OVER (PARTITION BY dyad, dimension ORDER BY pos) AS ya, sum(mb) OVER (PARTITION BY dyad, dimension ORDER BY pos) AS yb FROM m),
sc AS (SELECT DISTINCT dyad, dimension, s FROM (SELECT dyad, dimension, CAST(floor(power(10.0, 1 + unnest(range(0, 15)) * (log10(n // 4) - 1) / 14) + 1e-9) AS INTEGER) AS s FROM (SELECT DISTINCT dyad, dimension, n FROM y WHERE n // 4 >= 10)) WHERE s >= 4),
bx AS (SELECT y.dyad, y.dimension, s, pos // s AS box, count(*) AS c, covar_pop(ya, yb) - covar_pop(pos, ya) * covar_pop(pos, yb) / var_pop(pos) AS xy,
  covar_pop(ya, ya) - covar_pop(pos, ya) * covar_pop(pos, ya) / var_pop(pos) AS xx, covar_pop(yb, yb) - covar_pop(pos, yb) * covar_pop(pos, yb) / var_pop(pos) AS yy FROM y JOIN sc USING (dyad, dimension) GROUP BY ALL HAVING count(*) = s),
f AS (SELECT dyad, dimension, s, avg(xy) AS f2, avg(xx) AS fx, avg(yy) AS fy FROM bx GROUP BY ALL)
SELECT dyad, dimension, round(regr_slope(ln(sqrt(abs(f2)) + 1e-12), ln(s)), 4) AS dfa_exponent, round(avg(abs(f2) / (sqrt(abs(fx)) * sqrt(abs(fy)) + 1e-12)), 4) AS dfa_mean_rho FROM f GROUP BY ALL HAVING count(*) >= 3""")
def dcca(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synchrony.detrended(fx.pairs(spark, sf)), 4)


@query(f"""WITH {PAIRS_SQL}, d AS (SELECT dyad, dimension, pos, least(5, floor((a - (min(a) OVER w - 1e-10)) / ((max(a) OVER w + 1e-10 - (min(a) OVER w - 1e-10)) / 6))) AS xa, least(5, floor((b - (min(b) OVER w - 1e-10)) / ((max(b) OVER w + 1e-10 - (min(b) OVER w - 1e-10)) / 6))) AS xb FROM pair WINDOW w AS (PARTITION BY dyad, dimension)),
x AS (SELECT * FROM (SELECT *, lag(xa) OVER w AS pa, lag(xb) OVER w AS pb FROM d WINDOW w AS (PARTITION BY dyad, dimension ORDER BY pos)) WHERE pa IS NOT NULL),
g AS (SELECT dyad, dimension, grouping(xa) AS ga, grouping(xb) AS gb, grouping(pa) AS ha, grouping(pb) AS hb, count(*) AS c FROM x GROUP BY GROUPING SETS ((dyad, dimension, xb, pb), (dyad, dimension, pb), (dyad, dimension, xb, pb, pa), (dyad, dimension, pb, pa), (dyad, dimension, xa, pa), (dyad, dimension, pa), (dyad, dimension, xa, pa, pb))),
p AS (SELECT *, c / sum(c) OVER (PARTITION BY dyad, dimension, ga, gb, ha, hb) AS p FROM g),
h AS (SELECT dyad, dimension, ga, gb, ha, hb, -sum(p * log2(p + 1e-12)) AS h FROM p GROUP BY ALL),
w AS (SELECT dyad, dimension, max(h) FILTER (ga = 1 AND gb = 0 AND ha = 1 AND hb = 0) AS b_bp, max(h) FILTER (ga = 1 AND gb = 1 AND ha = 1 AND hb = 0) AS bp, max(h) FILTER (ga = 1 AND gb = 0 AND ha = 0 AND hb = 0) AS b_bp_ap,
 max(h) FILTER (ga = 1 AND gb = 1 AND ha = 0 AND hb = 0) AS hb2, max(h) FILTER (ga = 0 AND gb = 1 AND ha = 0 AND hb = 1) AS a_ap, max(h) FILTER (ga = 1 AND gb = 1 AND ha = 0 AND hb = 1) AS ap, max(h) FILTER (ga = 0 AND gb = 1 AND ha = 0 AND hb = 0) AS a_ap_bp FROM h GROUP BY ALL),
t AS (SELECT dyad, dimension, b_bp - bp - b_bp_ap + hb2 AS ab, a_ap - ap - a_ap_bp + hb2 AS ba FROM w)
SELECT dyad, dimension, round(ab, 5) + 0.0 AS te_AtoB, round(ba, 5) + 0.0 AS te_BtoA, round(ab - ba, 5) + 0.0 AS te_net, CASE WHEN round(ab - ba, 12) > 0 THEN 'A' WHEN round(ab - ba, 12) < 0 THEN 'B' ELSE 'sync' END AS te_leader FROM t""")
def transfer_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synchrony.transfer_entropy(fx.pairs(spark, sf)), 5)


@query(f"""WITH {PAIRS_SQL}, x AS (SELECT * FROM (SELECT dyad, dimension, a, b, lead(a) OVER w - a AS da, lead(b) OVER w - b AS db FROM pair WINDOW w AS (PARTITION BY dyad, dimension ORDER BY pos)) WHERE da IS NOT NULL),
s AS (SELECT dyad, dimension, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, da) AS ada, covar_pop(b, da) AS bda, covar_pop(a, db) AS adb, covar_pop(b, db) AS bdb FROM x GROUP BY ALL),
c AS (SELECT *, CASE WHEN abs(aa * bb - ab * ab) > 1e-12 THEN aa * bb - ab * ab END AS det FROM s)
SELECT dyad, dimension, round((ada * bb - bda * ab) / det, 5) + 0.0 AS damping_A, round((bda * aa - ada * ab) / det, 5) + 0.0 AS coupling_AtoB, round((bdb * aa - adb * ab) / det, 5) + 0.0 AS damping_B, round((adb * bb - bdb * ab) / det, 5) + 0.0 AS coupling_BtoA,
CASE WHEN abs(bda * aa - ada * ab) > abs(adb * bb - bdb * ab) THEN 'A' ELSE 'B' END AS coupling_leader FROM c""")
def coupled_oscillator(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synchrony.coupled_oscillator(fx.pairs(spark, sf)), 5)


@query(f"""WITH {WINDOWS_SQL}, {_peaks_sql("r")} SELECT dyad, start * CAST(21600.0 AS DOUBLE) AS time_seconds, {", ".join(f"round(max(peak) FILTER (dimension = '{d}'), 6) AS pearson_r_{d}" for d in DIMENSIONS)} FROM best GROUP BY ALL""")
def wide_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    p = synchrony.windowed_peaks(_swept(spark, sf)).withColumn("time_seconds", F.col("start") * fx.BIN).withColumnRenamed("peak", "pearson_r")
    return rounded(synchrony.wide(p, ["pearson_r"], DIMENSIONS, ["dyad", "time_seconds"]))


@query(f"""WITH {PAIRS_SQL}, size AS (SELECT dyad, dimension, count(*) AS n, {corr_sql("a", "b")} AS r, {ccc_sql("a", "b")} AS c FROM pair GROUP BY ALL),
blocks AS (SELECT dyad, dimension, perm, k, md5('0/' || perm || '/' || dyad || '/' || dimension || '/' || k) AS h, least(4, n - 4 * k) AS len FROM (SELECT *, unnest(range(0, CAST(ceil(n / 4.0) AS BIGINT))) AS k FROM (SELECT *, unnest(range(1, 1001)) AS perm FROM size))),
placed AS (SELECT *, sum(len) OVER (PARTITION BY dyad, dimension, perm ORDER BY h) - len AS start FROM blocks),
sur AS (SELECT x.dyad, x.dimension, perm, {corr_sql("y.a", "x.b")} AS r, {ccc_sql("y.a", "x.b")} AS c FROM placed p JOIN pair x ON x.dyad = p.dyad AND x.dimension = p.dimension AND x.pos // 4 = p.k JOIN pair y ON y.dyad = p.dyad AND y.dimension = p.dimension AND y.pos = p.start + x.pos % 4 GROUP BY ALL)
SELECT dyad, dimension, round((count(*) FILTER (abs(sur.r) >= abs(size.r) - 1e-12) + 1) / 1001.0, 6) AS p_pearson, round((count(*) FILTER (abs(sur.c) >= abs(size.c) - 1e-12) + 1) / 1001.0, 6) AS p_concordance FROM sur JOIN size USING (dyad, dimension) GROUP BY ALL""")
def surrogate_test(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand surrogates of each series, in blocks of a day."""
    return rounded(synchrony.surrogate_test(fx.pairs(spark, sf), 1000, 4))


@query(f"""WITH {EVENTS_SQL}, target AS (SELECT CAST(floor(t / 21600.0) AS BIGINT) AS bin, avg(value) AS b FROM ev WHERE feature = 'purchase' GROUP BY ALL),
f AS (SELECT subject, feature AS dimension, CAST(floor(t / 21600.0) AS BIGINT) AS bin, avg(value) AS a FROM ev WHERE feature <> 'purchase' GROUP BY ALL),
p AS (SELECT f.*, b, row_number() OVER (PARTITION BY subject, dimension ORDER BY f.bin) - 1 AS pos FROM f JOIN target USING (bin)),
l AS (SELECT x.subject, x.dimension, l.lag, {corr_sql("x.a", "y.b")} AS correlation, count(*) AS n FROM p x CROSS JOIN (SELECT unnest(range(-2, 3)) AS lag) l JOIN p y ON x.subject = y.subject AND x.dimension = y.dimension AND y.pos = x.pos + l.lag GROUP BY ALL)
SELECT subject, dimension, CAST(lag AS INTEGER) AS lag, round(correlation, 6) + 0.0 AS correlation, round({r_p_sql("correlation", "n")}, 6) AS p FROM l""")
def target_crosscorr(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf)
    target = align.bin_series(e.where("feature = 'purchase'"), fx.BIN, []).select("bin", "value")
    features = align.bin_series(e.where("feature <> 'purchase'"), fx.BIN, ["subject"]).drop("bin_time")
    joined = features.withColumnRenamed("feature", "dimension").withColumnRenamed("value", "a").join(target.withColumnRenamed("value", "b"), "bin")
    from pyspark.sql import Window

    p = joined.withColumn("pos", F.row_number().over(Window.partitionBy("subject", "dimension").orderBy("bin")) - 1)
    return rounded(synchrony.lagged_correlation(p, -2, 2, fx.BIN, ["subject", "dimension"]).select("subject", "dimension", "lag", "correlation", "p"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The window, dimension and lag of strongest coupling in each dyad."""
    p = synchrony.windowed_peaks(_swept(spark, sf)).where("peak IS NOT NULL")
    return synchrony.peaks(p.withColumnRenamed("peak", "correlation").withColumnRenamed("peak_lag", "lag"), ["dyad"]).select("dyad", "dimension", "window", "start", "lag", F.round("correlation", 6).alias("correlation"))


@query(f"""WITH {WINDOWS_SQL}, {_peaks_sql("r")} SELECT dyad, round(max(abs(peak)), 6) AS strongest FROM best GROUP BY ALL""")
def strongest_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(flagship(spark, sf).select("dyad", F.abs("correlation").alias("strongest")))


@query("""SELECT user_id % 20 AS subject, event_type AS feature, round(sum(CASE WHEN user_id % 2 = 0 AND starts_with(event_type, 'c') THEN -value ELSE value END), 4) AS total FROM events GROUP BY ALL""")
def orientation_flip(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf)
    flipped = align.negate_left(e, F.when(F.col("user_id") % 2 == 0, "left").otherwise("right"), ("c",))
    return rounded(flipped.groupBy("subject", "feature").agg(F.sum("value").alias("total")), 4)


@query("""SELECT event_type AS feature, count(*) AS n, round(max(greatest(-50.0, least(50.0, value - 60.0))), 6) AS clipped FROM events WHERE regexp_matches(event_type, '^(c.*|.*w)$') GROUP BY ALL""")
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    e = align.chosen(fx.events(spark, sf), ["c*", "*w"])
    return rounded(e.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.max(clip(F.col("value") - 60.0, -50.0, 50.0)).alias("clipped")))


@query(f"""WITH {WINDOWS_SQL}, {_peaks_sql("r")}, t AS (SELECT dyad, dimension, start * CAST(21600.0 AS DOUBLE) AS x, peak AS y FROM best), k AS (SELECT * FROM t WHERE y IS NOT NULL),
b AS (SELECT dyad, min(x) AS lo, max(x) AS hi FROM t GROUP BY dyad), g AS (SELECT b.dyad, dimension, lo + 43200.0 * unnest(range(0, CAST(floor((hi + 21600.0 - lo) / 43200.0) AS BIGINT) + 1)) AS x FROM b JOIN (SELECT DISTINCT dyad, dimension FROM t) USING (dyad)),
n AS (SELECT g.dyad, g.dimension, g.x, max(k.x) FILTER (k.x <= g.x) AS lx, min(k.x) FILTER (k.x >= g.x) AS rx FROM g LEFT JOIN k USING (dyad, dimension) GROUP BY ALL),
v AS (SELECT n.dyad, n.dimension, n.x, CASE WHEN lx IS NULL THEN r.y WHEN rx IS NULL OR lx = rx THEN l.y ELSE l.y + (r.y - l.y) * (n.x - lx) / (rx - lx) END AS y
  FROM n LEFT JOIN k l ON l.dyad = n.dyad AND l.dimension = n.dimension AND l.x = lx LEFT JOIN k r ON r.dyad = n.dyad AND r.dimension = n.dimension AND r.x = rx)
SELECT dyad, x AS time_seconds, {", ".join(f"round(max(y) FILTER (dimension = '{d}'), 5) AS pearson_r_{d}" for d in DIMENSIONS)} FROM v GROUP BY ALL""")
def wide_interpolated(spark: SparkSession, sf: str) -> DataFrame:
    """Windowed metrics of all dimensions on an even grid of 12 hours, linear between windows."""
    step = 43200.0
    p = synchrony.windowed_peaks(_swept(spark, sf)).withColumn("time_seconds", F.col("start") * fx.BIN).withColumnRenamed("peak", "pearson_r")
    ends = p.groupBy("dyad").agg(F.min("time_seconds").alias("lo"), F.max("time_seconds").alias("hi"))
    steps = F.sequence(F.lit(0), F.floor((F.col("hi") + step / 2 - F.col("lo")) / step).cast("int"))
    grid = ends.select("dyad", F.explode(F.transform(steps, lambda k: F.col("lo") + k * step)).alias("time_seconds")).join(p.select("dyad", "dimension").distinct(), "dyad")
    even = align.interpolated(p, grid, ["dyad", "dimension"], "time_seconds", "pearson_r")
    return rounded(synchrony.wide(even, ["pearson_r"], DIMENSIONS, ["dyad", "time_seconds"]), 5)


@query(f"""WITH {WINDOWS_SQL}, {_peaks_sql("r")}, ctop AS (SELECT dyad, dimension, start, ccc AS concordance_ccc FROM (SELECT *, row_number() OVER (PARTITION BY dyad, dimension, "window" ORDER BY abs(ccc) DESC, lag) AS k FROM swept WHERE ccc IS NOT NULL) WHERE k = 1)
SELECT coalesce(b.dyad, c.dyad) AS dyad, coalesce(b.dimension, c.dimension) AS dimension, coalesce(b.start, c.start) * CAST(21600.0 AS DOUBLE) AS window_time, round(b.peak, 6) AS pearson_r, round(c.concordance_ccc, 6) AS concordance_ccc FROM best b FULL JOIN ctop c ON b.dyad = c.dyad AND b.dimension = c.dimension AND b.start = c.start""")
def merged_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Full outer merge of all windows of two methods."""
    swept, key = _swept(spark, sf), ["dyad", "dimension", "start"]
    r = synchrony.windowed_peaks(swept).select(*key, F.col("peak").alias("pearson_r"))
    c = synchrony.windowed_peaks(swept, of="ccc").where("peak IS NOT NULL").select(*key, F.col("peak").alias("concordance_ccc"))
    return rounded(r.join(c, key, "full_outer").withColumn("window_time", F.col("start") * fx.BIN).drop("start"))
