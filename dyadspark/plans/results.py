"""Queries of results over several methods, functionals by name, and rows from nested columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.operators import describe, results, synchrony
from dyadspark.plans.dyads import OVERALL_SQL, PEAK_SQL, WINDOWS_SQL, _peaks_sql, _swept
from dyadspark.plans.groups import _peaks
from dyadspark.plans.registry import query, rounded
from dyadspark.sources import fixtures as fx
from dyadspark.sources.fixtures import DENSE_SQL


@query(f"""WITH {WINDOWS_SQL}, {_peaks_sql("r")}, ctop AS (SELECT dyad, dimension, "window", ccc AS peak, lag AS peak_lag FROM (SELECT *, row_number() OVER (PARTITION BY dyad, dimension, "window" ORDER BY abs(ccc) DESC, lag) AS k FROM swept WHERE ccc IS NOT NULL) WHERE k = 1),
cbest AS (SELECT b.dyad, b.dimension, ctop.peak, coalesce(ctop.peak_lag, 0) AS peak_lag FROM best b LEFT JOIN ctop USING (dyad, dimension, "window")),
m AS (SELECT 'pearson' AS method, dyad, dimension, median(peak_lag) AS peak_lag, avg(peak) AS effect_size FROM best GROUP BY ALL UNION ALL SELECT 'concordance', dyad, dimension, median(peak_lag), avg(peak) FROM cbest GROUP BY ALL)
SELECT method, dyad, dimension, CAST(peak_lag AS DOUBLE) AS peak_lag, round(effect_size, 6) AS effect_size, CASE WHEN peak_lag > 0 THEN 'A' WHEN peak_lag < 0 THEN 'B' ELSE 'sync' END AS leader FROM m""")
def leaders_by_method(spark: SparkSession, sf: str) -> DataFrame:
    """Leader, lag and effect by method; a method that can't be planned is left out, the others stand."""
    swept = _swept(spark, sf)
    methods = {
        "pearson": lambda: synchrony.leaders(synchrony.windowed_peaks(swept)),
        "concordance": lambda: synchrony.leaders(synchrony.windowed_peaks(swept, of="ccc")),
        "every": lambda: results.dimensions(swept, "no such method", ["dyad"]),
    }
    plans, _ = results.planned(methods, ["pearson", "concordance", "every", "unheard_of"])
    return rounded(results.stacked(plans, "method"))


@query(f"""WITH {OVERALL_SQL}, o AS (SELECT dimension, avg(r) AS mean_overall FROM ov GROUP BY dimension), k AS (SELECT dimension, max(abs(c)) AS max_ccc FROM ov GROUP BY dimension)
SELECT coalesce(o.dimension, k.dimension) AS dimension, round(mean_overall, 6) + 0.0 AS mean_overall, round(max_ccc, 6) AS max_ccc FROM o FULL JOIN k ON o.dimension = k.dimension""")
def merged_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of two methods merged on the dimension."""
    o = synchrony.overall(fx.pairs(spark, sf))
    r = o.groupBy("dimension").agg(F.avg("pearson_pearson_r_overall").alias("mean_overall"))
    c = o.groupBy("dimension").agg(F.max(F.abs("concordance_concordance_ccc_overall")).alias("max_ccc"))
    return rounded(results.merged([r, c], ["dimension"]))


@query(f"""WITH {PEAK_SQL}, ov AS (SELECT dyad, dimension, {fx.corr_sql("a", "b")} AS r FROM pair GROUP BY ALL)
SELECT 'peaks' AS source, dyad, dimension, CAST(lag AS INTEGER) AS lag, round(correlation, 6) AS correlation FROM peak UNION ALL SELECT 'overall', dyad, dimension, NULL, round(r, 6) FROM ov""")
def stacked_results(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks, and overall correlations that have no lag, under one another."""
    o = synchrony.overall(fx.pairs(spark, sf)).select("dyad", "dimension", F.col("pearson_pearson_r_overall").alias("correlation"))
    return rounded(results.stacked({"peaks": _peaks(spark, sf).select("dyad", "dimension", "lag", "correlation"), "overall": o}))


Z_SQL = "CASE WHEN min(value) OVER w < max(value) OVER w THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END"
GROUPS = {"seen": ["click", "view"], "else": ["e", "p", "s"]}


@query(f"""WITH {DENSE_SQL}, z AS (SELECT dyad, person, bin, CASE WHEN feature IN ('click', 'view') THEN 'seen' ELSE 'else' END AS dimension, {Z_SQL} AS z FROM dense WHERE regexp_matches(feature, '^(click|view|e|p|s)') WINDOW w AS (PARTITION BY dyad, person, feature))
SELECT dyad, person, dimension, bin, round(avg(z), 5) + 0.0 AS value, 'grouped' AS method FROM z GROUP BY ALL""")
def grouped_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(results.dimensions(fx.dense(spark, sf), "grouped", ["dyad", "person"], groups=GROUPS), 5)


@query(f"""WITH {DENSE_SQL}, z AS (SELECT dyad, person, bin, CASE WHEN feature IN ('click', 'view') THEN 'seen' ELSE 'else' END AS dimension, {Z_SQL} AS z FROM dense WHERE regexp_matches(feature, '^(click|view|e|p|s)') WINDOW w AS (PARTITION BY dyad, person, feature)),
s AS (SELECT dyad, person, t, abs(coalesce(value - lag(value) OVER (PARTITION BY dyad, person, feature ORDER BY t), 0)) AS step FROM ev), m AS (SELECT dyad, person, t, avg(step) AS e FROM s GROUP BY ALL),
b AS (SELECT dyad, person, CAST(floor(t / 21600.0) AS BIGINT) AS bin, avg(e) AS e FROM m GROUP BY ALL)
SELECT dyad, person, dimension, bin, round(avg(z), 5) + 0.0 AS value, 'grouped' AS method FROM z GROUP BY ALL UNION ALL SELECT dyad, person, 'movement_energy', bin, round(e, 5), 'grouped' FROM b SEMI JOIN dense USING (dyad, person, bin)""")
def grouped_with_movement(spark: SparkSession, sf: str) -> DataFrame:
    """The composites after the movement energy of landmarks, for which the kinds of events stand, rebinned."""
    d, key = fx.dense(spark, sf), ["dyad", "person"]
    energy = describe.movement_energy(fx.events(spark, sf), key, "feature", "t", ["value"])
    return rounded(results.dimensions(d, "grouped", key, groups=GROUPS, movement=energy, bin_size=fx.BIN), 5)


@query(f"WITH {DENSE_SQL} SELECT dyad, person, feature AS dimension, bin, round(value, 6) AS value, 'every' AS method FROM dense")
def every_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(results.dimensions(fx.dense(spark, sf), "every", ["dyad", "person"]))


@query()
def reduced_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Principal and independent components and clusters, with the grouped composites, as one table by method."""
    d = fx.dense(spark, sf)
    return rounded(results.stacked({m: results.dimensions(d, m, ["dyad", "person"], k=2, groups=None if m == "cluster" else GROUPS) for m in ("pca", "ica", "cluster")}, "method"), 4)


@query("""WITH n AS (SELECT l_suppkey, CASE l_linenumber % 5 WHEN 0 THEN 'mfcc_Mean' WHEN 1 THEN 'F0_stddev' WHEN 2 THEN 'mfcc_min' WHEN 3 THEN 'jitterMinPos' ELSE 'pcm_range' END AS name, l_quantity AS v FROM lineitem),
s AS (SELECT l_suppkey, unnest(CASE WHEN name = 'mfcc_Mean' THEN ['mean'] WHEN name = 'F0_stddev' THEN ['stddev'] WHEN name = 'pcm_range' THEN ['range'] ELSE ['min'] END) AS statistic, v FROM n)
SELECT l_suppkey, statistic, round(avg(v), 6) AS value FROM s GROUP BY ALL""")
def by_statistic(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber") % 5
    name = F.when(k == 0, "mfcc_Mean").when(k == 1, "F0_stddev").when(k == 2, "mfcc_min").when(k == 3, "jitterMinPos").otherwise("pcm_range")
    return rounded(describe.by_statistic(fx.table(spark, sf, "lineitem").withColumn("name", name), ["l_suppkey"], "name", "l_quantity"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS s FROM embeddings)
SELECT vec_id, round(power(2.0, 20 * log10(sqrt(list_sum(list_transform(s, lambda x: x * x)) / len(s)) + 1e-8) / 10 - 40) / 10 * 1e12, 5) AS loudness_e12,
round(list_sum(list_transform(s[2:], lambda x, i: (x - s[1]) / i)) / list_sum(s[2:]), 5) + 0.0 AS decrease FROM s""")
def loudness_decrease(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("s"))
    rms = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x) / F.size("s"))
    return rounded(s.select("vec_id", (describe.loudness(rms) * 1e12).alias("loudness_e12"), describe.spectral_decrease(F.col("s")).alias("decrease")), 5)


@query("SELECT doc_id, round(length(text) / 16.0 * 1.25, 6) AS output_duration_sec, CAST(floor(length(text) * CAST(1.25 AS DOUBLE)) AS BIGINT) AS output_nframes FROM documents")
def stretched(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return rounded(fx.table(spark, sf, "documents").select("doc_id", *describe.stretched(n / F.lit(16.0), n, 1.25)))


@query("""SELECT l_suppkey, CASE WHEN min(l_quantity) < max(l_quantity) THEN round(avg(power((l_quantity - m) / s, 3)), 5) + 0.0 END AS skewness, CASE WHEN min(l_quantity) < max(l_quantity) THEN round(avg(power((l_quantity - m) / s, 4)) - 3, 5) + 0.0 END AS kurtosis
FROM (SELECT l_suppkey, l_quantity, avg(l_quantity) OVER w AS m, nullif(stddev_pop(l_quantity) OVER w, 0) AS s FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)) GROUP BY l_suppkey""")
def functional_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.shapes(fx.table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity"), 5)


@query("SELECT c_custkey, c_name AS result_person_name, c_acctbal AS result_person_scores_balance, c_mktsegment AS result_segment FROM customer")
def flattened(spark: SparkSession, sf: str) -> DataFrame:
    person = F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance")).alias("scores")).alias("person")
    return results.flattened(fx.table(spark, sf, "customer").select("c_custkey", F.struct(person, F.col("c_mktsegment").alias("segment")).alias("result")))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS frame, round(x, 6) + 0.0 AS value, round(abs(x), 6) AS size FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def per_frame(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return rounded(results.per_frame(fx.table(spark, sf, "embeddings").select("vec_id", v.alias("value"), F.transform(v, F.abs).alias("size")), ["vec_id"], ["value", "size"]))


@query("SELECT l_suppkey, round(avg(l_quantity), 5) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_tax END), 6) AS picked FROM lineitem GROUP BY l_suppkey")
def probed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Means of columns by prefix, and of the first column present among candidates of which one doesn't exist."""
    l = fx.table(spark, sf, "lineitem").withColumn("score", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")))
    l = l.withColumn("picked", results.first_existing(l, ["no_such_column", "score", "l_tax"]))
    m = results.prefix_means(l, ["l_suppkey"], ["l_quant", "l_ext", "picked"])
    return m.select("l_suppkey", F.round("l_quantity", 5).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"), F.round("picked", 6).alias("picked"))
