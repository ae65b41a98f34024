"""Queries over recordings: descriptives, composites, functionals, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.functions.columns import format_seconds, modality, slugify
from dyadspark.operators import align, describe
from dyadspark.plans.registry import query, rounded
from dyadspark.sources import fixtures as fx
from dyadspark.sources.fixtures import DENSE_SQL, EVENTS_SQL

LONG_SQL = "long AS (SELECT l_returnflag AS subject, l_orderkey, l_linenumber, feature, value FROM lineitem UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))"
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long(spark: SparkSession, sf: str) -> DataFrame:
    l = fx.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "subject")
    return describe.unpivoted(l, ["subject", "l_orderkey", "l_linenumber"], COLUMNS)


DESC_SQL = """SELECT subject, feature, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, round(var_pop(value), 4) AS variance, min(value) AS min, max(value) AS max, round(median(value), 4) AS median,
round(CASE WHEN count(value) > 2 AND min(value) < max(value) THEN (avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * power(avg(value), 3)) / power(var_pop(value), 1.5) END, 3) + 0.0 AS skewness,
round(CASE WHEN count(value) > 2 AND min(value) < max(value) THEN kurtosis_pop(value) END, 3) + 0.0 AS kurtosis, round(100 * avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 4) AS percent_zero, round(100 * avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 4) AS percent_nan, min(value) = max(value) AS is_constant FROM long GROUP BY subject, feature"""


@query(f"WITH {LONG_SQL} {DESC_SQL}")
def descriptives(spark: SparkSession, sf: str) -> DataFrame:
    d = describe.descriptives(_long(spark, sf), ["subject"])
    return d.select("subject", "feature", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "variance")], "min", "max", F.round("median", 4).alias("median"), *[(F.round(c, 3) + 0.0).alias(c) for c in ("skewness", "kurtosis")], *[F.round(c, 4).alias(c) for c in ("percent_zero", "percent_nan")], "is_constant")


@query(f"""WITH {LONG_SQL}, d AS (SELECT subject, feature, var_pop(value) AS v, max(value) - min(value) AS r, min(value) = max(value) AS c FROM long GROUP BY ALL)
SELECT CASE WHEN starts_with(feature, 'l_q') THEN 'l_q' WHEN starts_with(feature, 'l_e') THEN 'l_e' ELSE 'l_d' END AS prefix, count(*) AS n_features, round(avg(v), 3) AS mean_variance, round(avg(r), 4) AS mean_range, count(*) FILTER (c) AS n_constant FROM d WHERE feature <> 'l_tax' GROUP BY ALL""")
def feature_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = describe.feature_groups(describe.descriptives(_long(spark, sf), ["subject"]), ("l_q", "l_e", "l_d"))
    return g.withColumn("mean_variance", F.round("mean_variance", 3)).withColumn("mean_range", F.round("mean_range", 4))


@query(f"""WITH {DENSE_SQL} SELECT x.dyad, x.person, x.feature AS feature_a, y.feature AS feature_b, round({fx.corr_sql("x.value", "y.value")}, 5) + 0.0 AS r FROM dense x JOIN dense y ON x.dyad = y.dyad AND x.person = y.person AND x.bin = y.bin AND x.feature <= y.feature GROUP BY ALL""")
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.correlation_matrix(fx.dense(spark, sf), ["dyad", "person"], "bin"), 5)


@query(f"""WITH {DENSE_SQL}, z AS (SELECT dyad, person, bin, CASE WHEN min(value) OVER w < max(value) OVER w THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END AS z FROM dense WINDOW w AS (PARTITION BY dyad, person, feature))
SELECT dyad, person, bin, round(avg(z), 5) + 0.0 AS vocal_energy FROM z GROUP BY ALL""")
def zscore_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.composite(fx.dense(spark, sf), ["dyad", "person"], "bin", "vocal_energy"), 5)


@query("""WITH s AS (SELECT l_suppkey % 10 AS g, l_partkey, l_orderkey * 10 + l_linenumber AS frame, l_quantity AS q, l_discount AS d, sqrt(power(coalesce(l_quantity - lag(l_quantity) OVER w, 0), 2) + power(coalesce(l_discount - lag(l_discount) OVER w, 0), 2)) AS step
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey % 10, l_partkey ORDER BY l_orderkey * 10 + l_linenumber, l_quantity, l_discount))
SELECT g, frame AS f, round(avg(step), 4) AS movement_energy FROM s GROUP BY g, frame, q, d""")
def movement_energy(spark: SparkSession, sf: str) -> DataFrame:
    f = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("f")
    l = fx.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), "l_partkey", F.struct(f, "l_quantity", "l_discount").alias("frame"), "l_quantity", "l_discount")
    return rounded(describe.movement_energy(l, ["g"], "l_partkey", "frame", ["l_quantity", "l_discount"]).select("g", F.col("frame.f").alias("f"), "movement_energy"), 4)


KINDS = ("GMP_world_", "oc_audvol", "ee_", "Some ")


@query(f"""WITH n AS (SELECT p_partkey, {list(KINDS)}[p_partkey % 4 + 1] || p_name AS n FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'movement' WHEN 1 THEN 'vocal_energy' WHEN 2 THEN 'emotieffnet' ELSE 'other' END AS modality, lower(replace(n, ' ', '_')) AS slug FROM n""")
def modality_map(spark: SparkSession, sf: str) -> DataFrame:
    n = F.concat(F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 4 + 1).cast("int")), "p_name")
    return fx.table(spark, sf, "part").select("p_partkey", modality(n).alias("modality"), slugify(n).alias("slug"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 5) AS std, list_min(e) AS min, list_max(e) AS max FROM v""")
def array_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "embeddings")
    mean, std, low, high, _ = describe.array_summary(F.col("embedding"))
    return e.select("vec_id", F.round(mean, 6).alias("mean"), F.round(std, 5).alias("std"), low, high)


@query("""WITH o AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT g, count(*) AS n, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS std, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.01), 3) AS p1, round(quantile_cont(v, 0.25), 3) AS quartile1, round(quantile_cont(v, 0.99), 3) AS p99, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 3) AS iqr,
round(arg_min(i, v) / count(*), 6) AS minPos, round(arg_max(i, v) / count(*), 6) AS maxPos, round(regr_slope(v, i), 4) + 0.0 AS slope, round(regr_intercept(v, i), 3) AS intercept, round(sqrt((regr_syy(v, i) - regr_sxy(v, i) * regr_sxy(v, i) / regr_sxx(v, i)) / count(*)), 3) AS rmse FROM o GROUP BY g""")
def lld_functionals(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("value"), (F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1).alias("i"))
    f = describe.functionals(o, ["g"])
    r = lambda n, *cs: [(F.round(c, n) + 0.0).alias(c) for c in cs]
    return f.select("g", "n", *r(3, "mean", "std"), "min", "max", *r(3, "p1", "quartile1", "p99", "iqr"), *r(6, "minPos", "maxPos"), *r(4, "slope"), *r(3, "intercept", "rmse"))


@query("""WITH o AS (SELECT o_custkey AS g, o_orderkey AS i, o_totalprice AS v FROM orders) SELECT g, i, round(coalesce(v - lag(v) OVER (PARTITION BY g ORDER BY i), 0), 4) + 0.0 AS diff FROM o""")
def frame_differences(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("value"))
    return rounded(describe.frame_differences(o, ["g"], "i").select("g", "i", "diff"), 4)


@query("""WITH x AS (SELECT o_orderpriority AS g, o_orderkey AS i, greatest(-80.0, 20 * log10(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_orderpriority))) AS v, CASE WHEN o_custkey > 50 THEN 12 * log2(o_custkey / 440.0) END AS p FROM orders),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY g ORDER BY i) AS dv, p - last_value(p IGNORE NULLS) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dp FROM x)
SELECT g, round(avg(v), 5) AS oc_audvol, round(stddev_pop(v), 5) AS oc_audvol_std, round(max(v), 5) AS oc_audvol_max, round(min(v), 5) AS oc_audvol_min, round(avg(abs(dv)), 5) AS oc_audvol_diff, round(stddev_pop(dv), 5) AS oc_audvol_diff_std,
round(avg(p), 5) AS oc_audpit, round(stddev_pop(p), 5) AS oc_audpit_std, round(max(p), 5) AS oc_audpit_max, round(min(p), 5) AS oc_audpit_min, round(avg(abs(dp)), 5) AS oc_audpit_diff, round(stddev_pop(dp), 5) AS oc_audpit_diff_std, round(max(p) - min(p), 5) AS oc_audpit_range FROM d GROUP BY g""")
def volume_pitch(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").withColumn("g", F.col("o_orderpriority")).withColumn("f", F.col("o_custkey").cast("double"))
    return rounded(describe.volume_pitch(o, ["g"], "o_orderkey", "o_totalprice", "f"), 5)


@query("""WITH s AS (SELECT vec_id, i - 1 AS i, x, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))
SELECT vec_id, CAST(i // 16 AS BIGINT) AS frame, round(sqrt(avg(x * x)), 6) AS rms, round(avg(CASE WHEN sign(x) * sign(p) < 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_crossing_rate FROM s GROUP BY ALL""")
def framed_rms(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return rounded(describe.framed_rms(s, ["vec_id"], "i", "x", 16))


ROI_SQL = EVENTS_SQL + """,
roi AS (SELECT * FROM (VALUES ('front', 'click'), ('front', 'view'), ('back', 'error'), ('back', 'purchase'))r(roi, feature)),
b AS (SELECT subject, feature, CAST(floor(t / 86400.0) AS BIGINT) AS bin, avg(value) AS value FROM ev GROUP BY ALL)"""


@query(f"WITH {ROI_SQL} SELECT subject, bin, roi, round(avg(value), 5) AS value FROM b JOIN roi USING (feature) GROUP BY ALL")
def roi_average(spark: SparkSession, sf: str) -> DataFrame:
    rois = spark.createDataFrame([("front", "click"), ("front", "view"), ("back", "error"), ("back", "purchase")], "roi string, feature string")
    b = align.bin_series(fx.events(spark, sf), 86400.0, ["subject"])
    return rounded(describe.roi_means(b, rois, ["subject"], "bin"), 5)


@query("""WITH p AS (SELECT user_id AS g, epoch_us(ts) / 1e6 - 1704067200 AS x, value AS y FROM events),
u AS (SELECT g, x, avg(y) AS y FROM p GROUP BY ALL), q AS (SELECT DISTINCT g, unnest(range(0, 30)) * 86400.0 AS x FROM p),
l AS (SELECT q.g, q.x, max(u.x) AS lx FROM q LEFT JOIN u ON u.g = q.g AND u.x <= q.x GROUP BY ALL), r AS (SELECT q.g, q.x, min(u.x) AS rx FROM q LEFT JOIN u ON u.g = q.g AND u.x >= q.x GROUP BY ALL)
SELECT l.g, CAST(l.x AS DOUBLE) AS x, round(CASE WHEN lx IS NULL THEN b.y WHEN rx IS NULL OR lx = rx THEN a.y ELSE a.y + (b.y - a.y) * (l.x - lx) / (rx - lx) END, 5) AS y FROM l JOIN r ON l.g = r.g AND l.x = r.x LEFT JOIN u a ON a.g = l.g AND a.x = lx LEFT JOIN u b ON b.g = l.g AND b.x = rx""")
def resample_linear(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events")
    p = e.groupBy(F.col("user_id").alias("g"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - 1704067200).alias("x")).agg(F.avg("value").alias("y"))
    grid = p.select("g").distinct().withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: i * 86400.0)))
    return rounded(align.interpolated(p, grid, ["g"], "x", "y"), 5)


@query("SELECT o_orderkey, CAST(i AS INTEGER) AS frame_idx FROM (SELECT o_orderkey, unnest(list_transform(range(0, least(n, 4)), lambda j: CASE WHEN least(n, 4) > 1 THEN CAST(floor(j * (n - 1) / (least(n, 4) - 1)) AS INTEGER) ELSE 0 END)) AS i FROM (SELECT l_orderkey AS o_orderkey, CAST(sum(l_quantity) AS INTEGER) AS n FROM lineitem GROUP BY ALL) WHERE n > 0)")
def frame_sampling(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("int").alias("n")).where("n > 0")
    return align.spread_frames(r, ["o_orderkey"], "n", 4)


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS segment, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey, o_orderkey, segment, CAST(i // 4 AS BIGINT) AS chunk FROM o""")
def even_segments(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = align.segments_of(fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 3)
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    return align.chunks_of(o, "i", 4).select("o_custkey", "o_orderkey", "segment", "chunk")


@query("""SELECT l_orderkey, round(sum(CAST(i AS DOUBLE) / 25), 6) AS total_time, count(*) AS n_frames FROM (SELECT l_orderkey, unnest(range(0, CAST(max(l_linenumber) AS BIGINT))) AS i FROM lineitem GROUP BY l_orderkey) GROUP BY l_orderkey""")
def frame_grid(spark: SparkSession, sf: str) -> DataFrame:
    l = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")).withColumn("fps", F.lit(25.0))
    return rounded(align.frame_grid(l, ["l_orderkey"], "n", "fps").groupBy("l_orderkey").agg(F.sum("time_seconds").alias("total_time"), F.count(F.lit(1)).alias("n_frames")))


@query("""SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%dm%02ds', CAST(floor(s) AS BIGINT) // 60, CAST(floor(s) AS BIGINT) % 60) ELSE printf('%dh%02dm', CAST(floor(s) AS BIGINT) // 3600, CAST(floor(s) AS BIGINT) // 60 % 60) END AS elapsed FROM (SELECT o_orderkey, floor(o_totalprice / 60) + 0.5 AS s FROM orders)""")
def format_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "orders").select("o_orderkey", format_seconds(F.floor(F.col("o_totalprice") / 60) + 0.5).alias("elapsed"))


@query("""SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) FILTER (value > 50) AS value FROM events GROUP BY user_id""")
def first_values(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events").withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return describe.first_present(e, ["user_id"], "event_id", ["event_type", "value"])


@query("""SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1""")
def merged_sources(spark: SparkSession, sf: str) -> DataFrame:
    return describe.merged_sources(fx.table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("""SELECT event_id, nullif(round(CASE WHEN event_id % 7 = 0 THEN -100.0 ELSE value END, 1), -100.0) AS value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def sentinel_and_json(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(-100.0)).otherwise(F.col("value")))
    return e.select("event_id", F.nullif(F.round("value", 1), F.lit(-100.0)).alias("value"), F.from_json("props", "k long").k.alias("k"))


@query(f"""WITH {DENSE_SQL} SELECT dyad, person, (max(bin) - min(bin) + 1) * CAST(21600.0 AS DOUBLE) AS duration, count(DISTINCT bin) AS n_frames, count(DISTINCT feature) AS n_features,
round(avg(value) FILTER (feature = 'click'), 5) AS mean_click, round(var_pop(value) FILTER (feature = 'click'), 4) AS var_click, round(avg(value) FILTER (feature = 'view'), 5) AS mean_view, round(var_pop(value) FILTER (feature = 'view'), 4) AS var_view FROM dense GROUP BY dyad, person""")
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A row a subject: duration, sizes, and mean and variance of chosen dimensions."""
    d = describe.batch_summary(fx.dense(spark, sf), ["dyad", "person"], "bin", ["click", "view"], fx.BIN)
    return d.select("dyad", "person", "duration", "n_frames", "n_features", *[F.round(c, 4 if c.startswith("var") else 5).alias(c) for c in ("mean_click", "var_click", "mean_view", "var_view")])


@query("""WITH f AS (SELECT l_orderkey AS rec, unnest(range(0, CAST(max(l_linenumber) AS BIGINT))) AS frame_idx FROM lineitem GROUP BY l_orderkey), s AS (SELECT l_orderkey AS rec, 'oc_quantity' AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY l_orderkey)
SELECT f.rec, CAST(frame_idx AS INTEGER) AS frame_idx, feature, value FROM f JOIN s USING (rec)""")
def broadcast_scalars(spark: SparkSession, sf: str) -> DataFrame:
    l = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("rec")).agg(F.max("l_linenumber").alias("n"), F.sum("l_quantity").alias("q")).withColumn("fps", F.lit(25.0))
    grid = align.frame_grid(l, ["rec"], "n", "fps").drop("time_seconds")
    scalars = l.select("rec", F.explode(F.create_map(F.lit("oc_quantity"), "q", F.lit("osm_x"), "q", F.lit("meta"), "q")).alias("feature", "value"))
    return align.broadcast_scalars(grid, scalars, ["rec"], ("meta",))
