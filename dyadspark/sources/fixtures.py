"""Views of the benchmark tables in the roles of recordings: series, pairs, states, scores. SQL holds the same definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.operators import align

BIN = 21600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = F.col("user_id") % 20
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select("event_id", "user_id", s.alias("subject"), F.floor(s / 2).alias("dyad"), F.when(s % 2 == 0, "A").otherwise("B").alias("person"), t.alias("t"), F.col("event_type").alias("feature"), "value", "props")


def binned(spark: SparkSession, sf_dir: str, bin_size: float = BIN) -> DataFrame:
    return align.bin_series(events(spark, sf_dir), bin_size)


def dense(spark: SparkSession, sf_dir: str, bin_size: float = BIN) -> DataFrame:
    return align.filled(align.densify(binned(spark, sf_dir, bin_size)))


def raw_pairs(spark: SparkSession, sf_dir: str, bin_size: float = BIN) -> DataFrame:
    return align.pairs(dense(spark, sf_dir, bin_size))


def pairs(spark: SparkSession, sf_dir: str, bin_size: float = BIN) -> DataFrame:
    return align.z_scored(raw_pairs(spark, sf_dir, bin_size), ["a", "b"], ["dyad", "dimension"])


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dyad, person, bin, pos, signal, state: quartile of binned activity."""
    from pyspark.sql import Window

    b = events(spark, sf_dir).withColumn("bin", F.floor(F.col("t") / BIN).cast("long")).groupBy("dyad", "person", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("signal"))
    w = Window.partitionBy("dyad", "person")
    b = b.withColumn("state", F.ntile(4).over(w.orderBy("n", "bin")))
    return b.withColumn("pos", F.row_number().over(w.orderBy("bin")) - 1)


EVENTS_SQL = """ev AS (SELECT event_id, user_id, user_id % 20 AS subject, CAST((user_id % 20) // 2 AS BIGINT) AS dyad,
  CASE WHEN user_id % 20 % 2 = 0 THEN 'A' ELSE 'B' END AS person, epoch_us(ts) / 1e6 AS t, event_type AS feature, value, props FROM events)"""
BINNED_SQL = EVENTS_SQL + """,
binned AS (SELECT dyad, person, feature, CAST(floor(t / 21600.0) AS BIGINT) AS bin, avg(value) AS value FROM ev GROUP BY ALL)"""
DENSE_SQL = BINNED_SQL + """,
grid AS (SELECT b.dyad, b.person, f.feature, b.bin FROM (SELECT DISTINCT dyad, person, bin FROM binned) b JOIN (SELECT DISTINCT dyad, person, feature FROM binned) f USING (dyad, person)),
holed AS (SELECT g.*, v.value FROM grid g LEFT JOIN binned v USING (dyad, person, feature, bin)),
dense AS (SELECT dyad, person, feature, bin, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY dyad, person, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY dyad, person, feature ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM holed)"""
RAW_PAIRS_SQL = DENSE_SQL + """,
raw AS (SELECT a.dyad, a.feature AS dimension, a.bin, a.value AS a, b.value AS b, row_number() OVER (PARTITION BY a.dyad, a.feature ORDER BY a.bin) - 1 AS pos
  FROM dense a JOIN dense b ON a.dyad = b.dyad AND a.feature = b.feature AND a.bin = b.bin AND a.person = 'A' AND b.person = 'B')"""
PAIRS_SQL = RAW_PAIRS_SQL + """,
pair AS (SELECT dyad, dimension, pos, bin,
  CASE WHEN min(a) OVER w = max(a) OVER w THEN 0 ELSE (a - avg(a) OVER w) / stddev_pop(a) OVER w END AS a,
  CASE WHEN min(b) OVER w = max(b) OVER w THEN 0 ELSE (b - avg(b) OVER w) / stddev_pop(b) OVER w END AS b
  FROM raw WINDOW w AS (PARTITION BY dyad, dimension))"""
STATES_SQL = EVENTS_SQL + """,
act AS (SELECT dyad, person, CAST(floor(t / 21600.0) AS BIGINT) AS bin, count(*) AS n, avg(value) AS signal FROM ev GROUP BY ALL),
states AS (SELECT *, CAST(ntile(4) OVER (PARTITION BY dyad, person ORDER BY n, bin) AS INTEGER) AS state, row_number() OVER (PARTITION BY dyad, person ORDER BY bin) - 1 AS pos FROM act)"""


def corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN count({a}) FILTER ({b} IS NOT NULL) >= 3 AND min({a}) FILTER ({b} IS NOT NULL) < max({a}) FILTER ({b} IS NOT NULL) AND min({b}) FILTER ({a} IS NOT NULL) < max({b}) FILTER ({a} IS NOT NULL) THEN covar_pop({a}, {b}) / sqrt(var_pop({a}) FILTER ({b} IS NOT NULL) * var_pop({b}) FILTER ({a} IS NOT NULL)) END"


def ccc_sql(a: str, b: str) -> str:
    return f"CASE WHEN count({a}) FILTER ({b} IS NOT NULL) >= 3 AND min({a}) FILTER ({b} IS NOT NULL) < max({a}) FILTER ({b} IS NOT NULL) AND min({b}) FILTER ({a} IS NOT NULL) < max({b}) FILTER ({a} IS NOT NULL) THEN 2 * covar_pop({a}, {b}) / (var_pop({a}) FILTER ({b} IS NOT NULL) + var_pop({b}) FILTER ({a} IS NOT NULL) + power(avg({a}) FILTER ({b} IS NOT NULL) - avg({b}) FILTER ({a} IS NOT NULL), 2)) END"


def r_p_sql(r: str, n: str) -> str:
    """Two-sided p of Pearson's r from n pairs: the finite series of Student's t at whole degrees of freedom."""
    even = f"abs({r}) * list_sum(list_transform(range(0, CAST(({n} - 2) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)) * power(1 - {r} * {r}, k)))"
    odd = f"2 / pi() * (asin(abs({r})) + coalesce(abs({r}) * list_sum(list_transform(range(0, CAST(({n} - 3) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5)) * power(1 - {r} * {r}, k + 0.5))), 0))"
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN abs({r}) >= 1 THEN 0.0 WHEN {n} % 2 = 0 THEN greatest(0.0, 1 - {even}) ELSE greatest(0.0, 1 - {odd}) END"
