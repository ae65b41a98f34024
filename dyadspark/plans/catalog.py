"""Queries of sources: time columns, path attributes, regions, models and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.plans.registry import query, rounded
from dyadspark.sources import catalog, readers, writers
from dyadspark.sources import fixtures as fx


@query("SELECT user_id, round(sum(CASE WHEN mx > 1000 THEN t / 1000 ELSE t END), 4) AS total FROM (SELECT user_id, CAST(event_id AS DOUBLE) AS t, max(event_id) OVER (PARTITION BY user_id) AS mx FROM events) GROUP BY user_id")
def resolve_time(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events").select("user_id", F.col("event_id").alias("VideoTime"))
    return rounded(readers.resolved_time(e, ["user_id"]).groupBy("user_id").agg(F.sum("time_seconds").alias("total")), 4)


@query("""SELECT user_id, 'sub' || user_id AS subject, 'sub' || user_id AS sub_a, 'sub' || (user_id + 1) AS sub_b, CASE user_id % 3 WHEN 0 THEN 'pca' WHEN 1 THEN 'grouped' ELSE 'ica' END AS method FROM (SELECT DISTINCT user_id FROM events)""")
def path_attributes(spark: SparkSession, sf: str) -> DataFrame:
    method = F.when(F.col("user_id") % 3 == 0, "pca").when(F.col("user_id") % 3 == 1, "grouped").otherwise("ica")
    e = fx.table(spark, sf, "events").select("user_id").distinct().withColumn("path", F.concat(F.lit("/out/sub"), "user_id", F.lit("_sub"), F.col("user_id") + 1, F.lit("/"), method, F.lit("/x.csv")))
    a = readers.path_attributes(F.col("path"))
    return e.select("user_id", *[a[k].alias(k) for k in ("subject", "sub_a", "sub_b", "method")])


@query("SELECT DISTINCT event_type AS roi, 'C' || user_id AS feature FROM events")
def roi_config(spark: SparkSession, sf: str) -> DataFrame:
    """Regions out of one JSON object of arrays of channels, made of events' kinds and users."""
    e = fx.table(spark, sf, "events").groupBy("event_type").agg(F.collect_set(F.concat(F.lit("C"), "user_id")).alias("c"))
    return readers.regions(e.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "c")))).alias("j")), "j")


MODELS = [("oc_audvol", "basic_audio"), ("GMP_world_x_1", "mediapipe_pose_vision"), ("nothing", "Other"), ("WhX_words", "whisperx_transcription")]


@query(f"SELECT feature, model, count(*) AS n FROM part JOIN (VALUES {', '.join(str((i, *m)) for i, m in enumerate(MODELS))}) m(k, feature, model) ON p_partkey % 4 = k GROUP BY ALL")
def model_groups(spark: SparkSession, sf: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(m[0]) for m in MODELS]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return catalog.by_model(fx.table(spark, sf, "part").select(names.alias("feature"))).groupBy("feature", "model").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS status, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY event_type")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(catalog.run_summary(fx.table(spark, sf, "events").select(F.col("event_type").alias("status"))))


@query("""SELECT 'orders' AS report, metric, round(value, 4) AS value FROM (SELECT CAST(count(*) AS DOUBLE) AS n_rows, avg(o_custkey) AS o_custkey, avg(o_totalprice) AS o_totalprice FROM orders) UNPIVOT (value FOR metric IN (n_rows, o_custkey, o_totalprice))""")
def summary_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(writers.report(fx.table(spark, sf, "orders").select("o_custkey", "o_totalprice"), "orders"), 4)


@query("SELECT l_returnflag AS subject, feature, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT l_returnflag, feature, nullif(value, -100.0) AS value FROM lineitem UNPIVOT (value FOR feature IN (l_quantity, l_discount, l_tax, l_extendedprice))) GROUP BY ALL")
def load_features(spark: SparkSession, sf: str) -> DataFrame:
    l = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("subject"), F.col("l_orderkey").cast("double").alias("time"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return rounded(readers.load_features(l, ["subject"]).groupBy("subject", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 2)
