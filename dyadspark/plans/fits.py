"""Queries of kernels: reduction, segmentation, spectral and causal coupling. SQL can't say them; tests hold them to numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.operators import kernels
from dyadspark.plans.registry import query, rounded
from dyadspark.sources import fixtures as fx

ENTITY = ["dyad", "person"]


@query()
def coherence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.coherence(fx.pairs(spark, sf), fx.BIN))


@query()
def wavelet(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.wavelet(fx.pairs(spark, sf).where("dimension = 'click'")))


@query()
def granger(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.granger(fx.pairs(spark, sf), 3))


@query()
def pca_components(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.loadings(fx.dense(spark, sf), "pca", 3, ENTITY))


@query()
def factor_components(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.loadings(fx.dense(spark, sf), "fa", 2, ENTITY))


@query()
def ica_components(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.loadings(fx.dense(spark, sf), "ica", 2, ENTITY), 4)


@query()
def joint_pca_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One space for both persons: fitted on their bins together, scores split by person again."""
    d = fx.dense(spark, sf).withColumn("at", F.struct("person", "bin"))
    both = d.withColumn("slot", F.concat_ws(":", "person", F.lpad(F.col("bin").cast("string"), 12, "0")))
    s = kernels.reduced(both, "pca", 2, ["dyad"], "slot")
    return rounded(s.select("dyad", "component", F.substring_index("slot", ":", 1).alias("person"), F.substring_index("slot", ":", -1).cast("long").alias("bin"), "value"))


@query()
def grouped_pca(spark: SparkSession, sf: str) -> DataFrame:
    """A fit for each group of features by first letter."""
    return rounded(kernels.loadings(fx.dense(spark, sf).withColumn("modality", F.substring("feature", 1, 1)), "pca", 1, [*ENTITY, "modality"]))


@query()
def cca_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.cca(fx.dense(spark, sf), 2, ["dyad"]), 5)


@query()
def cluster_features(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.feature_clusters(fx.dense(spark, sf), 3, ENTITY)


@query()
def hmm_states(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.hmm_states(fx.dense(spark, sf), [2, 3], 2, ENTITY), 4)


@query()
def changepoints(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.changepoint_states(fx.dense(spark, sf), 1.0, ENTITY)


@query()
def kmeans_windows(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.kmeans_windows(fx.dense(spark, sf), 8, [2, 3, 4], ENTITY)


@query()
def stationarity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.stationarity(fx.dense(spark, sf), [*ENTITY, "feature"]))


@query()
def key_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "embeddings")
    return rounded(kernels.key_frames(e, ["label"], "vec_id", "embedding", 0.2, 5, 20))


@query()
def spectral_features(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rounded(kernels.spectral(s, ["vec_id"], "i", "x", 64.0), 4)


@query()
def pca_scree(spark: SparkSession, sf: str) -> DataFrame:
    """Share of variance by component and its running sum."""
    from pyspark.sql import Window

    l = kernels.loadings(fx.dense(spark, sf), "pca", 20, ENTITY)
    c = l.groupBy(*ENTITY, "component").agg(F.first("explained").alias("explained"))
    k = F.regexp_extract("component", r"(\d+)", 1).cast("int")
    return rounded(c.withColumn("cumulative", F.sum("explained").over(Window.partitionBy(*ENTITY).orderBy(k))))


@query()
def pca_top_loadings(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty features of greatest absolute loading in any component, with their loadings in all."""
    return rounded(kernels.top_features(kernels.loadings(fx.dense(spark, sf), "pca", 20, ENTITY), ENTITY))


@query()
def granger_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = kernels.granger_windows(fx.pairs(spark, sf), 3, 28, 4)
    return rounded(w.withColumn("window_time", F.col("start") * fx.BIN).drop("start"))


@query()
def cluster_components(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kernels.cluster_components(fx.dense(spark, sf), 3, ENTITY))


@query()
def component_labels(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.component_labels(kernels.loadings(fx.dense(spark, sf), "pca", 3, ENTITY), ENTITY)


@query()
def changepoints_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Four segments by greedy cuts."""
    return kernels.changepoint_states(fx.dense(spark, sf), 1.0, ENTITY, n_states=4)
