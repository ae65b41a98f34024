"""Queries of ordered lists, frames on a video's grid, agreement of labels, targets by method, and what runs have done."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.functions.columns import lag_samples
from dyadspark.operators import align, describe, frames, group, results, text
from dyadspark.plans.dialogue import KEPT
from dyadspark.plans.frames import P, _points
from dyadspark.plans.groups import VOTES_SQL, _votes
from dyadspark.plans.registry import query, rounded
from dyadspark.sources import fixtures as fx
from dyadspark.sources import writers
from dyadspark.sources.fixtures import DENSE_SQL, EVENTS_SQL
from dyadspark.sources.shared import run_folder
from jobs import coupling


@query(f"""WITH {VOTES_SQL}, s AS (SELECT feature, count(*) AS n_votes, round(avg(abs_loading), 9) AS m FROM votes GROUP BY feature)
SELECT CAST(row_number() OVER (ORDER BY n_votes DESC, m DESC, feature) AS INTEGER) AS rank, feature, n_votes, round(m, 6) AS mean_abs_loading FROM s QUALIFY rank <= 15""")
def top_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen features with most votes, in order: a report."""
    v = group.vote_summary(_votes(spark, sf), "subject", 4).withColumn("mean_abs_loading", F.round("mean_abs_loading", 9))
    return rounded(group.ordered(v, ["-n_votes", "-mean_abs_loading", "feature"], top=15).select("rank", "feature", "n_votes", "mean_abs_loading"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT user_id % 4 AS state, feature, round(avg(value), 9) AS m FROM ev GROUP BY ALL)
SELECT state, CAST(row_number() OVER (PARTITION BY state ORDER BY abs(m) DESC, feature) AS INTEGER) AS rank, feature, round(m, 6) AS mean FROM s QUALIFY rank <= 3""")
def top_state_features(spark: SparkSession, sf: str) -> DataFrame:
    """The three features of greatest absolute mean in each state."""
    s = fx.events(spark, sf).groupBy((F.col("user_id") % 4).alias("state"), "feature").agg(F.round(F.avg("value"), 9).alias("mean")).withColumn("size", F.abs("mean"))
    return rounded(group.ordered(s, ["-size", "feature"], ["state"], 3).select("state", "rank", "feature", "mean"))


@query("""WITH x AS (SELECT o_orderpriority AS method, o_custkey % 7 AS moderator, o_custkey, o_orderkey % 1000 AS a, o_totalprice AS b FROM orders),
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY method, moderator, a) - 1) / 2.0 AS ra, rank() OVER v + (count(*) OVER (PARTITION BY method, moderator, b) - 1) / 2.0 AS rb FROM x WINDOW w AS (PARTITION BY method, moderator ORDER BY a), v AS (PARTITION BY method, moderator ORDER BY b)),
c AS (SELECT method, moderator, count(*) AS n, round(corr(CAST(ra AS DOUBLE), CAST(rb AS DOUBLE)), 9) AS rho FROM r GROUP BY ALL HAVING count(*) >= 4)
SELECT CAST(row_number() OVER (ORDER BY abs(rho) DESC NULLS LAST, method, moderator) AS INTEGER) AS rank, method, moderator, n, round(rho, 6) + 0.0 AS rho FROM c QUALIFY rank <= 6""")
def top_moderators(spark: SparkSession, sf: str) -> DataFrame:
    """The six strongest of all (method, moderator) groups with four rows at least."""
    x = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 7).alias("moderator"), (F.col("o_orderkey") % 1000).alias("a"), F.col("o_totalprice").alias("b"))
    c = group.spearman(x, "a", "b", ["method", "moderator"], least=4).withColumn("rho", F.round("rho", 9)).withColumn("size", F.abs("rho"))
    return rounded(group.ordered(c, ["-size", "method", "moderator"], top=6).select("rank", "method", "moderator", "n", "rho"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), t AS (SELECT vec_id, a, unnest(range(0, 60)) AS k FROM v),
x AS (SELECT vec_id, k, a, least(k / 25.0 * 31.25, len(a) - 1.0) AS x FROM t), i AS (SELECT *, CAST(least(floor(x), len(a) - 2) AS BIGINT) AS i FROM x)
SELECT vec_id, CAST(k AS INTEGER) AS frame_idx, round(a[i + 1] + (a[i + 2] - a[i + 1]) * (x - i), 6) + 0.0 AS value FROM i""")
def audio_at_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Values of 512-sample hops at 16 kHz at the times of sixty frames of 25 a second."""
    v = fx.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    at = align.audio_at_frames(F.col("a"), F.lit(60), F.lit(25.0))
    return rounded(v.select("vec_id", F.posexplode(at).alias("frame_idx", "value")))


@query("""WITH l AS (SELECT l_orderkey AS rec, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS c, l_quantity AS v FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
r AS (SELECT rec, c, CASE WHEN rec % 2 = 0 THEN c ELSE 3 * c END AS n FROM l GROUP BY rec, c), g AS (SELECT rec, c, n, unnest(range(0, n)) AS f FROM r WHERE n <> c AND c >= 2),
i AS (SELECT g.*, least(f // 3, c - 2) AS a FROM g), b AS (SELECT i.rec, f, x.v AS lv, y.v AS rv, least((f - 3 * a) / 3.0, 1.0) AS w FROM i JOIN l x ON x.rec = i.rec AND x.k = a JOIN l y ON y.rec = i.rec AND y.k = a + 1)
SELECT l.rec, CAST(k AS BIGINT) AS frame_idx, round(v, 6) AS value FROM l JOIN r ON l.rec = r.rec WHERE r.n = r.c UNION ALL SELECT rec, CAST(f AS BIGINT), round(lv + (rv - lv) * w, 6) FROM b""")
def frame_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of even orders have a sample a frame, those of odd ones a sample each third frame."""
    from pyspark.sql import Window

    l = fx.table(spark, sf, "lineitem")
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    even = F.col("rec") % 2 == 0
    s = l.select(F.col("l_orderkey").alias("rec"), k.alias("k"), "l_quantity").withColumn("frame", F.when(even, F.col("k")).otherwise(3 * F.col("k")))
    r = s.groupBy("rec").agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.when(even, F.col("c")).otherwise(3 * F.col("c")))
    return rounded(align.frame_tracks(s, r, ["rec"], "frame", "l_quantity", "n"))


@query("""WITH l AS (SELECT l_suppkey AS g, l_orderkey * 10 + l_linenumber AS place, l_returnflag AS predicted, CASE WHEN l_partkey % 3 = 0 THEN 'A' WHEN l_partkey % 3 = 1 THEN 'N' ELSE 'R' END AS target, l_discount AS score FROM lineitem)
SELECT g, count(*) AS n, round(CASE WHEN bool_or(predicted = target) FILTER (place % 2 = 0) THEN avg(CAST(predicted = target AS DOUBLE)) FILTER (place % 2 = 0) ELSE avg(score) FILTER (place % 2 = 0) END, 6) AS matched,
round(CASE WHEN bool_or(predicted = target) FILTER (place % 2 = 1) THEN avg(CAST(predicted = target AS DOUBLE)) FILTER (place % 2 = 1) ELSE avg(score) FILTER (place % 2 = 1) END, 6) AS mismatched FROM l GROUP BY g""")
def label_matches(spark: SparkSession, sf: str) -> DataFrame:
    l = fx.table(spark, sf, "lineitem")
    target = F.element_at(F.array(*map(F.lit, "ANR")), (F.col("l_partkey") % 3 + 1).cast("int"))
    x = l.select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.col("l_returnflag").alias("predicted"), target.alias("target"), F.col("l_discount").alias("score"))
    return rounded(text.label_matches(x, ["g"], "predicted", "target", "score", "place"))


ASKS = "replace(text, '.', '?')"
ASKED = KEPT.replace("text", f"(CASE WHEN doc_id % 2 = 0 THEN {ASKS} ELSE text END)")


@query(f"""WITH s AS (SELECT doc_id, {ASKED} AS s, CASE WHEN doc_id % 2 = 0 THEN {ASKS} ELSE text END AS t FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [t] END AS s FROM s),
q AS (SELECT doc_id, s, list_filter(s, lambda x: ends_with(x, '?')) AS q, list_filter(s, lambda x: NOT ends_with(x, '?')) AS a FROM k)
SELECT doc_id, CAST(greatest(len(q), 1) * greatest(len(a), 1) AS BIGINT) AS n_pairs, CASE WHEN len(q) > 0 THEN q[1] ELSE s[1] END AS question, CASE WHEN len(a) > 0 THEN a[1] ELSE s[1] END AS statement FROM q""")
def questions_and_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the documents have stops turned to question marks; those without one kind of sentence fall back to the first."""
    d = fx.table(spark, sf, "documents").where("text IS NOT NULL")
    t = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("."), F.lit("?"))).otherwise(F.col("text"))
    q, s = text.questions_and_statements(F.col("s"))
    return d.select("doc_id", text.sentences_kept(t).alias("s")).select("doc_id", (F.size(q) * F.size(s)).cast("long").alias("n_pairs"), F.element_at(q, 1).alias("question"), F.element_at(s, 1).alias("statement"))


@query(f"""WITH {P}, f AS (SELECT rec, frame, CASE WHEN max(score) > 0 THEN 1.0 ELSE 0.0 END AS valid, count(*) FILTER (score >= 0.3) AS active FROM p GROUP BY ALL), j AS (SELECT rec, joint, (var_pop(x) + var_pop(y)) / 2 AS v, sum(score) AS s, count(score) AS n FROM p GROUP BY ALL),
a AS (SELECT rec, avg(valid) AS valid_ratio, avg(active) AS active_joints FROM f GROUP BY rec), b AS (SELECT rec, sum(s) / sum(n) AS joint_confidence, avg(v) AS keypoint_variance FROM j GROUP BY rec)
SELECT rec, round(valid_ratio, 6) AS valid_ratio, round(active_joints, 6) AS active_joints, round(joint_confidence, 6) AS joint_confidence, round(keypoint_variance, 5) AS keypoint_variance FROM a JOIN b USING (rec)""")
def pose_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = frames.pose_quality(_points(spark, sf), ["rec"], "frame", "joint", "x", "y", "score", 0.3)
    return q.select("rec", *[F.round(c, 6).alias(c) for c in ("valid_ratio", "active_joints", "joint_confidence")], F.round("keypoint_variance", 5).alias("keypoint_variance"))


@query(f"""WITH {P}, m AS (SELECT rec, frame, avg(score) AS m FROM p GROUP BY ALL), v AS (SELECT rec, avg(x) / 100 AS before, avg(x) / 200 AS after FROM p GROUP BY rec)
SELECT rec, round(avg(m), 6) AS heatmap_density, round(exp(-max(after)), 6) AS pose_stability, round(1 / (1 + greatest(max(before), 1e-6)), 6) AS motion_coherence, round(1 / (1 + abs(max(before) - max(after))), 6) AS temporal_consistency FROM m JOIN v USING (rec) GROUP BY rec""")
def pose_and_heat(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf)
    v = p.groupBy("rec").agg(F.avg("x").alias("m")).select("rec", *frames.coherence_scores(F.col("m") / 100, F.col("m") / 200))
    return rounded(frames.heat_density(p, ["rec"], "frame", "score").join(v, "rec"))


ROIS = [("seen", "click"), ("seen", "view"), ("rest", "error"), ("rest", "purchase"), ("rest", "signup")]


@query(f"""WITH {DENSE_SQL}, r AS (SELECT * FROM (VALUES {", ".join(map(str, ROIS))}) t(target, feature)) SELECT dyad, person, target, bin, round(avg(value), 6) AS value, 'roi-average' AS method FROM dense JOIN r USING (feature) GROUP BY ALL
UNION ALL SELECT dyad, person, feature, bin, round(value, 6), 'none' FROM dense""")
def targets_by_method(spark: SparkSession, sf: str) -> DataFrame:
    """A target's channels as they are, and by region."""
    d, key = fx.dense(spark, sf), ["dyad", "person"]
    rois = spark.createDataFrame(ROIS, "roi string, feature string")
    return rounded(results.stacked({m: results.targets(d, m, key, rois=rois) for m in ("none", "roi-average")}, "method"))


@query()
def reduced_targets(spark: SparkSession, sf: str) -> DataFrame:
    """T_ components of targets: principal components, and the canonical ones with a partner's features."""
    d = fx.dense(spark, sf)
    a, b = (d.where(F.col("person") == p).drop("person") for p in "AB")
    return rounded(results.stacked({m: results.targets(b, m, ["dyad"], k=2, features=a) for m in ("pca", "cca")}, "method"), 4)


@query(f"""WITH {EVENTS_SQL} SELECT o.method, 'done' AS status, count(DISTINCT dyad) AS n_dyads FROM ev, (VALUES ('overall'), ('leader')) o(method) GROUP BY o.method UNION ALL SELECT 'no such method', 'failed', count(DISTINCT dyad) FROM ev""")
def run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """What a run of the coupling job has noted: methods by status, one of which is unknown and stays due."""
    out = run_folder(spark, "ledger")
    with open(coupling.SETTINGS) as f:
        settings = json.load(f) | {"methods": ["overall", "no such method", "leader"]}
    coupling.run(spark, f"{sf}/events.parquet", out, settings)
    return coupling.ledger(spark, out).groupBy("method", "status").agg(F.count_distinct("dyad").alias("n_dyads"))


@query("""WITH e AS (SELECT user_id, count(*) AS n, round(avg(value), 3) AS value FROM events GROUP BY user_id) SELECT user_id, CAST(n AS INTEGER) AS n, value FROM e""")
def summary_files(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries as CSV rounded to three places with metadata beside them, written and read back."""
    path = run_folder(spark, "summary")
    s = fx.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    writers.save_csv(s, f"{path}/summary", {"n_users": "all"}, digits=3)
    return spark.read.schema("user_id long, n int, value double").option("header", True).option("comment", "#").csv(f"{path}/summary").where("user_id IS NOT NULL")


@query("""WITH a AS (SELECT l_returnflag AS g, list_sort(list(CAST(l_quantity AS DOUBLE))) AS q FROM lineitem GROUP BY l_returnflag)
SELECT g, round(list_avg(q), 6) AS mean, list_min(q) AS min, list_max(q) AS max, CAST(len(q) AS INTEGER) AS shape, CAST((len(q) + 9) // 10 AS INTEGER) AS n_samples, list_sum(list_filter(q, lambda x, i: i % 10 = 1)) AS sampled FROM a WHERE len(q) > 1000
UNION ALL SELECT g, NULL, NULL, NULL, CAST(len(q) AS INTEGER), NULL, list_sum(q) FROM a WHERE len(q) <= 1000""")
def large_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of over a thousand elements as JSON of their statistics and each tenth element, shorter ones as they are; read back."""
    a = fx.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("double"))).alias("q"))
    j = a.select("g", F.size("q").alias("shape"), describe.large_array_json(F.col("q")).alias("j"))
    x = j.withColumn("s", F.from_json("j", "mean double, min double, max double, shape int, samples array<double>")).withColumn("plain", F.when(F.startswith("j", F.lit("[")), F.from_json("j", "array<double>")))
    total = F.aggregate(F.coalesce("plain", "s.samples"), F.lit(0.0), lambda t, v: t + v)
    return x.select("g", F.round("s.mean", 6).alias("mean"), "s.min", "s.max", "shape", F.when(F.col("plain").isNull(), F.size("s.samples")).alias("n_samples"), total.alias("sampled"))


@query("SELECT CAST(o_orderkey % 3 AS BIGINT) AS g, sum(CASE WHEN k BETWEEN -2 AND 4 THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT o_orderkey, o_orderkey % 11 - 5 AS k FROM orders) GROUP BY o_orderkey % 3")
def lags_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """Lags within a range given in seconds, for bins of half a second."""
    low, high = lag_samples("-1.25:2.25", 0.5)  # halves go to the even bin: -2 and 4
    o = fx.table(spark, sf, "orders").select((F.col("o_orderkey") % 3).alias("g"), (F.col("o_orderkey") % 11 - 5).alias("k"))
    return o.groupBy("g").agg(F.count_if(F.col("k").between(low, high)).alias("n"))


@query("""WITH s AS (SELECT user_id, avg(value) AS value, avg(CASE WHEN event_type = 'click' THEN value END) AS click FROM events GROUP BY user_id),
m AS (SELECT avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS value, avg(CASE WHEN click IS NULL THEN 1.0 ELSE 0.0 END) AS click FROM s) SELECT name AS covariate FROM (SELECT unnest(['value', 'click']) AS name, unnest([value, click]) AS gone FROM m) WHERE gone <= 0.2""")
def valid_covariates(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("value"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("click"), F.first("event_type").alias("kind"))
    names = group.valid_covariates(s, ["value", "click", "kind", "missing"])
    return spark.createDataFrame([(n,) for n in names], "covariate string")
