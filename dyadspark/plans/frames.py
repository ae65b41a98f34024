"""Queries of frame-level post-processing. Line items stand for points of a frame; embeddings for probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.functions.columns import mid_rank
from dyadspark.operators import frames, framing
from dyadspark.plans.registry import query, rounded
from dyadspark.sources import fixtures as fx


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """rec, frame, i, x, y, score, joint: one row a line item, ordered within its supplier."""
    l = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("rec"), F.col("l_quantity").alias("x"), F.round(F.col("l_extendedprice") / 1000, 6).alias("y"), (F.col("l_discount") * 10).alias("score"), F.col("l_linenumber").alias("joint"), "l_orderkey", "l_partkey", "l_shipdate")
    l = framing.numbered(l, ["rec"], ["l_orderkey", "joint", "l_partkey", "x", "y", "score", "l_shipdate"], "i")
    return l.withColumn("frame", F.floor(F.col("i") / 5).cast("long")).withColumn("score", F.round("score", 6))


P = """l AS (SELECT l_suppkey AS rec, l_quantity AS x, round(l_extendedprice / 1000, 6) AS y, round(l_discount * 10, 6) AS score, l_linenumber AS joint,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, round(l_extendedprice / 1000, 6), l_discount * 10, l_shipdate) - 1 AS i FROM lineitem),
p AS (SELECT *, CAST(i // 5 AS BIGINT) AS frame FROM l)"""


@query(f"WITH {P} SELECT rec, round(avg(coalesce(x, 0)), 5) AS x, round(avg(coalesce(y, 0)), 5) AS y FROM p GROUP BY rec")
def frame_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.frame_means(_points(spark, sf), ["rec"], ["x", "y"]), 5)


@query(f"""WITH {P}, f AS (SELECT rec, frame, count(*) FILTER (score > 0.8) AS n FROM p GROUP BY ALL)
SELECT rec, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS detection_rate, count(*) FILTER (n > 0) AS frames_detected, round(avg(n), 6) AS avg_active, max(n) AS max_active FROM f GROUP BY rec""")
def detection_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.detection_rate(_points(spark, sf), ["rec"], "frame", "score", 0.8))


@query(f"WITH {P} SELECT rec, frame, i FROM (SELECT *, row_number() OVER (PARTITION BY rec, frame ORDER BY abs(x + 3.0 / 2 - 50.0 / 2), i) AS k FROM p) WHERE k = 1")
def central_pick(spark: SparkSession, sf: str) -> DataFrame:
    d = frames.central_distance(F.col("x"), F.lit(3.0), F.lit(50.0))
    return frames.best_row(_points(spark, sf), ["rec", "frame"], [d, F.col("i")]).select("rec", "frame", F.col("i").cast("long").alias("i"))


@query(f"WITH {P} SELECT rec, frame, i, round(x * y, 6) AS area FROM (SELECT *, row_number() OVER (PARTITION BY rec, frame ORDER BY x * y DESC, i) AS k FROM p) WHERE k = 1")
def largest_face(spark: SparkSession, sf: str) -> DataFrame:
    b = frames.best_row(_points(spark, sf), ["rec", "frame"], [F.desc(F.col("x") * F.col("y")), F.col("i")])
    return rounded(b.select("rec", "frame", F.col("i").cast("long").alias("i"), (F.col("x") * F.col("y")).alias("area")), 6)


@query(f"""WITH {P} SELECT rec, round(avg(score), 6) AS AP, round(avg(CAST(score > 0.5 AS DOUBLE)), 6) AS AP_50, round(avg(CAST(score > 0.75 AS DOUBLE)), 6) AS AP_75, round(coalesce(avg(score) FILTER (score > 0.3 AND score <= 0.7), 0), 6) AS AP_M, round(coalesce(avg(score) FILTER (score > 0.7), 0), 6) AS AP_L FROM p GROUP BY rec""")
def confidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.confidence_bands(_points(spark, sf), ["rec"], "score"))


@query(f"""WITH {P}, d AS (SELECT *, abs(score - lag(score) OVER (PARTITION BY rec, joint ORDER BY i)) AS d FROM p)
SELECT rec, round(avg(score), 6) AS AP, round(avg(CAST(score >= 0.5 AS DOUBLE)), 6) AS AR, round(coalesce(avg(d), 0), 6) AS AU, count(DISTINCT joint) FILTER (score >= 0.5) AS active_joints FROM d GROUP BY rec""")
def keypoint_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.visibility(_points(spark, sf), ["rec"], "joint", "i", "score"))


@query(f"""WITH {P}, m AS (SELECT * FROM (VALUES ('head', 1), ('head', 2), ('arms', 3), ('arms', 4), ('legs', 5), ('legs', 6))m(part, joint))
SELECT rec, part, round(avg(score), 9) AS confidence, avg(score) > 0.4567 AS counted FROM p JOIN m USING (joint) GROUP BY ALL""")
def body_parts(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.createDataFrame([("head", 1), ("head", 2), ("arms", 3), ("arms", 4), ("legs", 5), ("legs", 6)], "part string, joint int")
    return rounded(frames.part_means(_points(spark, sf), m, ["rec"], "score", 0.4567), 9)


PROB = "list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))"


@query(f"""WITH p AS (SELECT label, {PROB} AS e FROM embeddings), s AS (SELECT label, list_transform(e, lambda x: x / list_sum(e)) AS e FROM p),
u AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM s) GROUP BY ALL), c AS (SELECT label, avg(list_max(e)) AS c FROM s GROUP BY label),
m AS (SELECT label, list(x ORDER BY i) AS m, any_value(c) AS c FROM u JOIN c USING (label) GROUP BY label)
SELECT label, round(c, 5) AS mean_confidence, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS dominant, round(-list_sum(list_transform(m, lambda x: greatest(x, 1e-6) * ln(greatest(x, 1e-6)))) / ln(len(m)), 5) AS entropy FROM m""")
def class_probs_entropy(spark: SparkSession, sf: str) -> DataFrame:
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    p = fx.table(spark, sf, "embeddings").select("label", F.transform(e, lambda x: x / total).alias("e"))
    return rounded(frames.class_means(p, ["label"], "e", 64).drop("means"), 5)


@query(f"""WITH {P} SELECT rec, round(avg(abs(x - y) / y), 5) AS abs_rel, round(avg(power(x - y, 2) / y), 4) AS sq_rel, round(sqrt(avg(power(x - y, 2))), 5) AS rmse, round(sqrt(avg(power(ln(x) - ln(y), 2))), 5) AS rmse_log,
round(avg(CAST(greatest(x / y, y / x) < 1.25 AS DOUBLE)), 6) AS delta_1, round(avg(CAST(greatest(x / y, y / x) < 1.5625 AS DOUBLE)), 6) AS delta_2, round(avg(CAST(greatest(x / y, y / x) < 1.953125 AS DOUBLE)), 6) AS delta_3 FROM p WHERE y > 0.01 GROUP BY rec""")
def depth_errors(spark: SparkSession, sf: str) -> DataFrame:
    d = frames.depth_errors(_points(spark, sf), ["rec"], "x", "y")
    return d.select("rec", *[F.round(c, n).alias(c) for c, n in (("abs_rel", 5), ("sq_rel", 4), ("rmse", 5), ("rmse_log", 5), ("delta_1", 6), ("delta_2", 6), ("delta_3", 6))])


@query(f"""WITH {P}, q AS (SELECT rec, quantile_cont(y, 0.7) AS q FROM p GROUP BY rec), m AS (SELECT rec, avg(x) AS m, avg(x) FILTER (y > q) AS f, stddev_pop(x) FILTER (y > q) AS sd, avg(x) FILTER (y <= q) AS b FROM p JOIN q USING (rec) GROUP BY rec)
SELECT rec, round(m, 5) AS avg_motion_magnitude, round(coalesce(f, 0) / (m + 1e-8), 5) AS foreground_motion_ratio, round(coalesce(b, 0) / (m + 1e-8), 5) AS background_motion_ratio, round(CASE WHEN f IS NULL THEN 0.0 ELSE least(1.0, f / (sd + 1e-8) / 10) END, 5) AS object_interaction_score FROM m""")
def foreground_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.split_at_quantile(_points(spark, sf), ["rec"], "y", "x"), 5)


@query(f"""WITH {P}, m AS (SELECT rec, var_pop(y / 255.0) AS v, max(y / 255.0) - min(y / 255.0) AS r FROM p GROUP BY rec)
SELECT rec, round(greatest(0.1, least(0.5, v * 2)), 6) AS abs_rel, round(greatest(0.05, least(0.3, v * 1.5)), 6) AS sq_rel, round(greatest(0.2, least(1.0, r * 0.8)), 6) AS rmse, round(greatest(0.1, least(0.4, v * 1.2)), 6) AS rmse_log,
round(greatest(0.5, least(0.95, 1 - v)), 6) AS delta_1, round(greatest(0.7, least(0.98, 1 - v * 0.8)), 6) AS delta_2, round(greatest(0.8, least(0.99, 1 - v * 0.6)), 6) AS delta_3 FROM m""")
def depth_proxies(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.depth_proxies(_points(spark, sf), ["rec"], "y"))


IMAGE_SQL = """g AS (SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, 100 * CAST(x AS DOUBLE) AS d FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


@query(f"""WITH {IMAGE_SQL}, n AS (SELECT *, coalesce(lag(d) OVER a, lead(d) OVER a, d) AS l, coalesce(lead(d) OVER a, lag(d) OVER a, d) AS n FROM g WINDOW a AS (PARTITION BY vec_id, r ORDER BY c)),
s AS (SELECT vec_id, r, c, n - l AS slope, l + 2 * d + n AS smooth FROM n),
e AS (SELECT vec_id, coalesce(lag(slope) OVER b, lead(slope) OVER b, slope) + 2 * slope + coalesce(lead(slope) OVER b, lag(slope) OVER b, slope) AS gx, coalesce(lead(smooth) OVER b, lag(smooth) OVER b, smooth) - coalesce(lag(smooth) OVER b, lead(smooth) OVER b, smooth) AS gy FROM s WINDOW b AS (PARTITION BY vec_id, c ORDER BY r))
SELECT vec_id, round(least(1.0, avg(sqrt(gx * gx + gy * gy)) / 50), 6) AS depth_discontinuity_score FROM e GROUP BY vec_id""")
def depth_discontinuity(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as images of eight columns."""
    g = fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    g = g.select("vec_id", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).alias("c"), (100 * F.col("x").cast("double")).alias("d"))
    return rounded(frames.edge_score(g, ["vec_id"], "r", "c", "d"))


@query(f"""WITH {P}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY rec ORDER BY i) AS d FROM p) SELECT rec, round(1 - least(1.0, coalesce(stddev_pop(d), 0) / (avg(x) + 1e-8)), 5) + 0.0 AS temporal_consistency, round(avg(x) FILTER (x > 0), 5) AS positive_mean FROM d GROUP BY rec""")
def temporal_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.temporal_consistency(_points(spark, sf), ["rec"], "i", "x"), 5)


@query(f"""WITH {P} SELECT rec, round(avg(x), 5) AS mean_magnitude, round(stddev_pop(x), 5) AS std_magnitude, max(x) AS max_magnitude, round(coalesce(sum(y * x) / sum(x), 0), 5) AS direction, round(1 / (1 + stddev_pop(x)), 5) AS consistency FROM p GROUP BY rec""")
def weighted_direction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.flow_direction(_points(spark, sf), ["rec"], "x", "y"), 5)


@query(f"""WITH {P}, s AS (SELECT rec, CAST(ntile(4) OVER w - 1 AS INTEGER) AS segment, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS v FROM p WINDOW w AS (PARTITION BY rec ORDER BY i))
SELECT rec, segment, round(avg(v), 5) AS mean_speed, round(avg(CAST(v > 20 AS DOUBLE)), 5) AS dynamic_share FROM s WHERE v IS NOT NULL GROUP BY ALL""")
def track_speeds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.track_speeds(_points(spark, sf), ["rec"], "i", "x", "y", 20.0, 4), 5)


@query(f"""WITH {P}, v AS (SELECT rec, i, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM p WINDOW w AS (PARTITION BY rec ORDER BY i)), a AS (SELECT *, vx - lag(vx) OVER w AS ax, vy - lag(vy) OVER w AS ay FROM v WINDOW w AS (PARTITION BY rec ORDER BY i)),
m AS (SELECT rec, avg(sqrt(vx * vx + vy * vy)) AS v, avg(sqrt(ax * ax + ay * ay)) AS a FROM a GROUP BY rec)
SELECT rec, round(v, 5) AS velocity, round(a, 5) AS acceleration, round(exp(-coalesce(a, 0)), 5) AS smoothness, round(1 / (1 + coalesce(v, 0)), 5) AS stability FROM m""")
def pose_smoothness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.motion_norms(_points(spark, sf), ["rec"], "i", ["x", "y"]), 5)


@query(f"""WITH {P}, t AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy FROM p WINDOW w AS (PARTITION BY rec ORDER BY i)), la AS (SELECT rec, x AS x0, y AS y0, vx, vy FROM t WHERE i = 4),
e AS (SELECT t.rec, s, i - 4 AS k, sqrt(power(x0 + la.vx * s * (i - 4) - x, 2) + power(y0 + la.vy * s * (i - 4) - y, 2)) AS d FROM t JOIN la USING (rec) CROSS JOIN (SELECT unnest([0.5, 1.0, 1.5])::DOUBLE AS s) WHERE i > 4),
m AS (SELECT rec, s, avg(d) AS ade, arg_max(d, k) AS fde FROM e GROUP BY ALL) SELECT rec, round(min(ade), 5) AS minADE, round(min(fde), 5) AS minFDE, min(fde) > 100 AS missed FROM m GROUP BY rec""")
def cv_prediction_ade(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.predicted_errors(_points(spark, sf), ["rec"], "i", "x", "y", 4, [0.5, 1.0, 1.5], 100.0), 5)


@query(f"""WITH {P}, b AS (SELECT rec, frame, x, y, 20.0 AS w, 10.0 AS h FROM p), m AS (SELECT a.rec, a.frame, CASE WHEN b.rec IS NULL THEN 0 ELSE 1 END * greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter FROM b a LEFT JOIN b ON b.rec = a.rec AND b.frame = a.frame - 1)
SELECT rec, frame, coalesce(max(inter / (400.0 - inter)) > 0.3, false) AS matched FROM m GROUP BY ALL""")
def iou_match(spark: SparkSession, sf: str) -> DataFrame:
    b = _points(spark, sf).withColumn("w", F.lit(20.0)).withColumn("h", F.lit(10.0))
    return frames.matches_previous(b, ["rec"], "frame", ["x", "y", "w", "h"])


@query(f"""WITH {P}, c AS (SELECT rec, i, greatest(0.0, least(1.0, coalesce(1 - stddev_pop(x) OVER w / avg(x) OVER w, 0))) AS c FROM p WINDOW w AS (PARTITION BY rec ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT rec, i, round(c, 5) + 0.0 AS consistency FROM c""")
def detection_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.detection_consistency(_points(spark, sf), ["rec"], "i", "x").select("rec", F.col("i").cast("long").alias("i"), "consistency"), 5)


@query(f"""WITH {P}, c AS (SELECT rec, joint, count(*) AS n, count(*) FILTER (score > 0.5) AS t FROM p GROUP BY ALL) SELECT rec, arg_min(joint, joint - 100 * n) AS mode, sum(t) > sum(n) / 2.0 AS flagged FROM c GROUP BY rec""")
def mode_vote(spark: SparkSession, sf: str) -> DataFrame:
    return frames.majority(_points(spark, sf).withColumn("flag", F.col("score") > 0.5), ["rec"], "joint", "flag")


@query("""SELECT l_returnflag AS rec, CAST(floor(l_quantity * 5 / 32) AS INTEGER) AS bin_r, CAST(floor(l_partkey % 256 / 32.0) AS INTEGER) AS bin_g, CAST(floor(l_suppkey % 256 / 32.0) AS INTEGER) AS bin_b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY l_returnflag, floor(l_quantity * 5 / 32), floor(l_partkey % 256 / 32.0), floor(l_suppkey % 256 / 32.0)""")
def color_histogram(spark: SparkSession, sf: str) -> DataFrame:
    l = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("rec"), (F.col("l_quantity") * 5).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_suppkey") % 256).alias("b"))
    return rounded(frames.color_histogram(l, ["rec"], ["r", "g", "b"]))


@query(f"""WITH {P} SELECT rec, round(avg(CAST(x > 25 AS DOUBLE)), 6) AS coverage, round(coalesce(count(*) FILTER (x > 25 AND y > 30) / CAST(nullif(count(*) FILTER (x > 25 OR y > 30), 0) AS DOUBLE), 0), 6) AS iou FROM p GROUP BY rec""")
def mask_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.mask_overlap(_points(spark, sf).withColumn("m", F.col("x") > 25).withColumn("b", F.col("y") > 30), ["rec"], "m", "b"))


@query(f"""WITH {P}, n AS (SELECT rec, i, x / greatest(max(abs(x)) OVER w, max(abs(y)) OVER w) AS x, y / greatest(max(abs(x)) OVER w, max(abs(y)) OVER w) AS y FROM p WINDOW w AS (PARTITION BY rec)) SELECT rec, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM n GROUP BY rec""")
def normalized_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    n = frames.normalized_coordinates(_points(spark, sf), ["rec"], ["x", "y"])
    return rounded(n.groupBy("rec").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))


@query(f"""WITH {P}, k AS (SELECT rec, frame, avg(x) AS x FROM p GROUP BY ALL), g AS (SELECT rec, CAST(unnest(range(0, max(frame) + 1)) AS INTEGER) AS frame FROM p GROUP BY rec) SELECT g.rec, g.frame, round(coalesce(x, 0), 5) AS x FROM g LEFT JOIN k ON k.rec = g.rec AND k.frame = g.frame""")
def densified_frames(spark: SparkSession, sf: str) -> DataFrame:
    """All frames up to a recording's last; those without points, gaps of the data, are zeros."""
    p = _points(spark, sf)
    n = p.groupBy("rec").agg((F.max("frame") + 1).alias("n"))
    return rounded(frames.densified_frames(p.groupBy("rec", "frame").agg(F.avg("x").alias("x")), n, ["rec"], "frame", "n", ["x"]), 5)


@query(f"""WITH {P} SELECT rec, round(sum(x), 4) AS total_motion, round(avg(x), 5) AS average_motion FROM p WHERE i < 10 GROUP BY rec""")
def flow_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.flow_totals(_points(spark, sf), ["rec"], "i", "x"), 5)


@query(f"""WITH {P}, n AS (SELECT rec, count(*) AS n FROM p GROUP BY rec), s AS (SELECT DISTINCT rec, s FROM (SELECT rec, unnest(list_append(list_filter(range(0, n, 4), lambda s: s <= n - 8), greatest(0, n - 8))) AS s FROM n)),
m AS (SELECT s.rec, s.s, p.i, avg(x) OVER (PARTITION BY s.rec, s.s) AS m FROM s JOIN p ON p.rec = s.rec AND p.i >= s.s AND p.i < s.s + 8) SELECT rec, i, round(avg(m), 5) AS smoothed FROM m GROUP BY ALL""")
def overlap_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.smoothed_by_overlap(_points(spark, sf), ["rec"], "i", "x", 8, 4).select("rec", F.col("i").cast("long").alias("i"), "smoothed"), 5)


UNITS_SQL = " UNION ALL ".join(f"SELECT rec, '{n}' AS unit, greatest(0.0, least(1.0, ({plus}{f' - {minus}' if minus else ''}) * {slope})) AS a FROM r" for n, (plus, minus, slope) in frames.ACTION_UNITS.items())


@query(f"""WITH {P}, r AS (SELECT rec, x / 50 AS mean, score / 2 AS std, score AS eye, y / 200 AS mouth, y / 100 AS cheek FROM p), u AS ({UNITS_SQL})
SELECT rec, unit, round(avg(a), 6) AS activation, round(avg(CASE WHEN a < 0.25 THEN 1 - a * 2 ELSE 0 END), 6) AS level_0, round(avg(CASE WHEN a < 0.25 THEN a * 2 WHEN a < 0.5 THEN 1 - (a - 0.25) * 4 ELSE 0 END), 6) AS level_33,
round(avg(CASE WHEN a < 0.25 THEN 0 WHEN a < 0.5 THEN (a - 0.25) * 4 WHEN a < 0.75 THEN 1 - (a - 0.5) * 4 ELSE 1 - (a - 0.75) * 4 END), 6) AS level_66, round(avg(CASE WHEN a < 0.5 THEN 0 WHEN a < 0.75 THEN (a - 0.5) * 4 ELSE (a - 0.75) * 4 END), 6) AS level_99 FROM u GROUP BY ALL""")
def action_units(spark: SparkSession, sf: str) -> DataFrame:
    """All action units of five regions' intensities, with the mean weights of their levels."""
    au = frames.action_units(F.col("x") / 50, F.col("score") / 2, F.col("score"), F.col("y") / 200, F.col("y") / 100)
    u = _points(spark, sf).select("rec", F.explode(au).alias("unit", "a")).withColumn("l", frames.intensity_levels(F.col("a")))
    return rounded(u.groupBy("rec", "unit").agg(F.avg("a").alias("activation"), *[F.avg(F.col("l")[k]).alias(f"level_{n}") for k, n in enumerate((0, 33, 66, 99))]))


@query(f"""WITH {P} SELECT rec, i, CAST(rank() OVER (PARTITION BY rec ORDER BY x) + (count(*) OVER (PARTITION BY rec, x) - 1) / 2.0 AS DOUBLE) AS k FROM p""")
def mid_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).select("rec", F.col("i").cast("long").alias("i"), mid_rank(F.col("x"), ["rec"]).alias("k"))


@query(f"""WITH {P} SELECT rec, frame, CASE WHEN score > 0.5 THEN x * 4 ELSE 0 END AS x, CASE WHEN score > 0.5 THEN round(y * 4, 6) ELSE 0 END AS y, CASE WHEN score > 0.5 THEN score ELSE 0 END AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY rec, frame ORDER BY score DESC, y, x) AS k FROM p) WHERE k = 1""")
def heatmap_keypoints(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.heatmap_keypoints(_points(spark, sf), ["rec", "frame"], "x", "y", "score", 0.5, 4.0))


@query(f"WITH {P} SELECT rec, frame, count(*) FILTER (score > 0.3) AS total_activations, round(avg(score), 6) AS avg_intensity FROM p GROUP BY ALL")
def activation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.activation_summary(_points(spark, sf), ["rec", "frame"], "score", 0.3))


def _flow_sql() -> str:
    per, out = [], []
    for name, (f, d) in frames.FLOW_REGIONS.items():
        inside = " AND ".join([c if yes else f"NOT {c}" for c, yes in (("f", f), ("d", d)) if yes is not None] or ["true"])
        per += [f"avg({c}) FILTER ({inside}) AS {c}_{name}" for c in ("m", "uu", "vv")]
        mean = f"sqrt(uu_{name} * uu_{name} + vv_{name} * vv_{name})"
        out += [f"round(avg(coalesce(m_{name}, 0)), 5) AS of_{name}_epe_st", f"round(avg(coalesce(({mean} * {mean} / ({mean} + 1e-6) + 1) / 2, 0)), 5) AS of_{name}_r2_st"]
    return f"""WITH {P}, c AS (SELECT rec, frame, x - 25 AS u, y - 30 AS v, score > 0.5 AS f FROM p), q AS (SELECT *, sqrt(u * u + v * v) AS m FROM c),
n AS (SELECT rec, frame, m, u / (m + 1e-6) AS uu, v / (m + 1e-6) AS vv, f, m > 20 AS d FROM q), g AS (SELECT rec, frame, {", ".join(per)} FROM n GROUP BY rec, frame)
SELECT rec, {", ".join(out)} FROM g GROUP BY rec"""


@query(_flow_sql())
def region_flow(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf).withColumn("u", F.col("x") - 25).withColumn("v", F.col("y") - 30)
    return rounded(frames.region_flow(p, ["rec"], "frame", "u", "v", F.col("score") > 0.5, 20.0), 5)


@query("""SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(x), 5) + 0.0 AS mean, round(stddev_pop(x), 5) AS std, count(x) AS n
FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL""")
def array_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.array_moments(fx.table(spark, sf, "embeddings"), ["label"], "embedding"), 5)


@query(f"""WITH {P}, s AS (SELECT rec, CASE WHEN x BETWEEN 0 AND 20 AND score * 255 >= 48 AND y * 3 >= 80 THEN (x + y + score) / 3 END AS l FROM p)
SELECT rec, round(coalesce(avg(l), 0), 5) AS skin_mean, round(coalesce(stddev_pop(l), 0), 5) AS skin_std FROM s GROUP BY rec""")
def skin_luminance(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf).withColumn("s", F.col("score") * 255).withColumn("v", F.col("y") * 3)
    return rounded(frames.skin_luminance(p, ["rec"], ["x", "s", "v"], ["x", "y", "score"]), 5)


@query(f"""WITH {P}, m AS (SELECT rec, frame, max(score) AS s FROM p GROUP BY ALL) SELECT rec, round(avg(s), 6) AS AP, round(avg(CAST(s > 0.5 AS DOUBLE)), 6) AS AP_50, round(avg(CAST(s > 0.75 AS DOUBLE)), 6) AS AP_75,
round(coalesce(avg(s) FILTER (s > 0.3 AND s <= 0.7), 0), 6) AS AP_M, round(coalesce(avg(s) FILTER (s > 0.7), 0), 6) AS AP_L FROM m GROUP BY rec""")
def frame_maximum_bands(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.frame_maximum_bands(_points(spark, sf), ["rec"], "frame", "score"))


@query(f"""WITH {P} SELECT rec, i, count(*) FILTER (score > 0.5) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) || '/10' AS consistency FROM p""")
def consistency_strings(spark: SparkSession, sf: str) -> DataFrame:
    return frames.consistency_strings(_points(spark, sf), ["rec"], "i", F.col("score") > 0.5).select("rec", F.col("i").cast("long").alias("i"), "consistency")


@query(f"WITH {P} SELECT rec, i, round(2 * x / 50 - 1, 6) AS unit, round(x, 6) AS back FROM p")
def unit_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates of frames of 50 to [-1, 1] and back."""
    unit = frames.to_unit(F.col("x"), F.lit(50.0))
    return rounded(_points(spark, sf).select("rec", F.col("i").cast("long").alias("i"), unit.alias("unit"), frames.from_unit(unit, F.lit(50.0)).alias("back")))


@query(f"""WITH {P}, s AS (SELECT rec, frame, i, CASE WHEN joint % 3 = 0 THEN score WHEN joint % 3 = 1 THEN y / 200 ELSE (x / 100 + y / 100) / 2 END AS s FROM p)
SELECT rec, frame, i, round(s, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rec, frame ORDER BY s DESC, i) AS k FROM s) WHERE k = 1""")
def best_instance(spark: SparkSession, sf: str) -> DataFrame:
    """The best instance of each frame; a third of them has scores of its own, a third its box's, a third its keypoints'."""
    j = F.col("joint") % 3
    s = frames.instance_score(F.when(j == 0, F.col("score")), F.when(j == 1, F.col("y") / 200), F.array(F.col("x") / 100, F.col("y") / 100))
    p = _points(spark, sf).withColumn("s", s)
    return rounded(frames.best_row(p, ["rec", "frame"], [F.desc("s"), F.col("i")]).select("rec", "frame", F.col("i").cast("long").alias("i"), F.col("s").alias("score")), 9)
