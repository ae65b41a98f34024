"""Queries of operators that work by blocks: all features with several targets, frames and chunks of signals, pairs of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.operators import align, crossed, framing, group, pairwise, synchrony
from dyadspark.operators.multiple import benjamini_hochberg
from dyadspark.plans.groups import SUBSETS_SQL
from dyadspark.plans.registry import query, rounded
from dyadspark.sources import fixtures as fx
from dyadspark.sources.fixtures import EVENTS_SQL, RAW_PAIRS_SQL, corr_sql, r_p_sql

TARGETS = ("purchase", "signup")

TARGET_SQL = EVENTS_SQL + f""",
f AS (SELECT subject, feature AS dimension, CAST(floor(t / 21600.0) AS BIGINT) AS bin, avg(value) AS a FROM ev WHERE feature NOT IN {TARGETS} GROUP BY ALL),
g AS (SELECT feature AS target, CAST(floor(t / 21600.0) AS BIGINT) AS bin, avg(value) AS b FROM ev WHERE feature IN {TARGETS} GROUP BY ALL),
place AS (SELECT subject, bin, row_number() OVER (PARTITION BY subject ORDER BY bin) - 1 AS pos FROM (SELECT DISTINCT subject, bin FROM f SEMI JOIN g USING (bin))),
x AS (SELECT subject, dimension, pos, a FROM f JOIN place USING (subject, bin)), y AS (SELECT subject, target, pos, b FROM g JOIN place USING (bin)),
c AS (SELECT x.subject, dimension, target, l.lag, count(*) AS n, {corr_sql("a", "b")} AS r FROM x CROSS JOIN (SELECT unnest(range(-2, 3)) AS lag) l JOIN y ON x.subject = y.subject AND y.pos = x.pos + l.lag GROUP BY ALL),
p AS (SELECT *, {r_p_sql("r", "n")} AS p FROM c),
q AS (SELECT *, p * count(*) OVER (PARTITION BY subject) / row_number() OVER (PARTITION BY subject ORDER BY p) AS v FROM p WHERE r IS NOT NULL),
fdr AS (SELECT *, least(1.0, min(v) OVER (PARTITION BY subject ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS p_fdr FROM q),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, dimension, target ORDER BY abs(r) DESC, lag) AS k FROM fdr) WHERE k = 1)"""


def _correlated(spark: SparkSession, sf: str) -> DataFrame:
    """Each subject's features with every target component at five lags, tested, with p_fdr over all tests of a subject."""
    e = fx.events(spark, sf)
    features = align.bin_series(e.where(~F.col("feature").isin(*TARGETS)), fx.BIN, ["subject"]).drop("bin_time")
    targets = align.bin_series(e.where(F.col("feature").isin(*TARGETS)), fx.BIN, []).drop("bin_time").withColumnRenamed("feature", "target")
    x, y = crossed.positions(features, targets, ["subject"], [])
    tested = crossed.with_p(crossed.correlations(x, y, ["subject"], -2, 2), fx.BIN)
    return benjamini_hochberg(tested.where("correlation IS NOT NULL"), "p", ["subject"])


@query(f"""WITH {TARGET_SQL} SELECT subject, dimension, target, CAST(lag AS INTEGER) AS lag, n, round(r, 6) + 0.0 AS correlation, round(p, 6) AS p, round(p_fdr, 6) AS p_fdr FROM fdr""")
def multi_target_crosscorr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_correlated(spark, sf).select("subject", "dimension", "target", "lag", "n", "correlation", "p", "p_fdr"))


@query(f"""WITH {TARGET_SQL} SELECT subject, dimension, target, round(r, 6) + 0.0 AS peak_r, lag * CAST(21600.0 AS DOUBLE) AS peak_lag, round(p, 6) AS peak_p FROM top""")
def multi_target_peaks(spark: SparkSession, sf: str) -> DataFrame:
    peak = synchrony.peaks(_correlated(spark, sf), ["subject", "dimension", "target"])
    return rounded(peak.select("subject", "dimension", "target", F.col("correlation").alias("peak_r"), F.col("lag_seconds").alias("peak_lag"), F.col("p").alias("peak_p")))


@query(f"""WITH {TARGET_SQL} SELECT subject, dimension, {", ".join(f"round(max(r) FILTER (target = '{t}'), 6) + 0.0 AS r_{t}, max(lag) FILTER (target = '{t}') * CAST(21600.0 AS DOUBLE) AS lag_{t}" for t in TARGETS)} FROM top GROUP BY ALL""")
def multi_target_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """A row a dimension, two columns a target component: the peak and its lag in seconds."""
    peak = synchrony.peaks(_correlated(spark, sf), ["subject", "dimension", "target"])
    wide = peak.groupBy("subject", "dimension").pivot("target", list(TARGETS)).agg(F.first("correlation").alias("r"), F.first("lag_seconds").alias("lag"))
    return rounded(wide.select("subject", "dimension", *[F.col(f"{t}_{c}").alias(f"{c}_{t}") for t in TARGETS for c in ("r", "lag")]))


SIGNAL_SQL = "s AS (SELECT l_returnflag AS rec, l_quantity - 25 AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem)"


def _signal(spark: SparkSession, sf: str) -> DataFrame:
    """Three long signals: the line items' quantities about their middle, in order."""
    l = fx.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    placed = framing.numbered(l, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "i")
    return placed.select(F.col("l_returnflag").alias("rec"), (F.col("l_quantity") - 25).cast("double").alias("x"), "i")


def _parts(spark: SparkSession, sf: str) -> int:
    l = fx.table(spark, sf, "lineitem")
    return framing.parts(l, l.count())


def _frames_sql(padded: str) -> str:
    return f"""WITH {SIGNAL_SQL}, n AS (SELECT rec, max(i) + 1 AS n FROM s GROUP BY rec),
c AS (SELECT rec, i, CASE WHEN (x < 0) <> lag(x < 0) OVER (PARTITION BY rec ORDER BY i) THEN 1 ELSE 0 END AS c FROM s),
p AS ({padded}), f AS (SELECT rec, n, unnest(range(0, n // 512 + 1)) AS frame FROM n),
e AS (SELECT f.rec, frame, sum(x * x) AS e FROM f LEFT JOIN p ON p.rec = f.rec AND i >= frame * 512 - 1024 AND i < frame * 512 + 1024 GROUP BY ALL),
z AS (SELECT f.rec, frame, sum(c) AS z FROM f LEFT JOIN c ON c.rec = f.rec AND i > frame * 512 - 1024 AND i < frame * 512 + 1024 GROUP BY ALL)
SELECT rec, frame, round(sqrt(coalesce(e, 0) / 2048), 6) AS rms, round(coalesce(z, 0) / 2048.0, 6) AS zero_crossing_rate FROM e JOIN z USING (rec, frame)"""


@query(_frames_sql("SELECT rec, i, x FROM s"))
def framed_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 2048 samples every 512, centred, with zeros beyond the ends."""
    return rounded(framing.frames(_signal(spark, sf), ["rec"], "i", "x", into=_parts(spark, sf)))


@query(_frames_sql("SELECT rec, i, x FROM s UNION ALL SELECT rec, -i, x FROM s WHERE i BETWEEN 1 AND 1024 UNION ALL SELECT rec, 2 * (n - 1) - i, x FROM s JOIN n USING (rec) WHERE i BETWEEN n - 1025 AND n - 2"))
def framed_signal_reflected(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the signal reflected about its ends."""
    return rounded(framing.frames(_signal(spark, sf), ["rec"], "i", "x", reflect=True, into=_parts(spark, sf)))


WEIGHTS = (0.05, 0.1, 0.2, 0.3, 0.2, 0.1, 0.05)


@query(f"""WITH {SIGNAL_SQL} SELECT rec, i, round({" + ".join(f"{w} * coalesce({'lag' if k < 3 else 'lead'}(x, {abs(k - 3)}) OVER o, 0)" for k, w in enumerate(WEIGHTS))}, 6) + 0.0 AS filtered FROM s WINDOW o AS (PARTITION BY rec ORDER BY i)""")
def chunked_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A filter over chunks of 1000 samples with halos; the SQL filters the whole signals."""
    return rounded(framing.filtered(_signal(spark, sf), ["rec"], "i", "x", list(WEIGHTS), 1000, _parts(spark, sf)).select("rec", "i", "filtered"))


V = "list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"""WITH v AS (SELECT label, vec_id, {V.format("embeddings")} AS e FROM embeddings), s AS (SELECT label, count(*) AS n FROM v GROUP BY label),
p AS (SELECT a.label, list_distance(a.e, b.e) AS d, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT s.label, s.n, count(d) AS n_pairs, round(coalesce(avg(d), 0), 6) AS mean_distance, round(avg(c), 6) + 0.0 AS mean_cosine, round(stddev_pop(c), 6) AS sd_cosine, round(min(c), 6) + 0.0 AS min_cosine, round(max(c), 6) + 0.0 AS max_cosine FROM s LEFT JOIN p USING (label) GROUP BY s.label, s.n""")
def pair_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairwise.pair_statistics(fx.table(spark, sf, "embeddings"), ["label"], ["vec_id"], "embedding"))


@query(f"""WITH {RAW_PAIRS_SQL}, {SUBSETS_SQL}, sums AS (SELECT n, coalesce(list_sum(s), 0) AS w FROM bits),
d AS (SELECT dimension, avg(a) - avg(b) AS d FROM raw GROUP BY dyad, dimension),
k AS (SELECT *, rank() OVER (PARTITION BY dimension ORDER BY abs(d)) AS k FROM d WHERE d <> 0),
t AS (SELECT dimension, count(*) AS n, least(coalesce(sum(k) FILTER (d > 0), 0), coalesce(sum(k) FILTER (d < 0), 0)) AS w FROM k GROUP BY dimension)
SELECT dimension, t.n, CAST(t.w AS DOUBLE) AS wilcoxon_W, round(CAST(least(1.0, 2.0 * count(*) FILTER (sums.w <= t.w) / count(*)) AS DOUBLE), 9) AS p_wilcoxon FROM t JOIN sums USING (n) GROUP BY dimension, t.n, t.w""")
def wilcoxon_paired(spark: SparkSession, sf: str) -> DataFrame:
    """The means of a dyad's two persons, paired, over dyads, with the exact p (there are ten dyads at most)."""
    two = fx.raw_pairs(spark, sf).groupBy("dyad", "dimension").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return rounded(group.paired_signed_rank(two, "a", "b", ["dimension"]), 9)
