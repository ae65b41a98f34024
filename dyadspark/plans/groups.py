"""Queries of group inference. Correlations stand for dyads, dimensions and two bin widths as methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadspark.operators import group, states, synchrony
from dyadspark.plans.dyads import HIGH, LOW, PEAK_SQL, STEP, WIDTH, WINDOWS_SQL, _peaks_sql
from dyadspark.plans.registry import query, rounded
from dyadspark.sources import fixtures as fx
from dyadspark.sources.fixtures import STATES_SQL


def _peaks(spark: SparkSession, sf: str) -> DataFrame:
    c = synchrony.lagged_correlation(fx.pairs(spark, sf), LOW, HIGH, fx.BIN)
    return synchrony.peaks(c, ["dyad", "dimension"])


Z = "atanh(greatest(-0.9999, least(0.9999, correlation)))"


@query(f"""WITH {PEAK_SQL} SELECT dimension, count(*) AS n, round(tanh(avg({Z})), 6) AS mean_r, round(stddev_samp({Z}), 6) AS sd, round(avg({Z}) / (stddev_samp({Z}) / sqrt(count(*))), 5) AS t_stat, round(avg({Z}) / stddev_samp({Z}), 5) AS cohens_d FROM peak GROUP BY dimension""")
def group_ttest(spark: SparkSession, sf: str) -> DataFrame:
    t = group.correlation_test(_peaks(spark, sf), "correlation", ["dimension"])
    return t.select("dimension", "n", F.round("mean_r", 6).alias("mean_r"), F.round("sd", 6).alias("sd"), F.round("t_stat", 5).alias("t_stat"), F.round("cohens_d", 5).alias("cohens_d"))


@query(f"""WITH {PEAK_SQL}, t AS (SELECT dimension, count(*) + 1 AS n, avg({Z}) / (stddev_samp({Z}) / sqrt(count(*))) AS t FROM peak GROUP BY dimension), r AS (SELECT dimension, n, t / sqrt(t * t + n - 2) AS r FROM t)
SELECT dimension, round({fx.r_p_sql("r", "n")}, 6) AS p_value FROM r""")
def group_ttest_p(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.correlation_test(_peaks(spark, sf), "correlation", ["dimension"]).select("dimension", "p_value"))


@query(f"""WITH {PEAK_SQL}, r AS (SELECT dimension, correlation, rank() OVER (PARTITION BY dimension ORDER BY abs(correlation)) + (count(*) OVER (PARTITION BY dimension, abs(correlation)) - 1) / 2.0 AS k FROM peak WHERE correlation <> 0)
SELECT dimension, count(*) AS n, CAST(least(coalesce(sum(k) FILTER (correlation > 0), 0), coalesce(sum(k) FILTER (correlation < 0), 0)) AS DOUBLE) AS wilcoxon_W FROM r GROUP BY dimension""")
def wilcoxon_w(spark: SparkSession, sf: str) -> DataFrame:
    return group.signed_rank(_peaks(spark, sf), "correlation", ["dimension"]).select("dimension", "n", "wilcoxon_W")


def _methods(spark: SparkSession, sf: str) -> DataFrame:
    p = _peaks(spark, sf)
    return p.select("dyad", "dimension", F.lit("peak").alias("method"), "correlation").unionByName(synchrony.overall(fx.pairs(spark, sf)).select("dyad", "dimension", F.lit("overall").alias("method"), F.col("pearson_pearson_r_overall").alias("correlation"))).unionByName(
        synchrony.overall(fx.pairs(spark, sf)).select("dyad", "dimension", F.lit("concordance").alias("method"), F.col("concordance_concordance_ccc_overall").alias("correlation"))
    )


METHODS_SQL = PEAK_SQL + f""",
ov AS (SELECT dyad, dimension, {fx.corr_sql("a", "b")} AS r, {fx.ccc_sql("a", "b")} AS c FROM pair GROUP BY ALL),
methods AS (SELECT dyad, dimension, 'peak' AS method, correlation FROM peak UNION ALL SELECT dyad, dimension, 'overall', r FROM ov UNION ALL SELECT dyad, dimension, 'concordance', c FROM ov),
per AS (SELECT dyad, method, avg(abs(correlation)) AS mean_abs_r FROM methods GROUP BY ALL),
per9 AS (SELECT dyad, method, round(mean_abs_r, 9) AS mean_abs_r FROM per)"""


@query(f"WITH {METHODS_SQL} SELECT method, count(*) AS n_obs, round(avg(mean_abs_r), 6) AS mean_abs_r, round(stddev_samp(mean_abs_r), 6) AS sd_abs_r, round(median(mean_abs_r), 6) AS median_abs_r FROM per GROUP BY method")
def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.method_means(_methods(spark, sf), "correlation", ["dyad"])[1])


@query(f"""WITH {METHODS_SQL}, r AS (SELECT dyad, method, rank() OVER (PARTITION BY dyad ORDER BY mean_abs_r) + (count(*) OVER (PARTITION BY dyad, mean_abs_r) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY dyad, mean_abs_r) AS t FROM per9),
s AS (SELECT method, sum(k) AS s, count(*) AS n, sum(t * t - 1) AS tied FROM r GROUP BY method)
SELECT 1 AS one, max(n) AS n_blocks, count(*) AS n_treatments, round(CAST((12.0 / (max(n) * 3 * 4) * sum(s * s) - 3 * max(n) * 4) / (1 - sum(tied) / (max(n) * 3.0 * 8)) AS DOUBLE), 5) AS chi2, round(exp(-CAST((12.0 / (max(n) * 3 * 4) * sum(s * s) - 3 * max(n) * 4) / (1 - sum(tied) / (max(n) * 3.0 * 8)) AS DOUBLE) / 2), 5) AS p_value FROM s""")
def friedman_chi2(spark: SparkSession, sf: str) -> DataFrame:
    per = group.method_means(_methods(spark, sf), "correlation", ["dyad"])[0].withColumn("one", F.lit(1)).withColumn("mean_abs_r", F.round("mean_abs_r", 9))
    return rounded(group.friedman(per, "mean_abs_r", "dyad", "method", ["one"]), 5)


@query(f"""WITH {METHODS_SQL} SELECT dyad, round(max(mean_abs_r) FILTER (method = 'peak'), 6) AS peak, round(max(mean_abs_r) FILTER (method = 'overall'), 6) AS overall FROM per GROUP BY dyad HAVING count(DISTINCT method) = 3""")
def method_pivot(spark: SparkSession, sf: str) -> DataFrame:
    per = group.method_means(_methods(spark, sf), "correlation", ["dyad"])[0]
    return rounded(per.groupBy("dyad").pivot("method", ["peak", "overall", "concordance"]).agg(F.first("mean_abs_r")).dropna().drop("concordance"))


LEADERS_SQL = f"""{WINDOWS_SQL}, {_peaks_sql("r")}, med AS (SELECT dyad, dimension, median(peak_lag) AS m FROM best GROUP BY ALL),
lead AS (SELECT dyad, dimension, CASE WHEN m > 0 THEN 'A' WHEN m < 0 THEN 'B' ELSE 'sync' END AS leader FROM med),
cnt AS (SELECT dimension, count(*) FILTER (leader = 'A') AS n_A_leads, count(*) FILTER (leader = 'B') AS n_B_leads, count(*) FILTER (leader = 'sync') AS n_sync, count(*) AS n_total FROM lead GROUP BY dimension)"""


@query(f"""WITH {LEADERS_SQL} SELECT dimension, n_A_leads, n_B_leads, n_sync, n_total, CASE WHEN n_A_leads + n_B_leads > 0 THEN round(least(1.0, 2 * (SELECT sum(CAST(factorial(CAST(n_A_leads + n_B_leads AS INTEGER)) AS DOUBLE) / (CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) * CAST(factorial(CAST(n_A_leads + n_B_leads - i AS INTEGER)) AS DOUBLE)))
 FROM (SELECT unnest(range(greatest(n_A_leads, n_B_leads), n_A_leads + n_B_leads + 1)) AS i)) / power(2.0, n_A_leads + n_B_leads)), 6) END AS binom_p FROM cnt""")
def binom_leader(spark: SparkSession, sf: str) -> DataFrame:
    lead = synchrony.leaders(synchrony.windowed_peaks(synchrony.windowed(fx.pairs(spark, sf), WIDTH, STEP, LOW, HIGH)))
    return rounded(group.leader_counts(lead, ["dimension"]))


@query(f"""WITH {PEAK_SQL} SELECT dimension, count(*) FILTER (lag > 0) AS n_positive, count(*) FILTER (lag < 0) AS n_negative, count(*) FILTER (lag = 0) AS n_zero, round(avg(lag), 6) + 0.0 AS mean_lag, CAST(median(lag) AS DOUBLE) + 0.0 AS median_lag, round(stddev_samp(lag), 6) AS sd_lag FROM peak GROUP BY dimension""")
def lag_direction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.lag_direction(_peaks(spark, sf), "lag", ["dimension"]))


@query(f"""WITH {STATES_SQL}, g AS (SELECT dyad, person, state, count(*) AS n, avg(signal) AS m, coalesce(var_samp(signal), 0) AS v FROM states GROUP BY ALL),
p AS (SELECT a.dyad, a.person, a.state AS state_a, b.state AS state_b, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb FROM g a JOIN g b ON a.dyad = b.dyad AND a.person = b.person AND a.state < b.state),
r AS (SELECT p.*, s.state, rank() OVER (PARTITION BY p.dyad, p.person, state_a, state_b ORDER BY signal) + (count(*) OVER (PARTITION BY p.dyad, p.person, state_a, state_b, signal) - 1) / 2.0 AS k FROM p JOIN states s ON s.dyad = p.dyad AND s.person = p.person AND s.state IN (state_a, state_b))
SELECT dyad, person, state_a, state_b, CASE WHEN na >= 2 AND nb >= 2 THEN CAST(sum(k) FILTER (state = state_a) - na * (na + 1) / 2.0 AS DOUBLE) END AS u_stat, CASE WHEN na >= 2 AND nb >= 2 THEN round(coalesce((ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 0), 0), 5) END AS cohens_d FROM r GROUP BY dyad, person, state_a, state_b, na, nb, ma, mb, va, vb""")
def mannwhitney_u(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.mann_whitney(fx.states(spark, sf), "signal", "state", ["dyad", "person"]).drop("p_value", "p_fdr", "significant"), 5)


def _two_sided_sql(z: str) -> str:
    """Two-sided p of a normal z up to 12, by Simpson's rule."""
    return f"greatest(0.0, 1 - 2 / sqrt(2 * pi()) * {z} / 600 * list_sum(list_transform(range(0, 201), lambda k: (CASE WHEN k IN (0, 200) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * power({z} * k / 200, 2)))))"


MW_SQL = STATES_SQL + f""",
g AS (SELECT dyad, person, state, count(*) AS n FROM states GROUP BY ALL),
p AS (SELECT a.dyad, a.person, a.state AS state_a, b.state AS state_b, a.n AS na, b.n AS nb FROM g a JOIN g b ON a.dyad = b.dyad AND a.person = b.person AND a.state < b.state),
r AS (SELECT p.*, s.state, rank() OVER w + (count(*) OVER (PARTITION BY p.dyad, p.person, state_a, state_b, signal) - 1) / 2.0 AS k, power(count(*) OVER (PARTITION BY p.dyad, p.person, state_a, state_b, signal), 2) - 1 AS tied
  FROM p JOIN states s ON s.dyad = p.dyad AND s.person = p.person AND s.state IN (state_a, state_b) WINDOW w AS (PARTITION BY p.dyad, p.person, state_a, state_b ORDER BY signal)),
u AS (SELECT dyad, person, state_a, state_b, na, nb, sum(k) FILTER (state = state_a) - na * (na + 1) / 2.0 AS u, sum(tied) AS tied FROM r GROUP BY dyad, person, state_a, state_b, na, nb),
z AS (SELECT *, least(12.0, greatest(abs(u - na * nb / 2.0) - 0.5, 0.0) / nullif(sqrt(na * nb / 12.0 * (na + nb + 1 - tied / ((na + nb) * (na + nb - 1.0)))), 0)) AS z FROM u)"""


@query(f"""WITH {MW_SQL}, t AS (SELECT dyad, person, state_a, state_b, CASE WHEN na >= 2 AND nb >= 2 THEN {_two_sided_sql("z")} END AS p FROM z),
f AS (SELECT *, p * count(p) OVER (PARTITION BY dyad, person) / row_number() OVER (PARTITION BY dyad, person ORDER BY p NULLS LAST) AS x FROM t),
q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(x) OVER (PARTITION BY dyad, person ORDER BY p DESC NULLS LAST RANGE UNBOUNDED PRECEDING)) END AS p_fdr FROM f WHERE p IS NOT NULL)
SELECT t.dyad, t.person, t.state_a, t.state_b, round(t.p, 6) AS p_value, round(q.p_fdr, 6) AS p_fdr FROM t LEFT JOIN q USING (dyad, person, state_a, state_b)""")
def mannwhitney_p(spark: SparkSession, sf: str) -> DataFrame:
    """p by the normal and p_fdr over an entity's comparisons."""
    t = group.mann_whitney(fx.states(spark, sf), "signal", "state", ["dyad", "person"], small=False)
    return rounded(t.select("dyad", "person", "state_a", "state_b", "p_value", "p_fdr"))


SUBSETS_SQL = """bits AS (SELECT n, m, list_filter(range(1, n + 1), lambda i: (m >> (i - 1)) & 1 = 1) AS s FROM (SELECT n, unnest(range(0, CAST(1 << n AS BIGINT))) AS m FROM (SELECT unnest(range(1, 13)) AS n)))"""


@query(f"""WITH {SUBSETS_SQL}, sums AS (SELECT n, coalesce(list_sum(s), 0) AS w FROM bits),
o AS (SELECT o_custkey, o_totalprice - 150000 AS d FROM orders), k AS (SELECT o_custkey, d, rank() OVER (PARTITION BY o_custkey ORDER BY abs(d)) AS k, count(*) OVER (PARTITION BY o_custkey, abs(d)) AS c FROM o WHERE d <> 0),
t AS (SELECT o_custkey, count(*) AS n, least(coalesce(sum(k) FILTER (d > 0), 0), coalesce(sum(k) FILTER (d < 0), 0)) AS w, max(c) AS c FROM k GROUP BY o_custkey),
p AS (SELECT o_custkey, least(1.0, 2.0 * count(*) FILTER (sums.w <= t.w) / count(*)) AS p FROM t JOIN sums USING (n) WHERE c = 1 GROUP BY o_custkey)
SELECT t.o_custkey, t.n, CAST(t.w AS DOUBLE) AS wilcoxon_W, round(CAST(p AS DOUBLE), 9) AS p_exact FROM t LEFT JOIN p USING (o_custkey)""")
def wilcoxon_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against 150,000 by customer; shown are the exact p of up to 12 orders, for which SQL can try all signs."""
    d = fx.table(spark, sf, "orders").select("o_custkey", (F.col("o_totalprice") - 150000).alias("d"))
    ties = d.groupBy("o_custkey", F.abs("d").alias("d")).count().groupBy("o_custkey").agg(F.max("count").alias("c"))
    w = group.signed_rank(d, "d", ["o_custkey"]).join(ties, "o_custkey")
    return rounded(w.select("o_custkey", "n", "wilcoxon_W", F.when((F.col("n") <= 12) & (F.col("c") == 1), F.col("p_wilcoxon")).alias("p_exact")), 9)


@query(f"""WITH {SUBSETS_SQL}, sums AS (SELECT n, len(s) AS a, coalesce(list_sum(s), 0) - len(s) * (len(s) + 1) // 2 AS u FROM bits WHERE len(s) > 0 AND len(s) < n),
o AS (SELECT o_custkey, o_orderkey % 2 AS g, o_totalprice AS v FROM orders), k AS (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY v) AS k, count(*) OVER (PARTITION BY o_custkey, v) AS c FROM o),
t AS (SELECT o_custkey, count(*) FILTER (g = 0) AS a, count(*) AS n, sum(k) FILTER (g = 0) - count(*) FILTER (g = 0) * (count(*) FILTER (g = 0) + 1) // 2 AS u, max(c) AS c FROM k GROUP BY o_custkey HAVING count(DISTINCT g) = 2),
p AS (SELECT o_custkey, least(1.0, 2.0 * count(*) FILTER (sums.u <= least(t.u, t.a * (t.n - t.a) - t.u)) / count(*)) AS p FROM t JOIN sums ON sums.n = t.n AND sums.a = t.a WHERE c = 1 GROUP BY o_custkey)
SELECT t.o_custkey, CASE WHEN c = 1 THEN CAST(t.u AS DOUBLE) END AS u_stat, round(CAST(p AS DOUBLE), 9) AS p_exact FROM t LEFT JOIN p USING (o_custkey)""")
def mannwhitney_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with even against odd keys by customer; shown are the exact p of up to 12 orders."""
    o = fx.table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 2).alias("g"), F.col("o_totalprice").alias("v"))
    sizes = o.groupBy("o_custkey", "v").count().groupBy("o_custkey").agg(F.sum("count").alias("n"), F.max("count").alias("c"))
    t = group.mann_whitney(o, "v", "g", ["o_custkey"], min_n=1).join(sizes, "o_custkey")
    plain = F.col("c") == 1
    return rounded(t.select("o_custkey", F.when(plain, F.col("u_stat")).alias("u_stat"), F.when(plain & (F.col("n") <= 12), F.col("p_value")).alias("p_exact")), 9)


@query(f"""WITH x AS (SELECT c_mktsegment, c_acctbal, coalesce(t, 0) AS t FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY ALL) ON c_custkey = o_custkey),
r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY c_mktsegment ORDER BY round(t, 2)) + (count(*) OVER (PARTITION BY c_mktsegment, round(t, 2)) - 1) / 2.0 AS ry FROM x)
SELECT c_mktsegment, n, round(rho, 6) AS rho, round({fx.r_p_sql("rho", "n")}, 6) AS p_value FROM (SELECT c_mktsegment, count(*) AS n, corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) AS rho FROM r GROUP BY c_mktsegment HAVING count(*) >= 4)""")
def spearman_moderators(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    c = fx.table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("t", F.round(F.coalesce("t", F.lit(0.0)), 2))
    return rounded(group.spearman(c, "c_acctbal", "t", ["c_mktsegment"]))


@query(f"""WITH {STATES_SQL}, s AS (SELECT dyad, person, state, count(*) AS n, avg(signal) AS m, coalesce(stddev_samp(signal), 0) AS sd FROM states GROUP BY ALL),
g AS (SELECT *, sum(n * m) OVER (PARTITION BY dyad, person) / sum(n) OVER (PARTITION BY dyad, person) AS gm FROM s)
SELECT dyad, person, count(*) AS n_states, round(sum(n * power(m - gm, 2)) / (sum(n * power(m - gm, 2)) + sum((n - 1) * sd * sd)), 6) AS eta_squared FROM g GROUP BY dyad, person HAVING count(*) >= 2""")
def eta_squared(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.eta_squared(states.signal_summary(fx.states(spark, sf), "signal"), ["dyad", "person"]))


@query(f"""WITH {STATES_SQL}, s AS (SELECT dyad, person, state, count(*) AS n, avg(signal) AS m, coalesce(stddev_samp(signal), 0) AS sd FROM states GROUP BY ALL),
g AS (SELECT *, sum(n * m) OVER (PARTITION BY dyad, person) / sum(n) OVER (PARTITION BY dyad, person) AS gm FROM s),
e AS (SELECT dyad, person, sum(n * power(m - gm, 2)) / (sum(n * power(m - gm, 2)) + sum((n - 1) * sd * sd)) AS eta FROM g GROUP BY dyad, person HAVING count(*) >= 2)
SELECT person, count(*) AS n, round(avg(eta), 6) AS mean, round(stddev_samp(eta), 6) AS sd, round(avg(eta) / (stddev_samp(eta) / sqrt(count(*))), 4) AS t_stat FROM e GROUP BY person""")
def eta_group_test(spark: SparkSession, sf: str) -> DataFrame:
    e = group.eta_squared(states.signal_summary(fx.states(spark, sf), "signal"), ["dyad", "person"])
    t = group.one_sample(e, "eta_squared", ["person"])
    return t.select("person", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("t_stat", 4).alias("t_stat"))


def _loadings(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding dimensions as features: their mean by label as a component's loadings."""
    e = fx.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy(F.col("label").alias("component"), F.concat(F.lit("GMP_world_x_"), F.col("i")).alias("feature")).agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("loading"))


LOADINGS_SQL = """loadings AS (SELECT label AS component, 'GMP_world_x_' || (i - 1) AS feature, round(avg(CAST(x AS DOUBLE)), 9) AS loading FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS k FROM loadings) WHERE k <= 5)"""


@query(f"WITH {LOADINGS_SQL} SELECT component, feature, round(loading, 6) AS loading FROM top")
def top_loadings(spark: SparkSession, sf: str) -> DataFrame:
    l = _loadings(spark, sf)
    return rounded(group.votes(l.select("component").distinct(), l, ["component"]).select("component", "feature", "loading"))


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    l = _loadings(spark, sf)
    sig = l.select("component").distinct().withColumn("subject", F.col("component") % 4).withColumn("method", F.when(F.col("component") % 2 == 0, "pca").otherwise("fa"))
    return group.votes(sig, l, ["component"])


VOTES_SQL = LOADINGS_SQL + ", votes AS (SELECT *, component % 4 AS subject, CASE WHEN component % 2 = 0 THEN 'pca' ELSE 'fa' END AS method, abs(loading) AS abs_loading FROM top)"


@query(f"""WITH {VOTES_SQL} SELECT feature, count(*) AS n_votes, count(DISTINCT subject) AS n_unique_subjects, round(avg(abs_loading), 6) AS mean_abs_loading, string_agg(DISTINCT method, ',' ORDER BY method) AS methods_where_significant, round(count(*) / 4.0, 6) AS vote_proportion, 'movement' AS modality FROM votes GROUP BY feature""")
def vote_counting(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.vote_summary(_votes(spark, sf), "subject", 4))


@query(f"WITH {VOTES_SQL} SELECT feature, method, count(*) AS n_votes, round(avg(abs_loading), 6) AS mean_abs_loading FROM votes GROUP BY ALL")
def votes_by_method(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group.votes_by_method(_votes(spark, sf), "subject"))


OVERLAP_SQL = VOTES_SQL + ", l AS (SELECT feature, count(*) AS n FROM votes WHERE method = 'pca' GROUP BY ALL), r AS (SELECT feature, count(*) AS n FROM votes WHERE method = 'fa' GROUP BY ALL)"


@query(f"WITH {OVERLAP_SQL} SELECT feature, l.n AS votes_left, r.n AS votes_right, l.n + r.n AS total_votes FROM l JOIN r USING (feature)")
def vote_overlap(spark: SparkSession, sf: str) -> DataFrame:
    v = group.votes_by_method(_votes(spark, sf), "subject")
    return group.overlap(v.where("method = 'pca'"), v.where("method = 'fa'"))


@query(f"WITH {OVERLAP_SQL} SELECT feature FROM l WHERE feature NOT IN (SELECT feature FROM r)")
def vote_only_left(spark: SparkSession, sf: str) -> DataFrame:
    v = group.votes_by_method(_votes(spark, sf), "subject")
    return group.only_in(v.where("method = 'pca'"), v.where("method = 'fa'"))


@query("""SELECT p.dyad, round((coalesce(a.c_acctbal, b.c_acctbal) + coalesce(b.c_acctbal, a.c_acctbal)) / 2, 6) AS c_acctbal FROM (SELECT DISTINCT CAST((user_id % 20) // 2 AS BIGINT) AS dyad FROM events) p
LEFT JOIN customer a ON a.c_custkey = p.dyad * 2 LEFT JOIN customer b ON b.c_custkey = p.dyad * 2 + 1""")
def dyad_covariates(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.events(spark, sf).select("dyad").distinct().withColumn("sub_a", F.col("dyad") * 2).withColumn("sub_b", F.col("dyad") * 2 + 1)
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), "c_acctbal")
    return rounded(group.joined_scores(p, c, "c_acctbal").select("dyad", "c_acctbal"))


@query(f"""WITH {PEAK_SQL} SELECT dyad, dimension, CAST(lag AS INTEGER) AS lag, round(correlation, 6) AS correlation, round({fx.r_p_sql("correlation", "n")}, 6) AS p FROM peak WHERE abs(correlation) > 0.15 AND {fx.r_p_sql("correlation", "n")} < 0.05""")
def significant_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_peaks(spark, sf).where((F.abs("correlation") > 0.15) & (F.col("p") < 0.05)).select("dyad", "dimension", "lag", "correlation", "p"))


@query(f"""WITH {PEAK_SQL} SELECT dyad, dimension, round(correlation, 6) AS correlation, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dyad ORDER BY abs(correlation) DESC, dimension) AS rank FROM peak) WHERE rank <= 3""")
def top_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("dyad").orderBy(F.desc(F.abs("correlation")), "dimension"))
    return rounded(_peaks(spark, sf).withColumn("rank", k).where("rank <= 3").select("dyad", "dimension", "correlation", "rank"))


@query(f"""WITH {METHODS_SQL} SELECT dimension, count(DISTINCT dyad) AS n_dyads, round(avg(r), 6) AS mean_pearson, round(stddev_samp(r), 6) AS sd_pearson, round(avg(c), 6) AS mean_ccc, round(stddev_samp(c), 6) AS sd_ccc FROM ov GROUP BY dimension""")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = synchrony.overall(fx.pairs(spark, sf)).withColumnRenamed("pearson_pearson_r_overall", "pearson").withColumnRenamed("concordance_concordance_ccc_overall", "ccc")
    return rounded(group.metric_summary(o, ["pearson", "ccc"], ["dimension"], "dyad"))


@query(f"""WITH {STATES_SQL}, g AS (SELECT dyad, person, state, count(*) AS n, avg(signal) AS m, coalesce(stddev_samp(signal), 0) AS sd FROM states GROUP BY ALL),
w AS (SELECT *, sum(n * m) OVER (PARTITION BY dyad, person) / sum(n) OVER (PARTITION BY dyad, person) AS gm FROM g),
e AS (SELECT dyad, person, count(*) AS n_states, sum(n * power(m - gm, 2)) / (sum(n * power(m - gm, 2)) + sum((n - 1) * sd * sd)) AS eta FROM w GROUP BY dyad, person HAVING count(*) >= 2),
p AS (SELECT a.dyad, a.person, max(abs((a.m - b.m) / sqrt(((a.n - 1) * a.sd * a.sd + (b.n - 1) * b.sd * b.sd) / (a.n + b.n - 2)))) AS d, count(*) AS n_pairs FROM g a JOIN g b ON a.dyad = b.dyad AND a.person = b.person AND a.state < b.state GROUP BY ALL)
SELECT dyad, person, n_states, round(eta, 6) AS eta_squared, round(d, 5) AS max_cohens_d, n_pairs FROM e JOIN p USING (dyad, person)""")
def entity_effects(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.states(spark, sf)
    e = group.entity_effects(states.signal_summary(s, "signal"), group.mann_whitney(s, "signal", "state", ["dyad", "person"]), ["dyad", "person"])
    return e.select("dyad", "person", "n_states", F.round("eta_squared", 6).alias("eta_squared"), F.round("max_cohens_d", 5).alias("max_cohens_d"), "n_pairs")


@query(f"""WITH {PEAK_SQL} SELECT p.dyad, p.dimension, round(correlation, 6) AS correlation, c_mktsegment FROM peak p JOIN customer ON c_custkey = p.dyad""")
def peaks_with_subjects(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("dyad"), "c_mktsegment")
    return rounded(_peaks(spark, sf).join(c, "dyad").select("dyad", "dimension", "correlation", "c_mktsegment"))
