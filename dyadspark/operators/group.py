"""Group inference: one-sample and rank tests, effects, votes, moderators and comparisons of methods, all entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadspark.functions.columns import fisher_z, mid_rank, modality, safe_corr
from dyadspark.functions.special import binomial_two_sided, chi2_p, normal_p, r_p, t_p
from dyadspark.operators import exact
from dyadspark.operators.multiple import benjamini_hochberg


def one_sample(df: DataFrame, value: str, within: list[str], least: int = 2) -> DataFrame:
    """n, mean, sd, t_stat, p_value and Cohen's d against 0; groups smaller than `least` are left out."""
    out = df.where(F.col(value).isNotNull()).groupBy(*within).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    sd = F.when(F.col("lo") < F.col("hi"), F.col("sd"))
    t = F.try_divide(F.col("mean") * F.sqrt("n"), sd)
    out = out.where(F.col("n") >= least).withColumn("t_stat", t).withColumn("cohens_d", F.try_divide(F.col("mean"), sd))
    return out.withColumn("p_value", t_p(F.col("t_stat"), (F.col("n") - 1).cast("double"))).drop("lo", "hi")


def correlation_test(peaks: DataFrame, r: str, within: list[str]) -> DataFrame:
    """One-sample test of Fisher-transformed peaks, with mean_r back-transformed."""
    out = one_sample(peaks.withColumn("__z", fisher_z(F.col(r))), "__z", within)
    return out.withColumn("mean_r", F.tanh("mean"))


def signed_rank(df: DataFrame, value: str, within: list[str]) -> DataFrame:
    """Wilcoxon signed-rank: W (the lesser sum of mid-ranks), n without zeros, and p: exact up to 50 values without ties or zeros,
    else by the normal with tie correction."""
    zeros = df.where(F.col(value) == 0).groupBy(*within).agg(F.count(F.lit(1)).alias("zeros"))
    x = df.where(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn("__abs", F.abs(value))
    x = x.withColumn("rank", mid_rank(F.col("__abs"), within)).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(*within, "__abs")))
    out = x.groupBy(*within).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col(value) > 0, F.col("rank"))), F.lit(0.0)).alias("plus"), F.coalesce(F.sum(F.when(F.col(value) < 0, F.col("rank"))), F.lit(0.0)).alias("minus"), F.sum(F.pow("ties", 2) - 1).alias("tied"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    w = F.least("plus", "minus")
    out = out.join(zeros, within, "left")
    small = F.when((F.col("tied") == 0) & F.col("zeros").isNull(), exact.signed_rank_p(w, F.col("n")))
    return out.select(*within, "n", w.alias("wilcoxon_W"), F.coalesce(small, normal_p(F.try_divide(w - n * (n + 1) / 4, sd))).alias("p_wilcoxon"))


def paired_signed_rank(df: DataFrame, a: str, b: str, within: list[str]) -> DataFrame:
    """The signed-rank test of a - b; pairs that lack either are left out."""
    return signed_rank(df.withColumn("__d", F.col(a) - F.col(b)), "__d", within)


def mann_whitney(df: DataFrame, value: str, group: str, within: list[str], min_n: int = 2, small: bool = True) -> DataFrame:
    """U, p (exact without ties where one group has up to 8 values and the other up to 64, unless `small` is off; else normal, tie
    and continuity corrected), Cohen's d, p_fdr and significance for each two groups of an entity; null where a
    group has fewer than `min_n` values."""
    x = df.where(F.col(value).isNotNull())
    stats = x.groupBy(*within, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    side = lambda c: stats.select(*within, *[F.col(k).alias(f"{k}_{c}") for k in (group, "n", "m", "v")])
    two = side("a").join(side("b"), within).where(F.col(f"{group}_a") < F.col(f"{group}_b"))
    # values of both groups by pair: equality joins on the group
    rows = x.select(*within, F.col(group).alias("g"), F.col(value).alias("x"))
    both = two.withColumn("g", F.explode(F.array(f"{group}_a", f"{group}_b"))).join(rows, [*within, "g"])
    key = [*within, f"{group}_a", f"{group}_b"]
    both = both.withColumn("rank", mid_rank(F.col("x"), key)).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(*key, "x")))
    out = both.groupBy(*key, "n_a", "n_b", "m_a", "m_b", "v_a", "v_b").agg(F.sum(F.when(F.col("g") == F.col(f"{group}_a"), F.col("rank"))).alias("r"), F.sum(F.pow("ties", 2) - 1).alias("tied"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n, u = na + nb, F.col("r") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.try_divide(F.col("tied"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - na * nb / 2) - 0.5, F.lit(0.0)), sd)
    pooled = F.sqrt(F.try_divide((na - 1) * F.col("v_a") + (nb - 1) * F.col("v_b"), n - 2))
    d = F.coalesce(F.try_divide(F.col("m_a") - F.col("m_b"), pooled), F.lit(0.0))
    known = lambda c: F.when((na >= min_n) & (nb >= min_n), c)
    counted = F.when(F.lit(small) & (F.col("tied") == 0), exact.rank_sum_p(u, F.col("n_a"), F.col("n_b")))
    tests = out.select(*key, known(u).alias("u_stat"), F.coalesce(known(counted), normal_p(known(z))).alias("p_value"), known(d).alias("cohens_d"))
    return benjamini_hochberg(tests, "p_value", within).withColumn("significant", F.coalesce(F.col("p_fdr") < 0.05, F.lit(False)))


def friedman(df: DataFrame, value: str, block: str, treatment: str, within: list[str]) -> DataFrame:
    """Chi-square over blocks that have every treatment (three at least), mid-ranks and tie correction."""
    k = df.select(*within, treatment).distinct().groupBy(*within).agg(F.count(F.lit(1)).alias("__k"))
    x = df.where(F.col(value).isNotNull()).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*within, block))).join(k, within).where(F.col("__n") == F.col("__k"))
    x = x.withColumn("rank", mid_rank(F.col(value), [*within, block])).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(*within, block, value)))
    per = x.groupBy(*within, treatment).agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("n"), F.max("__k").alias("__k"), F.sum(F.pow("ties", 2) - 1).alias("tied"))
    out = per.groupBy(*within).agg(F.max("n").alias("n"), F.max("__k").alias("__k"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("tied").alias("tied")).where((F.col("__k") >= 3) & (F.col("n") >= 2))
    n, m = F.col("n").cast("double"), F.col("__k").cast("double")
    chi = F.try_divide(12 / (n * m * (m + 1)) * F.col("ss") - 3 * n * (m + 1), 1 - F.col("tied") / (n * m * (m * m - 1)))
    return out.select(*within, F.col("n").alias("n_blocks"), F.col("__k").alias("n_treatments"), chi.alias("chi2")).withColumn("p_value", chi2_p(F.col("chi2"), (F.col("n_treatments") - 1).cast("double")))


def leader_counts(leaders: DataFrame, within: list[str]) -> DataFrame:
    """How often A, B or neither leads, with a two-sided binomial p of the greater count."""
    out = leaders.groupBy(*within).agg(F.count_if(F.col("leader") == "A").alias("n_A_leads"), F.count_if(F.col("leader") == "B").alias("n_B_leads"), F.count_if(F.col("leader") == "sync").alias("n_sync"), F.count(F.lit(1)).alias("n_total"))
    n = (F.col("n_A_leads") + F.col("n_B_leads")).cast("int")
    return out.withColumn("binom_p", binomial_two_sided(F.greatest("n_A_leads", "n_B_leads").cast("int"), n))


def lag_direction(peaks: DataFrame, lag: str, within: list[str]) -> DataFrame:
    return peaks.groupBy(*within).agg(F.count_if(F.col(lag) > 0).alias("n_positive"), F.count_if(F.col(lag) < 0).alias("n_negative"), F.count_if(F.col(lag) == 0).alias("n_zero"), F.avg(lag).alias("mean_lag"), F.median(lag).alias("median_lag"), F.stddev_samp(lag).alias("sd_lag"))


def spearman(df: DataFrame, x: str, y: str, within: list[str], least: int = 4) -> DataFrame:
    """rho and p of mid-ranks; groups of fewer than `least` pairs are left out."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("__rx", mid_rank(F.col(x), within)).withColumn("__ry", mid_rank(F.col(y), within))
    out = d.groupBy(*within).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("__rx"), F.col("__ry")).alias("rho")).where(F.col("n") >= least)
    return out.withColumn("p_value", r_p(F.col("rho"), F.col("n")))


def eta_squared(summary: DataFrame, within: list[str]) -> DataFrame:
    """Between over total sum of squares from group n, mean, sd; two groups with rows at least, null without variation."""
    valid = summary.where((F.col("n_bins") > 0) & F.col("mean").isNotNull())
    w = Window.partitionBy(*within)
    grand = F.sum(F.col("n_bins") * F.col("mean")).over(w) / F.sum("n_bins").over(w)
    x = valid.withColumn("between", F.col("n_bins") * F.pow(F.col("mean") - grand, 2)).withColumn("inside", (F.col("n_bins") - 1) * F.pow("sd", 2))
    out = x.groupBy(*within).agg(F.count(F.lit(1)).alias("n_states"), F.sum("between").alias("b"), F.sum("inside").alias("i")).where(F.col("n_states") >= 2)
    return out.select(*within, "n_states", F.try_divide(F.col("b"), F.col("b") + F.col("i")).alias("eta_squared"))


def votes(significant: DataFrame, loadings: DataFrame, on: list[str], top: int = 5) -> DataFrame:
    """The `top` loadings of each significant component, one vote each."""
    w = Window.partitionBy(*on).orderBy(F.desc(F.abs("loading")), "feature")
    best = loadings.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= top).drop("__k")
    return significant.join(best, on).withColumn("abs_loading", F.abs("loading"))


def vote_summary(v: DataFrame, subject: str, n_subjects: int | None = None) -> DataFrame:
    out = v.groupBy("feature").agg(F.count(subject).alias("n_votes"), F.count_distinct(subject).alias("n_unique_subjects"), F.avg("abs_loading").alias("mean_abs_loading"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods_where_significant"))
    return out.withColumn("modality", modality(F.col("feature"))) if n_subjects is None else out.withColumn("vote_proportion", F.col("n_votes") / F.lit(max(n_subjects, 1))).withColumn("modality", modality(F.col("feature")))


def votes_by_method(v: DataFrame, subject: str) -> DataFrame:
    return v.groupBy("feature", "method").agg(F.count(subject).alias("n_votes"), F.avg("abs_loading").alias("mean_abs_loading"))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Features with votes in both tables, and their total."""
    l, r = left.select("feature", F.col("n_votes").alias("votes_left")), right.select("feature", F.col("n_votes").alias("votes_right"))
    return l.join(r, "feature").withColumn("total_votes", F.col("votes_left") + F.col("votes_right"))


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "feature", "left_anti").select("feature")


def ordered(df: DataFrame, by: list[str], within: list[str] | None = None, top: int | None = None) -> DataFrame:
    """df with rank from 1 in the order of `by` (falling where a name begins with '-'), within groups; the first `top` only, if
    asked. Nulls come last. Names that tell rows apart belong at the end of `by`."""
    order = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in by]
    if within:
        out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
        return out if top is None else out.where(F.col("rank") <= top)
    # a list for readers: without a top it is one table in one order, made for few rows
    out = df if top is None else df.orderBy(*order).limit(top)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def method_means(peaks: DataFrame, r: str, entity: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mean absolute r by entity and method, and over entities mean, sd and median by method."""
    per = peaks.groupBy(*entity, "method").agg(F.avg(F.abs(r)).alias("mean_abs_r"))
    return per, per.groupBy("method").agg(F.count(F.lit(1)).alias("n_obs"), F.avg("mean_abs_r").alias("mean_abs_r"), F.stddev_samp("mean_abs_r").alias("sd_abs_r"), F.median("mean_abs_r").alias("median_abs_r"))


def valid_covariates(subjects: DataFrame, columns: list[str], most_missing: float = 0.2) -> list[str]:
    """Of the given columns those that exist, are numeric and lack at most the share of values."""
    kinds = {f.name: f.dataType.typeName() for f in subjects.schema}
    numeric = [c for c in columns if kinds.get(c) in ("double", "float", "integer", "long", "short", "decimal", "byte")]
    if not numeric:
        return []
    row = subjects.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in numeric]).first()  # one row
    return [c for c in numeric if row[c] is not None and row[c] <= most_missing]


def joined_scores(pairs: DataFrame, subjects: DataFrame, score: str, subject: str = "subject") -> DataFrame:
    """The mean score of both members of a pair, of the one that is known where the other isn't."""
    one = lambda c: subjects.select(F.col(subject).alias(c), F.col(score).alias(f"{c}_score"))
    out = pairs.join(one("sub_a"), "sub_a", "left").join(one("sub_b"), "sub_b", "left")
    known = F.array_compact(F.array("sub_a_score", "sub_b_score"))
    return out.withColumn(score, F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known)))


def metric_summary(rows: DataFrame, metrics: list[str], within: list[str], entity: str) -> DataFrame:
    """Number of entities, and mean and sd of each metric."""
    return rows.groupBy(*within).agg(F.count_distinct(entity).alias("n_dyads"), *[x for m in metrics for x in (F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"sd_{m}"))])


def entity_effects(summary: DataFrame, tests: DataFrame, entity: list[str]) -> DataFrame:
    """eta squared, greatest |d|, and numbers of significant and of all pairs of states for each entity."""
    pairs = tests.groupBy(*entity).agg(F.max(F.abs("cohens_d")).alias("max_cohens_d"), F.count_if("significant").alias("n_sig_pairs"), F.count(F.lit(1)).alias("n_pairs"))
    return eta_squared(summary, entity).join(pairs, entity, "left")
