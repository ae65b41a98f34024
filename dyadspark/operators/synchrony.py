"""Coordination of pairs: lagged and windowed correlation and concordance, recurrence, detrended covariance, information flow,
coupled dynamics, peaks, leaders and surrogates; all as plans over pair (dyad, dimension, pos, bin, a, b)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadspark.functions.columns import leader, safe_ccc, safe_corr
from dyadspark.functions.special import r_p
from dyadspark.operators.align import sliding

KEY = ["dyad", "dimension"]
#: Permutations of a key that one task does at least; positions of a recurrence matrix's rows in one task.
PERMUTATIONS, CELLS = 100, 512


def lagged(pair: DataFrame, low: int, high: int, key: list[str] = KEY) -> DataFrame:
    """Rows (key, lag, pos, a, b) with a at pos and b at pos + lag: an equality join on the shifted position."""
    left = pair.select(*key, "pos", "a").withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("at", F.col("pos") + F.col("lag"))
    return left.join(pair.select(*key, F.col("pos").alias("at"), "b"), [*key, "at"])


def lagged_correlation(pair: DataFrame, low: int, high: int, bin_size: float, key: list[str] = KEY) -> DataFrame:
    """r of each lag, positive where a comes first, and its two-sided p; all lags of a series are there, null where r isn't defined."""
    out = lagged(pair, low, high, key).groupBy(*key, "lag").agg(safe_corr(F.col("a"), F.col("b")).alias("correlation"), F.count("a").alias("n"))
    return out.withColumn("p", r_p(F.col("correlation"), F.col("n"))).withColumn("lag_seconds", F.col("lag") * F.lit(float(bin_size)))


def peaks(correlation: DataFrame, within: list[str], r: str = "correlation", lag: str = "lag") -> DataFrame:
    """The row of greatest absolute r in each group, the earliest lag on ties; nulls are passed over."""
    w = Window.partitionBy(*within).orderBy(F.desc(F.abs(r)), lag)
    return correlation.where(F.col(r).isNotNull()).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def peak_matrix(peak: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    return peak.groupBy(row).pivot(column, columns).agg(F.first(value))


def windowed(pair: DataFrame, width: int, step: int, low: int, high: int, key: list[str] = KEY) -> DataFrame:
    """key, window, start, lag, r, ccc: both ends of a lagged pair lie in the window. One sweep serves all three methods."""
    moved = _within(sliding(pair, key, width, step), low, high, key)
    return moved.groupBy(*key, "window", "start", "lag").agg(safe_corr(F.col("a"), F.col("b")).alias("r"), safe_ccc(F.col("a"), F.col("b")).alias("ccc"))


def _within(rows: DataFrame, low: int, high: int, key: list[str]) -> DataFrame:
    """Lagged pairs inside windows, from a sorted frame of each window: no join, one shuffle by window."""
    w = Window.partitionBy(*key, "window").orderBy("pos")
    ahead = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead("b", k) if k >= 0 else F.lag("b", -k)).over(w).alias("b")) for k in range(low, high + 1)])
    return rows.withColumn("x", ahead).withColumn("x", F.explode("x")).select(*key, "window", "start", "a", "x.lag", "x.b")


def windowed_peaks(swept: DataFrame, key: list[str] = KEY, of: str = "r") -> DataFrame:
    """Peak value and lag of each window, the earliest lag on ties; null and lag 0 where no lag has a value."""
    top = F.max(F.when(F.col(of).isNotNull(), F.struct(F.abs(of).alias("size"), (-F.col("lag")).alias("early"), F.col(of).alias("value"))))
    out = swept.groupBy(*key, "window", "start").agg(top.alias("__top"))
    return out.select(*key, "window", "start", F.col("__top.value").alias("peak"), F.coalesce(-F.col("__top.early"), F.lit(0)).alias("peak_lag"))


def overall(pair: DataFrame, key: list[str] = KEY) -> DataFrame:
    out = pair.groupBy(*key).agg(safe_corr(F.col("a"), F.col("b")).alias("pearson_pearson_r_overall"), safe_ccc(F.col("a"), F.col("b")).alias("concordance_concordance_ccc_overall"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("__n"))
    return out.withColumn("pearson_pearson_p_overall", r_p(F.col("pearson_pearson_r_overall"), F.col("__n"))).drop("__n")


def leaders(windows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Leader by the median peak lag over windows, with the mean peak."""
    out = windows.groupBy(*key).agg(F.median("peak_lag").alias("peak_lag"), F.avg("peak").alias("effect_size"))
    return out.withColumn("leader", leader(F.col("peak_lag")))


def _distance_limit(a: np.ndarray, b: np.ndarray, share: float) -> float:
    """The quantile, linear between neighbours, of all |a_i - b_j| to nine digits, by counting how many lie under a bound."""
    b = np.sort(b)
    most = len(a) * len(b)
    place = share * (most - 1)
    low, high = 0.0, float(max(abs(a.max() - b[0]), abs(b[-1] - a.min())))

    def under(t: float) -> np.ndarray:
        return np.searchsorted(b, a + t, "right") - np.searchsorted(b, a - t, "left")

    def kth(k: int) -> float:
        """The k-th least, from 1: halving until few distances are left in between."""
        lo, hi = -1.0, high
        while hi - lo > 1e-12 * max(1.0, high) and under(hi).sum() - (under(lo).sum() if lo >= 0 else 0) > 4 * len(a):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if under(mid).sum() >= k else (mid, hi)
        base = int(under(lo).sum()) if lo >= 0 else 0
        inner_from, inner_to = (np.searchsorted(b, a - lo, "left"), np.searchsorted(b, a + lo, "right")) if lo >= 0 else (None, None)
        found = []
        for i, (p, q) in enumerate(zip(np.searchsorted(b, a - hi, "left"), np.searchsorted(b, a + hi, "right"), strict=True)):
            if lo < 0:
                found.append(np.abs(a[i] - b[p:q]))
            else:
                found += [np.abs(a[i] - b[p : min(q, inner_from[i])]), np.abs(a[i] - b[max(p, inner_to[i]) : q])]
        rest = np.sort(np.concatenate(found))
        return float(rest[min(max(k - 1 - base, 0), len(rest) - 1)])

    k = int(np.floor(place))
    first = round(kth(k + 1), 9)
    return first if k + 1 >= most or place == k else first + (place - k) * (round(kth(k + 2), 9) - first)


def _line_lengths(a: np.ndarray, b: np.ndarray, limit: float, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of diagonal and of vertical lines by length that begin in rows start .. start + size - 1 of the recurrence matrix."""
    n = len(b)
    hit = lambda i: np.round(np.abs(a[i] - b), 9) <= limit + 1e-10
    found: tuple[list, list] = ([], [])
    before = hit(start - 1) if start else np.zeros(n, bool)
    # lengths so far of lines that began here; 0: none, for one that began above isn't counted
    run = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for i in range(start, len(a) + 1):
        now = hit(i) if i < len(a) else np.zeros(n, bool)
        for k, (came, prior) in enumerate(((np.concatenate([[0], run[0][:-1]]), np.concatenate([[False], before[:-1]])), (run[1], before))):
            if k == 0:
                found[0].append(run[0][-1:])  # a diagonal that leaves the matrix
            grown = np.where(now & (came > 0), came + 1, 0)
            found[k].append(came[(came > 0) & ~now])
            run[k] = np.where(now & ~prior, 1, grown) if i < start + size else grown
        before = now
        if i >= start + size - 1 and not run[0].any() and not run[1].any():
            break
    return tuple(np.bincount(np.concatenate(f)[np.concatenate(f) > 0]) if len(f) else np.zeros(0, np.int64) for f in found)


def recurrence(pair: DataFrame, share: float = 0.1, shortest: int = 2, key: list[str] = KEY) -> DataFrame:
    """Cross recurrence: RR, DET, L, Lmax, ENTR, LAM, TT. Cells are the pairs of positions of one series; the distance at
    the given quantile is the threshold. Lines are runs along diagonals and columns.

    A series is one row with two arrays; a row for each CELLS rows of its matrix finds the lines that begin there. What moves
    is a count by length: no cell is a row. Positions without a or b are left out.
    """
    known = pair.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    one = known.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("x"))
    one = one.select(*key, F.transform("x", lambda x: x["a"].cast("double")).alias("a"), F.transform("x", lambda x: x["b"].cast("double")).alias("b"))

    @F.pandas_udf("double")
    def limit(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_distance_limit(np.asarray(x, float), np.asarray(y, float), share) for x, y in zip(a, b, strict=True)], dtype=float)

    @F.pandas_udf("array<array<bigint>>")
    def lengths(a: pd.Series, b: pd.Series, limit: pd.Series, start: pd.Series) -> pd.Series:
        rows = zip(a, b, limit, start, strict=True)
        return pd.Series([[h.tolist() for h in _line_lengths(np.asarray(x, float), np.asarray(y, float), t, int(s), CELLS)] for x, y, t, s in rows], dtype=object)

    n = F.size("a")
    limited = one.withColumn("limit", limit("a", "b")).withColumn("start", F.explode(F.sequence(F.lit(0), n - 1, F.lit(CELLS))))
    found = limited.repartition(*key, "start").select(*key, n.cast("long").alias("n"), lengths("a", "b", "limit", "start").alias("h"))
    counts = found.select(*key, "n", F.posexplode("h").alias("kind", "h")).select(*key, "n", "kind", F.posexplode("h").alias("len", "c")).where("c > 0")
    counts = counts.groupBy(*key, "n", "kind", "len").agg(F.sum("c").alias("c"))
    of = lambda kind, least, v: F.sum(F.when((F.col("kind") == kind) & (F.col("len") >= least), v))
    cells, c = F.col("len") * F.col("c"), F.col("c")
    sums = counts.groupBy(*key, "n").agg(
        of(0, 1, cells).alias("hits"), of(0, shortest, cells).alias("dl"), of(0, shortest, c).alias("dc"), F.max(F.when((F.col("kind") == 0) & (F.col("len") >= shortest), F.col("len"))).alias("most"),
        of(1, 1, cells).alias("vhits"), of(1, shortest, cells).alias("vl"), of(1, shortest, c).alias("vc"),
        F.collect_list(F.when((F.col("kind") == 0) & (F.col("len") >= shortest), c)).alias("cs"),
    )
    ratio = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    entropy = -F.aggregate("cs", F.lit(0.0), lambda s, x: s + x / F.col("dc") * F.ln(x / F.col("dc") + 1e-12))
    return sums.select(
        *key, (F.coalesce("hits", F.lit(0)) / (F.col("n") * F.col("n"))).alias("rqa_rqa_RR"), ratio("dl", "hits").alias("rqa_rqa_DET"), ratio("dl", "dc").alias("rqa_rqa_L"), F.coalesce("most", F.lit(0)).cast("double").alias("rqa_rqa_Lmax"),
        F.coalesce(entropy, F.lit(0.0)).alias("rqa_rqa_ENTR"), ratio("vl", "vhits").alias("rqa_rqa_LAM"), ratio("vl", "vc").alias("rqa_rqa_TT"),
    )


def detrended(pair: DataFrame, key: list[str] = KEY, n_scales: int = 15, least: int = 4) -> DataFrame:
    """Detrended cross-correlation: slope of ln F_xy over ln scale and mean rho; linear detrending of each box in closed form."""
    w = Window.partitionBy(*key).orderBy("pos")
    every = Window.partitionBy(*key)
    profile = pair.withColumn("n", F.count(F.lit(1)).over(every))
    for c in "ab":
        profile = profile.withColumn(f"m{c}", F.col(c) - F.avg(c).over(every)).withColumn(f"y{c}", F.sum(f"m{c}").over(w))
    top = F.log10(F.floor(F.col("n") / 4).cast("double"))
    scales = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n_scales - 1)), lambda i: F.floor(F.pow(F.lit(10.0), 1 + i * (top - 1) / (n_scales - 1)) + 1e-9).cast("int")))
    boxes = profile.where(F.floor(F.col("n") / 4) >= 10).withColumn("s", F.explode(F.filter(scales, lambda s: s >= least))).withColumn("box", F.floor(F.col("pos") / F.col("s")))
    t = F.col("pos").cast("double")
    moved = lambda x, y: F.covar_pop(x, y) - F.covar_pop(t, x) * F.covar_pop(t, y) / F.var_pop(t)
    ya, yb = F.col("ya"), F.col("yb")
    per_box = boxes.groupBy(*key, "s", "box").agg(F.count(F.lit(1)).alias("c"), moved(ya, yb).alias("xy"), moved(ya, ya).alias("xx"), moved(yb, yb).alias("yy")).where(F.col("c") == F.col("s"))
    scale = per_box.groupBy(*key, "s").agg(F.avg("xy").alias("f2"), F.avg("xx").alias("fx"), F.avg("yy").alias("fy"))
    root = lambda c: F.sqrt(F.abs(c))
    log = lambda c: F.ln(c.cast("double"))
    scale = scale.withColumn("rho", F.abs("f2") / (root(F.col("fx")) * root(F.col("fy")) + 1e-12))
    out = scale.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(log(root(F.col("f2")) + 1e-12), log(F.col("s"))).alias("dfa_exponent"), F.avg("rho").alias("dfa_mean_rho"))
    return out.where(F.col("n") >= 3).select(*key, "dfa_exponent", "dfa_mean_rho")


def transfer_entropy(pair: DataFrame, bins: int = 6, key: list[str] = KEY) -> DataFrame:
    """te_AtoB, te_BtoA, te_net in bits from equal-width bins and one step of memory; leader by the sign of net."""
    every = Window.partitionBy(*key)
    w = every.orderBy("pos")

    def binned(c: str):
        lo, hi = F.min(c).over(every) - 1e-10, F.max(c).over(every) + 1e-10
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / ((hi - lo) / bins))).cast("int")

    x = pair.withColumn("xa", binned("a")).withColumn("xb", binned("b"))
    x = x.withColumn("pa", F.lag("xa").over(w)).withColumn("pb", F.lag("xb").over(w)).where("pa IS NOT NULL")

    # joint counts once; the entropies are sums over their margins, all within the key's partition
    sets = {"b_bp": ["xb", "pb"], "bp": ["pb"], "b_bp_ap": ["xb", "pb", "pa"], "both": ["pb", "pa"], "a_ap": ["xa", "pa"], "ap": ["pa"], "a_ap_bp": ["xa", "pa", "pb"]}
    cells = x.groupBy(*key, "xa", "xb", "pa", "pb").agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy(*key)))
    margin = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), F.concat_ws(",", *v).alias("cell")) for k, v in sets.items()])).alias("m")
    margins = cells.select(*key, "c", "n", margin).groupBy(*key, "m.of", "m.cell").agg((F.sum("c") / F.max("n")).alias("p"))
    out = margins.groupBy(*key).agg(*[(-F.sum(F.when(F.col("of") == k, F.col("p") * F.log2(F.col("p") + 1e-12)))).alias(k) for k in sets])
    ab = F.col("b_bp") - F.col("bp") - F.col("b_bp_ap") + F.col("both")
    ba = F.col("a_ap") - F.col("ap") - F.col("a_ap_bp") + F.col("both")
    out = out.select(*key, ab.alias("te_AtoB"), ba.alias("te_BtoA")).withColumn("te_net", F.col("te_AtoB") - F.col("te_BtoA"))
    return out.withColumn("te_leader", leader(F.round("te_net", 12)))


def coupled_oscillator(pair: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Steps of a and b regressed on both levels; coupling_AtoB is b's coefficient in a's equation. Null where singular."""
    w = Window.partitionBy(*key).orderBy("pos")
    x = pair.withColumn("da", F.lead("a").over(w) - F.col("a")).withColumn("db", F.lead("b").over(w) - F.col("b")).where("da IS NOT NULL")
    c = lambda p, q: F.covar_pop(p, q).alias(f"{p}_{q}")
    s = x.groupBy(*key).agg(c("a", "a"), c("b", "b"), c("a", "b"), c("a", "da"), c("b", "da"), c("a", "db"), c("b", "db"))
    det = F.col("a_a") * F.col("b_b") - F.col("a_b") * F.col("a_b")
    over = lambda n: F.try_divide(n, F.when(F.abs(det) > 1e-12, det))
    out = s.select(
        *key,
        over(F.col("a_da") * F.col("b_b") - F.col("b_da") * F.col("a_b")).alias("damping_A"),
        over(F.col("b_da") * F.col("a_a") - F.col("a_da") * F.col("a_b")).alias("coupling_AtoB"),
        over(F.col("b_db") * F.col("a_a") - F.col("a_db") * F.col("a_b")).alias("damping_B"),
        over(F.col("a_db") * F.col("b_b") - F.col("b_db") * F.col("a_b")).alias("coupling_BtoA"),
    )
    return out.withColumn("coupling_leader", F.when(F.abs("coupling_AtoB") > F.abs("coupling_BtoA"), "A").otherwise("B"))


def surrogate_test(pair: DataFrame, permutations: int, block: int, seed: int = 0, key: list[str] = KEY) -> DataFrame:
    """Share of block-shuffled surrogates of b that reach the observed |r| and |CCC|, (exceed + 1) / (permutations + 1).

    A permutation takes b's blocks in the order of a seeded hash. Shuffling moves no mean and no variance, so a surrogate is one
    sum of products, of slices of two arrays inside one row: a row a key and permutation, none a position. Positions that lack
    a or b are left out; null where r or CCC isn't defined.
    """
    at = F.array_sort(F.collect_list(F.struct("pos", "a", "b")))
    known = pair.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    one = known.groupBy(*key).agg(at.alias("x"), *[f(c).alias(f"{n}{c}") for c in "ab" for n, f in (("m", F.avg), ("v", F.var_pop), ("lo", F.min), ("hi", F.max))])
    one = one.withColumns({"n": F.size("x"), "a": F.transform("x", lambda x: x["a"]), "b": F.transform("x", lambda x: x["b"])}).drop("x")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    one = one.withColumn("observed", dot("a", "b"))
    # the permutations of a key may run in several tasks
    some = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((permutations - 1) // PERMUTATIONS)))).repartition(*key, "part")
    last = F.least((F.col("part") + 1) * PERMUTATIONS, F.lit(permutations))
    each = some.withColumn("perm", F.explode(F.sequence(F.col("part") * PERMUTATIONS + 1, last)))
    name = lambda k: F.md5(F.concat_ws("/", F.lit(seed), "perm", *key, k))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1), lambda k: F.struct(name(k).alias("h"), k.alias("k"))))

    def step(done, x):
        start = x["k"] * block
        size = F.least(F.lit(block), F.col("n") - start)
        return F.struct((done["at"] + size).alias("at"), (done["sum"] + dot(F.slice("a", done["at"], size), F.slice("b", start + 1, size))).alias("sum"))

    total = F.aggregate(order, F.struct(F.lit(1).alias("at"), F.lit(0.0).alias("sum")), step)["sum"]
    cov = lambda s: s / F.col("n") - F.col("ma") * F.col("mb")
    fine = (F.col("n") >= 3) & (F.col("loa") < F.col("hia")) & (F.col("lob") < F.col("hib"))
    # both statistics are covariances over what a shuffle leaves as it is, so the same surrogates reach either
    reach = (F.count_if(F.abs(cov(F.col("sum"))) >= F.abs(cov(F.col("observed"))) - 1e-12) + 1) / F.lit(permutations + 1.0)
    kept = each.select(*key, "n", "ma", "mb", "loa", "hia", "lob", "hib", "observed", total.alias("sum"))
    out = kept.groupBy(*key).agg(F.when(F.first(fine), reach).alias("p_pearson"))
    return out.withColumn("p_concordance", F.col("p_pearson"))


def wide(windows: DataFrame, metrics: list[str], dimensions: list[str], index: list[str]) -> DataFrame:
    """metric_dimension columns of a long windowed table; the dimensions are given, so no job looks for them."""
    return windows.groupBy(*index).agg(*[F.max(F.when(F.col("dimension") == d, F.col(m))).alias(f"{m}_{d}") for m in metrics for d in dimensions])
