"""Properties, textbook values and independent computations for operators on small data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadspark.functions import special
from dyadspark.operators import align, describe, frames, group, kernels, states, synchrony, text
from dyadspark.operators.multiple import benjamini_hochberg
from dyadspark.sources import catalog, readers, writers


def pair(spark, a, b, name="x"):
    return spark.createDataFrame([(1, name, i, i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b, strict=True))], "dyad long, dimension string, pos long, bin long, a double, b double")


@pytest.mark.parametrize(("got", "want"), [
    (special.t_two_sided(2.2281, 10), 0.05), (special.chi2_sf(3.8415, 1), 0.05), (special.f_sf(4.1028, 2, 10), 0.05), (special.normal_two_sided(1.959964), 0.05), (special.chi2_sf(18.307, 10), 0.05),
])
def test_distributions(got, want):
    assert float(got) == pytest.approx(want, abs=2e-5)


def test_planted_lag(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=80)
    p = pair(spark, a, np.concatenate([rng.normal(size=2), a[:-2]]))
    top = synchrony.peaks(synchrony.lagged_correlation(p, -4, 4, 0.5), ["dyad", "dimension"]).first()
    assert top["lag"] == 2
    assert top["lag_seconds"] == 1.0
    assert top["correlation"] > 0.99
    w = synchrony.windowed_peaks(synchrony.windowed(p, 30, 10, -4, 4))
    assert synchrony.leaders(w).first()["leader"] == "A"


def test_correlation_without_variance_is_null(spark):
    p = pair(spark, [1] * 10, range(10))
    assert synchrony.overall(p).first()["pearson_pearson_r_overall"] is None
    assert all(r["correlation"] is None for r in synchrony.lagged_correlation(p, -1, 1, 1.0).collect())


@pytest.mark.parametrize(("n", "w", "s"), [(57, 20, 7), (10, 28, 4), (28, 28, 4), (60, 20, 10), (1, 3, 2)])
def test_windows(spark, n, w, s):
    full = [(i, i + w) for i in range(0, n - w + 1, s)]
    nxt = len(full) * s
    want = full + ([(nxt, n)] if nxt < n else [])
    got = align.sliding(pair(spark, range(n), range(n)), ["dyad", "dimension"], w, s).select("start", "stop").distinct().collect()
    assert sorted((r["start"], r["stop"]) for r in got) == want


def test_recurrence_matches_matrix(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=40).cumsum(), rng.normal(size=40).cumsum()
    r = synchrony.recurrence(pair(spark, a, b)).first()
    d = np.round(np.abs(a[:, None] - b), 9)
    m = d <= np.percentile(d, 10) + 1e-10

    def runs(lines):
        out = []
        for x in lines:
            n = 0
            for v in [*x, False]:
                if v:
                    n += 1
                elif n:
                    out.append(n)
                    n = 0
        return out

    diag, vert = runs(np.diag(m, k) for k in range(-39, 40)), runs(m.T)
    long = [x for x in diag if x >= 2]
    assert r["rqa_rqa_RR"] == pytest.approx(m.mean())
    assert r["rqa_rqa_DET"] == pytest.approx(sum(long) / sum(diag))
    assert r["rqa_rqa_Lmax"] == max(long)
    assert r["rqa_rqa_LAM"] == pytest.approx(sum(x for x in vert if x >= 2) / sum(vert))


def test_detrended_matches_polyfit(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=120), rng.normal(size=120)
    got = synchrony.detrended(pair(spark, a, b)).first()
    ya, yb = (a - a.mean()).cumsum(), (b - b.mean()).cumsum()
    scales = np.unique((np.logspace(1, np.log10(30), 15) + 1e-9).astype(int))
    f, rho = [], []
    for s in scales:
        xy, xx, yy = [], [], []
        for k in range(120 // s):
            t, p, q = np.arange(s), ya[k * s : (k + 1) * s], yb[k * s : (k + 1) * s]
            dp, dq = p - np.polyval(np.polyfit(t, p, 1), t), q - np.polyval(np.polyfit(t, q, 1), t)
            xy.append((dp * dq).mean())
            xx.append((dp * dp).mean())
            yy.append((dq * dq).mean())
        f.append(np.sqrt(abs(np.mean(xy))))
        rho.append(f[-1] ** 2 / (np.sqrt(np.mean(xx)) * np.sqrt(np.mean(yy)) + 1e-12))
    assert got["dfa_exponent"] == pytest.approx(np.polyfit(np.log(scales), np.log(np.array(f) + 1e-12), 1)[0], abs=1e-6)
    assert got["dfa_mean_rho"] == pytest.approx(np.mean(rho), abs=1e-6)


def test_oscillator_matches_lstsq(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=50), rng.normal(size=50)
    got = synchrony.coupled_oscillator(pair(spark, a, b)).first()
    want, *_ = np.linalg.lstsq(np.column_stack([a[:-1], b[:-1], np.ones(49)]), np.diff(a), rcond=None)
    assert (got["damping_A"], got["coupling_AtoB"]) == pytest.approx(tuple(want[:2]))


def test_false_discovery(spark):
    p = [0.01, 0.01, 0.02, 0.4, 0.04, None]
    got = {i: r["p_fdr"] for i, r in enumerate(benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").orderBy("i").collect())}
    x = np.array([v for v in p if v is not None])
    order = np.argsort(x)
    adj = np.minimum.accumulate((x[order] * len(x) / np.arange(1, len(x) + 1))[::-1])[::-1]
    want = np.empty(len(x))
    want[order] = np.minimum(adj, 1)
    assert [got[i] for i in range(5)] == pytest.approx(want.tolist())
    assert got[5] is None


def test_fill_and_filter(spark):
    rows = [("A", 1, "f", b, v) for b, v in enumerate([None, 1.0, None, 2.0, None])] + [("A", 1, "c", b, 5.0) for b in range(5)]
    s = spark.createDataFrame(rows, "person string, dyad int, feature string, bin long, value double")
    assert [r["value"] for r in align.filled(s).where("feature = 'f'").orderBy("bin").collect()] == [1, 1, 1, 2, 2]
    assert {r["feature"] for r in align.time_varying(s, 0.7).collect()} == {"f"}
    assert align.time_varying(s, 0.5).count() == 0


def test_interpolation_holds_ends(spark):
    p = spark.createDataFrame([(1, 1.0, 10.0), (1, 3.0, 30.0), (1, 2.0, None)], "g int, x double, y double")
    grid = spark.createDataFrame([(1, float(x)) for x in range(6)], "g int, x double")
    got = [r["y"] for r in align.interpolated(p, grid, ["g"], "x", "y").orderBy("x").collect()]
    assert got == np.interp(range(6), [1, 3], [10, 30]).tolist()


def test_sampling(spark):
    r = spark.createDataFrame([(1, 100)], "r int, n int")
    assert sorted(x["frame_idx"] for x in align.spread_frames(r, ["r"], "n", 7).collect()) == np.linspace(0, 99, 7, dtype=int).tolist()
    assert [x["segment"] for x in align.segments_of(spark.range(10).withColumn("g", F.lit(1)), ["g"], "id", 3).orderBy("id").collect()] == [k for k, v in enumerate(np.array_split(range(10), 3)) for _ in v]


def test_min_duration():
    assert states.smoothed_runs([5, 1, 4], ["a", "b", "c"], 2) == ["a"] * 6 + ["c"] * 4
    assert states.smoothed_runs([1, 5, 1], ["a", "b", "c"], 2) == ["b"] * 7
    assert states.smoothed_runs([2, 1, 2], ["a", "b", "c"], 2) == ["a"] * 3 + ["c"] * 2
    assert states.smoothed_runs([1], ["a"], 9) == ["a"]


def test_transitions_and_runs(spark):
    s = spark.createDataFrame([(1, "A", i, i, x, float(x)) for i, x in enumerate([1, 1, 2, 2, 1, 3])], "dyad int, person string, pos long, bin long, state int, signal double")
    t = states.transitions(s)
    assert t.count() == 9
    sums = {r["state"]: r["s"] for r in t.groupBy("state").agg(F.sum("share").alias("s")).collect()}
    assert sums == {1: pytest.approx(1), 2: pytest.approx(1), 3: 0}
    assert [r["duration"] for r in states.durations(s, 2.0).orderBy("run").collect()] == [4, 4, 2, 2]
    assert group.eta_squared(states.signal_summary(s, "signal"), ["dyad"]).first()["eta_squared"] == pytest.approx(1)


def test_rank_tests(spark):
    d = spark.createDataFrame([(1, float(v)) for v in [1, -2, 3, 4, -5, 6, 7, 8]], "g int, v double")
    assert group.signed_rank(d, "v", ["g"]).first()["wilcoxon_W"] == 7
    two = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (0, 1, 3.0), (0, 2, 4.0), (0, 2, 5.0)], "k int, g int, v double")
    r = group.mann_whitney(two, "v", "g", ["k"]).first()
    assert r["u_stat"] == 0
    assert r["p_value"] == pytest.approx(2 / 10)  # one of the ten ways to choose two of five
    assert 0 < group.mann_whitney(two, "v", "g", ["k"], small=False).first()["p_value"] < 0.2
    f = spark.createDataFrame([(0, b, t, float(t * 10 + b)) for b in range(4) for t in range(3)], "k int, b int, t int, v double")
    assert group.friedman(f, "v", "b", "t", ["k"]).first()["chi2"] == pytest.approx(8.0)
    lead = spark.createDataFrame([(0, x) for x in "AAAAAAAAB"], "d int, leader string")
    assert group.leader_counts(lead, ["d"]).first()["binom_p"] == pytest.approx(2 * (9 + 1) / 2**9)
    assert group.one_sample(d, "v", ["g"]).first()["t_stat"] == pytest.approx(2.75 / (np.std([1, -2, 3, 4, -5, 6, 7, 8], ddof=1) / math.sqrt(8)))


def test_kernels_against_numpy():
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    y = np.concatenate([[0.0], 0.9 * x[:-1]]) + 0.1 * rng.normal(size=200)
    assert kernels.granger_f(y, x, 1)[1] < 1e-6 < kernels.granger_f(x, y, 1)[1]
    m = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    c, share = kernels.pca(m, 4)
    assert np.allclose(c @ c.T, np.eye(4))
    assert share.sum() == pytest.approx(1)
    wa, wb, r = kernels.cca_weights(m - m.mean(0), (m @ rng.normal(size=(4, 4))) - (m @ rng.normal(size=(4, 4))).mean(0) * 0, 1)
    assert r[0] <= 1 + 1e-9
    steps = np.concatenate([np.zeros((30, 1)), np.full((30, 1), 5.0)]) + 0.01 * rng.normal(size=(60, 1))
    assert 30 in kernels.change_points(steps)
    ll, path, post = kernels.fit_hmm(steps, 2, 0)
    assert len(set(path[:30])) == len(set(path[30:])) == 1
    assert path[0] != path[-1]
    assert np.allclose(post.sum(1), 1)
    assert kernels.silhouette(steps, kernels.kmeans(steps, 2)) > 0.9
    assert kernels.adf_statistic(rng.normal(size=300), 3)[0] < -3.5 < kernels.adf_statistic(rng.normal(size=300).cumsum(), 3)[0]
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0]], float)
    assert kernels.ward(d, 2).tolist() == [1, 1, 2, 2]
    f, pa, pb, ab = kernels.welch(x, np.roll(x, 3), 1.0)
    assert (abs(ab) ** 2 / (pa * pb)).max() <= 1 + 1e-9


def test_text_rules(spark):
    d = spark.createDataFrame([("It is. Is it not so? Yes!", "the cat sat")], "a string, b string")
    r = d.select(text.sentences_kept(F.col("a")).alias("k"), text.sentences_bare(F.col("a")).alias("b"), text.negated(F.col("a")).alias("n"), text.perturbations(F.col("b"))["rotated"].alias("r"), text.perturbations(F.col("b"))["negated"].alias("v"), text.consecutive(text.sentences_kept(F.col("a"))).alias("c"), F.size(text.hashed_embedding(F.col("a"))).alias("h"), text.sequence_ratio(F.col("b"), F.lit("the cat sat")).alias("q")).first()
    assert r["k"] == ["It is.", "Is it not so?", "Yes!"]
    assert r["b"] == ["It is", "Is it not so", "Yes"]
    assert r["n"]
    n = spark.createDataFrame([("It is not so, not at all",), ("I don't",), ("IS NOT A",)], "a string").select(text.perturbations(F.col("a"))["negated"].alias("n")).collect()
    assert [x["n"] for x in n] == ["It is so, not at all", "I do", "IS NOT A"]
    assert (r["r"], r["v"], r["h"], r["q"]) == ("cat sat the", "the cat sat not", 128, 1.0)
    assert [tuple(x) for x in r["c"]] == [("It is.", "Is it not so?"), ("Is it not so?", "Yes!")]


def test_sentiment_is_a_distribution(spark):
    r = spark.range(1).select(*text.logistic_sentiment(F.lit(0.9), F.lit(0.0), F.lit(0.1), F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"))).first()
    assert sum(r[:3]) == pytest.approx(1)
    assert r["arvs_dominant_sentiment"] == "negative"


def test_frames(spark):
    box = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 2.0), (1, 1, 1.0, 0.0, 2.0, 2.0), (1, 2, 9.0, 9.0, 2.0, 2.0)], "r int, f int, x double, y double, w double, h double")
    assert [r["matched"] for r in frames.matches_previous(box, ["r"], "f", ["x", "y", "w", "h"]).orderBy("f").collect()] == [False, True, False]
    lv = spark.range(1).select(frames.intensity_levels(F.lit(0.4)).alias("a")).first()["a"]
    assert lv == pytest.approx([0, 0.4, 0.6, 0])
    dense = frames.densified_frames(spark.createDataFrame([(1, 1, 5.0)], "r int, f int, v double"), spark.createDataFrame([(1, 3)], "r int, n int"), ["r"], "f", "n", ["v"])
    assert [r["v"] for r in dense.orderBy("f").collect()] == [0, 5, 0]


def test_descriptives_edges(spark):
    s = spark.createDataFrame([(1, "c", 2.0), (1, "c", 2.0), (1, "c", 2.0), (1, "n", float("nan")), (1, "n", None)], "s int, feature string, value double")
    r = {x["feature"]: x for x in describe.descriptives(s, ["s"]).collect()}
    assert r["c"]["is_constant"]
    assert r["c"]["skewness"] is None
    assert r["n"]["mean"] is None
    assert r["n"]["percent_nan"] == 100
    j = spark.range(1).select(describe.large_array_json(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda x: x.cast("double"))).alias("j")).first()["j"]
    assert '"shape":1500' in j
    assert j.count(",") < 200


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("# method: pca\n# note: a:b\nTimestamp,x\n2000,1.5\n3000,-100\n")
    assert {(r["key"], r["value"]) for r in readers.header_metadata(spark, path).collect()} == {("method", "pca"), ("note", "a:b")}
    s = readers.load_features(readers.scan(spark, path, comment=True).withColumn("subject", F.lit("s1")), ["subject"])
    assert [(r["t"], r["value"]) for r in s.orderBy("t").collect()] == [(2.0, 1.5), (3.0, None)]
    with pytest.raises(ValueError):
        readers.resolved_time(spark.range(1), [])
    out = str(tmp_path / "table")
    writers.save(spark.createDataFrame([(1, 0.123456)], "k int, v double"), out, ["k"], digits=2)
    writers.save(spark.createDataFrame([(1, 9.0)], "k int, v double"), out, ["k"])
    assert spark.read.parquet(out).first()["v"] == 0.12
    writers.save(spark.createDataFrame([(1, 9.0)], "k int, v double"), out, ["k"], overwrite=True)
    assert spark.read.parquet(out).first()["v"] == 9.0
    writers.save_csv(spark.range(3), str(tmp_path / "c"), {"method": "pca"})
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() >= 3
    assert readers.discovered(spark, str(tmp_path), "*.csv").count() >= 1
    assert group.valid_covariates(spark.createDataFrame([(1.0, "a", None), (2.0, "b", None)], "x double, y string, z double"), ["x", "y", "z", "w"]) == ["x"]


def test_extractors(spark):
    @catalog.extractor("twice", ("id",))
    def twice(df):
        return df.withColumn("twice", F.col("id") * 2)

    df, status = catalog.run_extractors(spark.range(2), ["twice", "unknown", "twice"], skip=())
    assert "twice" in df.columns
    assert [s[1] for s in status] == ["ok", "failed", "ok"]


def test_streams(spark, tmp_path):
    from dyadspark.streaming import live

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (2, 0, "a")], "conv long, turn long, role string").write.parquet(src)
    q = live.live_turns(spark.readStream.schema("conv long, turn long, role string").parquet(src), "conv", "role", "turn").writeStream.outputMode("update").format("memory").queryName("turns").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["conv"], r["turns"], r["changes"]) for r in spark.table("turns").collect()} == {(1, 3, 1), (2, 1, 0)}
    ev = str(tmp_path / "ev")
    spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:05", "2024-01-01 00:01:01"]), "k": ["x"] * 3, "v": [1.0, 3.0, 5.0]})).write.parquet(ev)
    q = live.live_bins(spark.readStream.schema("ts timestamp, k string, v double").parquet(ev), "ts", "1 minute", "10 seconds", ["k"], "v").writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["value"] for r in spark.table("bins").collect()) == [2.0, 5.0]


def test_top_features(spark):
    rng = np.random.default_rng(5)
    rows = [(e, c, f"f{k:02}", float(rng.normal())) for e in "ab" for c in ("PCA1", "PCA2") for k in range(40)]
    got = kernels.top_features(spark.createDataFrame(rows, "e string, component string, feature string, loading double"), ["e"]).collect()
    for e in "ab":
        best = {}
        for r in rows:
            if r[0] == e:
                best[r[2]] = max(best.get(r[2], 0), abs(r[3]))
        want = sorted(best, key=lambda f: (-best[f], f))[:30]
        own = [r for r in got if r["e"] == e]
        assert sorted({(r["rank"], r["feature"]) for r in own}) == list(enumerate(want, 1))
        assert {(r["component"], r["feature"], r["loading"]) for r in own} == {r[1:] for r in rows if r[0] == e and r[2] in want}


def test_wavelet_against_its_definition(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 40))
    got = kernels.wavelet(spark.createDataFrame(pd.DataFrame({"dyad": 1, "dimension": "x", "pos": range(40), "a": a, "b": b}))).orderBy("pos").toPandas()
    widths = np.arange(2, 10)  # up to but without n // 4

    def transform(x):
        out = np.zeros((len(widths), 40))
        for i, s in enumerate(widths):
            for t in range(40):
                u = (t - np.arange(40)) / s
                out[i, t] = (x * np.where(abs(u) <= 8, np.exp(-(u**2) / 2) * np.cos(5 * u), 0)).sum() / s**0.5
        return out

    def smooth(x):
        k = np.exp(-0.5 * (np.arange(-12, 13) / 3.0) ** 2)
        k /= k.sum()
        p = np.pad(x, 12, "symmetric")
        return np.array([[(p[i : i + 25, j : j + 25] * np.outer(k, k)).sum() for j in range(x.shape[1])] for i in range(x.shape[0])])

    wa, wb = transform(a), transform(b)
    c = smooth(abs(wa * wb)) ** 2 / (smooth(wa**2) * smooth(wb**2) + 1e-12)
    assert np.allclose(got.mean_coherence, c.mean(0))
    assert np.allclose(got.mean_phase_diff, np.where(wa * wb < 0, np.pi, 0).mean(0))


def test_dickey_fuller_probabilities():
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert kernels.adf_p(t) == pytest.approx(p, abs=0.002)
    assert kernels.adf_p(3.0) == 1 and kernels.adf_p(-20.0) == 0
    x = np.random.default_rng(1).normal(size=60).cumsum()
    t, lags = kernels.adf_statistic(x, 4)
    d = np.diff(x)
    m = np.column_stack([x[lags:-1], np.ones(len(d) - lags), *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
    beta = np.linalg.solve(m.T @ m, m.T @ d[lags:])
    e = d[lags:] - m @ beta
    assert t == pytest.approx(beta[0] / np.sqrt(e @ e / (len(e) - m.shape[1]) * np.linalg.inv(m.T @ m)[0, 0]))


def test_greedy_cuts_and_starts():
    rng = np.random.default_rng(2)
    steps = np.repeat([0.0, 5.0, -5.0], 20)[:, None] + 0.01 * rng.normal(size=(60, 1))
    assert kernels.binary_segments(steps, 2) == [20, 40, 60] == kernels.binary_segments(steps, 2, 5, 5)
    assert kernels.change_points(steps, 1.0, 2, 5) == [20, 40, 60]
    assert kernels.binary_segments(steps[:5], 9, 2)[-1] == 5 and len(kernels.binary_segments(steps[:5], 9, 2)) == 2
    label = kernels.kmeans(steps, 3)
    assert len({tuple(label[i : i + 20]) for i in (0, 20, 40)}) == 3
    d = np.sqrt(((steps[:, None] - steps) ** 2).sum(2))
    want = []
    for i in range(60):
        own = label == label[i]
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, label == j].mean() for j in set(label.tolist()) - {label[i]})
        want.append((b - a) / max(a, b))
    assert kernels.silhouette(steps, label) == pytest.approx(np.mean(want), abs=1e-6)


@pytest.mark.parametrize("covariance", ["full", "diag", "tied", "spherical"])
def test_hmm_covariances(covariance):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 2)) @ np.array([[1, 0.9], [0, 0.4]]), 6 + rng.normal(size=(60, 2))])
    ll, path, post = kernels.fit_hmm(x, 2, 0, covariance=covariance)
    assert len(set(path[:60])) == len(set(path[60:])) == 1 and path[0] != path[-1]
    assert np.allclose(post.sum(1), 1)
    mean = np.array([x[:60].mean(0), x[60:].mean(0)])
    cov = np.array([[[2.0, 0.3], [0.3, 1.0]], np.eye(2)])
    got = kernels._log_density(x, mean, cov)
    z = x - mean[0]
    assert np.allclose(got[:, 0], -0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov[0]), z) + np.log(np.linalg.det(2 * np.pi * cov[0]))))


def test_granger_by_window(spark):
    import pandas as pd

    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 50))
    got = kernels.granger_windows(spark.createDataFrame(pd.DataFrame({"dyad": 1, "dimension": "x", "pos": range(50), "a": a, "b": b})), 2, 20, 10).orderBy("window").toPandas()
    assert got.start.tolist() == [0, 10, 20, 30, 40]
    assert got.granger_F_AtoB[1] == pytest.approx(max(kernels.granger_f(b[10:30], a[10:30], k)[0] for k in (1, 2)))


def test_correlation_p(spark):
    import pandas as pd

    from dyadspark.operators import synchrony

    rng = np.random.default_rng(8)
    x = rng.normal(size=12)
    frame = pd.DataFrame({"dyad": 1, "dimension": "x", "pos": range(12), "a": x, "b": x + rng.normal(size=12)})
    row = synchrony.overall(spark.createDataFrame(frame)).first()
    r = np.corrcoef(frame.a, frame.b)[0, 1]
    grid = np.linspace(abs(r), 1, 200_001)
    area = np.trapezoid((1 - grid**2) ** 4, grid) / np.trapezoid((1 - np.linspace(0, 1, 200_001) ** 2) ** 4, np.linspace(0, 1, 200_001))
    assert row.pearson_pearson_p_overall == pytest.approx(area, abs=1e-6)


def test_methods_that_fail_leave_the_others(spark):
    from dyadspark.operators import results

    d = spark.range(3)
    plans, errors = results.planned({"good": lambda: d, "bad": lambda: results.dimensions(d, "none", [])}, ["good", "bad", "other"])
    assert list(plans) == ["good"] and plans["good"].count() == 3
    assert errors == {"bad": "ValueError: unknown method none", "other": "unknown method"}
    with pytest.raises(ValueError, match="groups"):
        results.dimensions(d, "grouped", [])


def test_nested_stacked_and_probed(spark):
    from dyadspark.operators import results

    d = spark.sql("SELECT 1 AS id, named_struct('a', 2, 'b', named_struct('c.d', 3)) AS s, array(1, 2) AS x, array(5) AS y")
    assert results.flattened(d.drop("x", "y")).first().asDict() == {"id": 1, "s_a": 2, "s_b_c.d": 3}
    assert [tuple(r) for r in results.per_frame(d, ["id"], ["x", "y"]).orderBy("frame").collect()] == [(1, 0, 1, 5), (1, 1, 2, None)]
    both = results.stacked({"p": spark.sql("SELECT 1 AS a"), "q": spark.sql("SELECT 2 AS b")}).orderBy("source").collect()
    assert [(r.source, r.a, r.b) for r in both] == [("p", 1, None), ("q", None, 2)]
    assert d.select(results.first_existing(d, ["none", "id"]).alias("v"), results.first_existing(d, ["none"]).alias("w")).first() == (1, None)


def test_scores_of_labels_and_correlations(spark):
    d = spark.sql("SELECT array(named_struct('label', 'NO', 'score', 0.9D), named_struct('label', ' Yes', 'score', 0.2D)) AS c")
    assert d.select(text.positive_score(F.col("c"), ["yes"]).alias("a"), text.positive_score(F.col("c"), ["maybe"]).alias("b")).first() == (0.2, 0.9)
    rows = spark.createDataFrame([("one", 1, 0.3, 1.0), ("alike", 1, 0.4, 2.0), ("alike", 2, 0.6, 2.0), ("flat", 1, 0.5, 1.0), ("flat", 2, 0.5, 2.0), ("down", 1, 1.0, 2.0), ("down", 2, 2.0, 1.0)], "k string, o int, p double, t double")
    got = {r.k: r.score for r in text.correlation_score(rows, ["k"], "p", "t", "o").collect()}
    assert got == {"one": 0.3, "alike": 0.4, "flat": 0.5, "down": pytest.approx(-1.0)}


def test_region_without_pixels_counts_zero(spark):
    p = spark.createDataFrame([(1, 0, 3.0, 4.0, True), (1, 0, 3.0, 4.0, True), (1, 1, 0.0, 0.0, False)], "rec int, frame int, u double, v double, f boolean")
    r = frames.region_flow(p, ["rec"], "frame", "u", "v", F.col("f"), 1.0).first()
    assert r.of_fg_dynamic_epe_st == 2.5 and r.of_fg_dynamic_r2_st == pytest.approx(0.5, abs=1e-5) and r.of_bg_static_epe_st == 0


def test_few_values_give_null_tests(spark):
    d = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (1, 1, 5.0)], "k int, s int, v double")
    r = group.mann_whitney(d, "v", "s", ["k"]).first()
    assert (r.u_stat, r.p_value, r.cohens_d, r.significant) == (None, None, None, False)


def test_words_of_long_turns_align_once_a_row(spark):
    """The step is one value a row: 20,000 words cut anew for each word would take hours."""
    rows = spark.createDataFrame([(0, " a  bb c "), (1, " "), (2, None), (3, "w " * 20_000)], "k int, t string")
    got = rows.select("k", text.uniform_alignment(F.col("t"), F.lit(10.0)).alias("w")).select("k", F.size("w").alias("n"), F.slice("w", 1, 3).alias("w"), F.try_element_at("w", F.lit(-1))["end"].alias("last"))
    got = {r.k: r for r in got.collect()}
    assert [tuple(x) for x in got[0].w] == [("a", 0.0, 3.333), ("bb", 3.333, 6.667), ("c", 6.667, 10.0)]
    assert got[1].w == [] and got[2].w is None
    assert (got[3].n, got[3].last) == (20_000, 5000.0)


def test_sentences_of_long_texts_are_cut_once_a_row(spark):
    rows = spark.createDataFrame([(0, "One. Two. Three. Four. " + "x" * 200), (1, "Some text. It ends."), (2, None), (3, "ab. " * 20_000)], "k int, t string")
    got = {r.k: r for r in rows.select("k", text.paragraphs(F.col("t")).alias("p"), text.consecutive(text.sentences_kept(F.col("t"))).alias("c")).collect()}
    assert got[0].p == ["One. Two. Three.", "Four. " + "x" * 200] and got[1].p == ["Some text. It ends."] and got[2].p is None
    assert [tuple(x) for x in got[1].c] == [("Some text.", "It ends.")]
    assert len(got[3].p) == 6667 and got[3].p[-1] == "ab. ab." and len(got[3].c) == 19_999


def test_correlation_score_sorts_distinct_pairs_only(spark):
    """Ranks with ties against pandas; the plan meets equal pairs as one row before any window."""
    rng = np.random.default_rng(3)
    made = pd.DataFrame({"k": rng.integers(0, 3, 4000), "o": rng.permutation(4000), "p": rng.integers(0, 11, 4000) / 100, "t": rng.integers(1, 51, 4000) * 1.0})
    out = text.correlation_score(spark.createDataFrame(made), ["k"], "p", "t", "o")
    for r in out.collect():
        g = made[made.k == r.k]
        a, b = g.p.corr(g.t), g.p.rank().corr(g.t.rank())
        assert (r.n, r.pearson, r.spearman, r.score) == (len(g), pytest.approx(a, abs=1e-12), pytest.approx(b, abs=1e-12), pytest.approx((a + b) / 2, abs=1e-12))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("Window") :]


def test_points_of_large_tables_are_dealt_by_rows(spark):
    from dyadspark.operators import framing

    rows = spark.range(4000).select((F.col("id") % 100).alias("rec"), "id")
    out = framing.numbered(rows, ["rec"], ["id"], "i", 100)
    assert out.rdd.getNumPartitions() == 40
    s = frames.smoothed_by_overlap(out.withColumn("x", F.col("id") * 1.0), ["rec"], "i", "x", 8, 4)
    assert s.count() == 4000 and s.rdd.getNumPartitions() == 40
