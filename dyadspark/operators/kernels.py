"""Algorithms that are iterative or sequential within one series, as numpy on Arrow-fed groups: one group is one series of one
entity, bounded by its recording's bins, and groups run in parallel. Each kernel has a fixed output schema."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadspark.functions.special import f_sf
from dyadspark.operators.states import hmm_parameters

KEY = ["dyad", "dimension"]


def _grouped(df: DataFrame, key: list[str], order: str, schema: str, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    kinds = {x.name: x.dataType.simpleString() for x in df.schema}
    names = [*key, *[c.split()[0] for c in schema.split(", ")]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values(order))
        for k in key:
            out[k] = pdf[k].iloc[0]
        return out[names]

    return df.groupBy(*key).applyInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in key] + [schema]))


# coupling


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def welch(a: np.ndarray, b: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, two spectra and the cross spectrum: Hann windows of min(256, n // 2) with half overlap, means removed."""
    n = min(256, len(a) // 2)
    w, at = hann(n), range(0, len(a) - n + 1, max(1, n - n // 2))
    fa = np.array([np.fft.rfft(w * (a[i : i + n] - a[i : i + n].mean())) for i in at])
    fb = np.array([np.fft.rfft(w * (b[i : i + n] - b[i : i + n].mean())) for i in at])
    return np.fft.rfftfreq(n, 1 / fs), (abs(fa) ** 2).mean(0), (abs(fb) ** 2).mean(0), (fa.conj() * fb).mean(0)


def coherence(pair: DataFrame, bin_size: float, key: list[str] = KEY) -> DataFrame:
    """Greatest squared coherence but for frequency 0, its frequency and phase, and the leader by the phase's sign."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        a, b = x.a.to_numpy(float), x.b.to_numpy(float)
        if len(a) < 8:
            return pd.DataFrame({"coherence_peak": [None], "coherence_freq": [None], "coherence_phase": [None], "coherence_leader": [None]})
        freq, pa, pb, ab = welch(a, b, 1 / bin_size)
        c = abs(ab) ** 2 / np.maximum(pa * pb, 1e-300)
        k = 1 + int(np.argmax(c[1:]))
        phase = float(np.angle(ab[k]))
        return pd.DataFrame({"coherence_peak": [float(c[k])], "coherence_freq": [float(freq[k])], "coherence_phase": [phase], "coherence_leader": ["A" if phase > 0 else "B" if phase < 0 else "sync"]})

    return _grouped(pair, key, "pos", "coherence_peak double, coherence_freq double, coherence_phase double, coherence_leader string", f)


def _smooth(x: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        x = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, np.pad(x, pad, "symmetric"))
    return x


def morlet(x: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Real Morlet transform, exp(-t^2 / 2) cos(5 t), by convolution at each width."""
    out = []
    for s in widths:
        t = np.arange(-8 * s, 8 * s + 1) / s
        out.append(np.convolve(x, np.exp(-(t**2) / 2) * np.cos(5 * t) / math.sqrt(s), "full")[8 * s : 8 * s + len(x)])
    return np.array(out)


def wavelet(pair: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Mean phase difference and mean smoothed coherence at each position, over widths from 2 up to but not including min(64, n // 4); A
    leads on positive phase. The size of the cross spectrum is smoothed, not its sign, so coherence doesn't vanish where phases alternate."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        a, b = x.a.to_numpy(float), x.b.to_numpy(float)
        widths = np.arange(2, min(64, len(a) // 4))
        if not len(widths):
            return pd.DataFrame({"pos": x.pos.astype(int), "mean_phase_diff": None, "mean_coherence": None, "leader": None})
        wa, wb = morlet(a, widths), morlet(b, widths)
        cross = wa * wb
        c = _smooth(np.abs(cross)) ** 2 / (_smooth(wa**2) * _smooth(wb**2) + 1e-12)
        phase = np.where(cross < 0, np.pi, 0.0).mean(0)
        return pd.DataFrame({"pos": x.pos.to_numpy(int), "mean_phase_diff": phase, "mean_coherence": c.mean(0), "leader": np.where(phase > 0, "A", "B")})

    return _grouped(pair, key, "pos", "pos long, mean_phase_diff double, mean_coherence double, leader string", f)


def granger_f(x: np.ndarray, y: np.ndarray, lag: int) -> tuple[float, float]:
    """F and p of whether y's past helps x's own: sums of squares of the restricted and the full regression."""
    n = len(x) - lag
    if n <= 2 * lag + 1:
        return math.nan, math.nan
    own = np.column_stack([x[lag - k : len(x) - k] for k in range(1, lag + 1)])
    other = np.column_stack([y[lag - k : len(y) - k] for k in range(1, lag + 1)])
    one, target = np.ones((n, 1)), x[lag:]
    rss = [float(((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum()) for m in (np.hstack([one, own]), np.hstack([one, own, other]))]
    df = n - 2 * lag - 1
    if rss[1] <= 1e-12:
        return math.nan, math.nan
    f = (rss[0] - rss[1]) / lag / (rss[1] / df)
    return f, float(f_sf(f, lag, df))


def granger(pair: DataFrame, max_lag: int, key: list[str] = KEY) -> DataFrame:
    """Greatest F and least p over lags in both directions; B leads unless A's F is greater."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        a, b = x.a.to_numpy(float), x.b.to_numpy(float)
        best = []
        for target, source in ((b, a), (a, b)):
            got = [v for k in range(1, min(max_lag, len(a) // 3) + 1) if not math.isnan((v := granger_f(target, source, k))[0])]
            best.append((max(v[0] for v in got), min(v[1] for v in got)) if got else (None, None))
        lead = "A" if best[0][0] is not None and best[1][0] is not None and best[0][0] > best[1][0] else "B"
        return pd.DataFrame({"granger_F_AtoB": [best[0][0]], "granger_p_AtoB": [best[0][1]], "granger_F_BtoA": [best[1][0]], "granger_p_BtoA": [best[1][1]], "granger_leader": [lead]})

    return _grouped(pair, key, "pos", "granger_F_AtoB double, granger_p_AtoB double, granger_F_BtoA double, granger_p_BtoA double, granger_leader string", f)


def granger_windows(pair: DataFrame, max_lag: int, width: int, step: int, key: list[str] = KEY) -> DataFrame:
    """Greatest F over lags in both directions within each window (the last one may be short); null where the window is too short
    for its lags, min(max_lag, length // 3) of them, or a regression is exact. B leads unless A's F is greater."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        a, b, n = x.a.to_numpy(float), x.b.to_numpy(float), len(x)
        rows, full = [], (n - width) // step + 1 if n >= width else 0
        for w in range(full + (full * step < n)):
            u, v = a[w * step : w * step + width], b[w * step : w * step + width]
            lags = min(max_lag, len(u) // 3)
            got = [[granger_f(t, s, k)[0] for k in range(1, lags + 1)] if lags and 3 * lags + 1 < len(u) else [math.nan] for t, s in ((v, u), (u, v))]
            ab, ba = (None if any(map(math.isnan, g)) else max(g) for g in got)
            rows.append((w, w * step, ab, ba, "A" if ab is not None and ba is not None and ab > ba else "B"))
        return pd.DataFrame(rows, columns=["window", "start", "granger_F_AtoB", "granger_F_BtoA", "granger_leader"])

    return _grouped(pair, key, "pos", "window long, start long, granger_F_AtoB double, granger_F_BtoA double, granger_leader string", f)


# reduction


def matrix(x: pd.DataFrame, index: str = "bin") -> tuple[np.ndarray, list[str]]:
    """Standardised columns (population sd, constant columns 0) of a long group, gaps 0."""
    wide = x.pivot_table(index=index, columns="feature", values="value", aggfunc="first").sort_index()
    m = wide.to_numpy(float)
    m = np.where(np.isfinite(m), m, np.nanmean(np.where(np.isfinite(m), m, np.nan), 0))
    sd = m.std(0)
    return np.where(sd > 0, (m - m.mean(0)) / np.where(sd > 0, sd, 1), 0.0), list(wide.columns)


def signed(components: np.ndarray) -> np.ndarray:
    """Rows with the loading of greatest size positive."""
    at = np.abs(components).argmax(1)
    return components * np.where(components[np.arange(len(components)), at] < 0, -1, 1)[:, None]


def pca(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(m - m.mean(0), full_matrices=False)
    k = min(k, *m.shape)
    total = (s**2).sum()
    return signed(v[:k]), (s**2)[:k] / total if total > 0 else np.zeros(k)


def factor_analysis(m: np.ndarray, k: int, rounds: int = 200) -> np.ndarray:
    """Loadings by EM with diagonal noise."""
    cov, k = np.cov(m.T, bias=True).reshape(m.shape[1], -1), min(k, *m.shape)
    w, psi = pca(m, k)[0].T * 0.5, np.full(m.shape[1], 0.5)
    for _ in range(rounds):
        beta = w.T @ np.linalg.inv(w @ w.T + np.diag(psi))
        ezz = np.eye(k) - beta @ w + beta @ cov @ beta.T
        w = cov @ beta.T @ np.linalg.pinv(ezz)
        psi = np.maximum(np.diag(cov - w @ beta @ cov), 1e-6)
    return signed(w.T)


def fast_ica(m: np.ndarray, k: int, rounds: int = 500) -> np.ndarray:
    """Unmixing rows by symmetric fixed-point iteration with tanh, from a fixed start."""
    k = min(k, *m.shape)
    u, s, v = np.linalg.svd(m - m.mean(0), full_matrices=False)
    k = min(k, int((s > 1e-9).sum()))
    white = v[:k] / s[:k, None] * math.sqrt(len(m))
    z = m @ white.T
    w = np.linalg.qr(np.random.default_rng(0).normal(size=(k, k)))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - np.diag((1 - g**2).mean(0)) @ w
        a, _, b = np.linalg.svd(new)
        new = a @ b
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-6
        w = new
        if done:
            break
    return signed(w @ white)


REDUCTIONS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"pca": lambda m, k: pca(m, k)[0], "fa": factor_analysis, "ica": fast_ica}


def reduced(series: DataFrame, method: str, k: int, within: list[str], index: str = "bin") -> DataFrame:
    """component, index, value: scores of each component; pca, fa or ica."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        m, _ = matrix(x, index)
        c = REDUCTIONS[method](m, k)
        s = m @ c.T
        n = np.sort(x[index].unique())
        return pd.DataFrame({"component": np.repeat([f"{method.upper()}{i + 1}" for i in range(len(c))], len(n)), index: np.tile(n, len(c)), "value": s.T.ravel()})

    kind = series.schema[index].dataType.simpleString()
    return _grouped(series, within, index, f"component string, {index} {kind}, value double", f)


def loadings(series: DataFrame, method: str, k: int, within: list[str], index: str = "bin") -> DataFrame:
    """component, feature, loading, explained (pca's share of variance, else null)."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        m, names = matrix(x, index)
        c = REDUCTIONS[method](m, k)
        share = pca(m, k)[1] if method == "pca" else [None] * len(c)
        return pd.DataFrame([{"component": f"{method.upper()}{i + 1}", "feature": n, "loading": float(v), "explained": share[i]} for i, row in enumerate(c) for n, v in zip(names, row, strict=True)], columns=["component", "feature", "loading", "explained"])

    return _grouped(series, within, index, "component string, feature string, loading double, explained double", f)


def top_features(loaded: DataFrame, within: list[str], most: int = 30) -> DataFrame:
    """loaded, of the `most` features with the greatest absolute loading in any component, with max_abs and rank; ties by name."""
    best = loaded.groupBy(*within, "feature").agg(F.max(F.abs("loading")).alias("max_abs"))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("max_abs"), "feature"))
    return loaded.join(best.withColumn("rank", rank).where(F.col("rank") <= most), [*within, "feature"])


def cca_weights(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ua, sa, va = np.linalg.svd(a, full_matrices=False)
    ub, sb, vb = np.linalg.svd(b, full_matrices=False)
    ra, rb = int((sa > 1e-9).sum()), int((sb > 1e-9).sum())
    p, r, q = np.linalg.svd(ua[:, :ra].T @ ub[:, :rb])
    k = min(k, len(r))
    return (va[:ra].T / sa[:ra]) @ p[:, :k], (vb[:rb].T / sb[:rb]) @ q.T[:, :k], r[:k]


def cca(series: DataFrame, k: int, within: list[str], person: str = "person", index: str = "bin") -> DataFrame:
    """component, person, feature, loading, correlation of the canonical pairs of persons A and B over their common bins."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        common = set(x[x[person] == "A"][index]) & set(x[x[person] == "B"][index])
        x = x[x[index].isin(common)]
        empty = pd.DataFrame(columns=["component", "member", "feature", "loading", "correlation"])
        if len(common) < 3:
            return empty
        (a, na), (b, nb) = (matrix(x[x[person] == who], index) for who in "AB")
        wa, wb, r = cca_weights(a, b, k)
        rows = []
        for i in range(len(r)):
            sign = np.sign(wa[np.abs(wa[:, i]).argmax(), i]) or 1.0
            rows += [{"component": f"CCA{i + 1}", "member": who, "feature": n, "loading": float(sign * v), "correlation": float(min(1.0, r[i]))} for who, names, w in (("A", na, wa), ("B", nb, wb)) for n, v in zip(names, w[:, i], strict=True)]
        return pd.DataFrame(rows) if rows else empty

    return _grouped(series, within, index, "component string, member string, feature string, loading double, correlation double", f)


def ward(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels 1 to k by Ward's linkage of a distance matrix (Lance-Williams updates)."""
    n = len(distance)
    d, size, members = distance.astype(float) ** 2, np.ones(n), {i: [i] for i in range(n)}
    np.fill_diagonal(d, np.inf)
    live = list(range(n))
    while len(live) > k:
        sub = d[np.ix_(live, live)]
        i, j = divmod(int(sub.argmin()), len(live))
        i, j = live[min(i, j)], live[max(i, j)]
        for o in live:
            if o not in (i, j):
                d[i, o] = d[o, i] = ((size[i] + size[o]) * d[i, o] + (size[j] + size[o]) * d[j, o] - size[o] * d[i, j]) / (size[i] + size[j] + size[o])
        size[i] += size[j]
        members[i] += members.pop(j)
        live.remove(j)
    out = np.zeros(n, int)
    for label, i in enumerate(sorted(live, key=lambda i: min(members[i])), 1):
        out[members[i]] = label
    return out


def feature_clusters(series: DataFrame, k: int, within: list[str], index: str = "bin") -> DataFrame:
    """feature, cluster by Ward's linkage of 1 - |r|."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        m, names = matrix(x, index)
        r = m.T @ m / max(1, len(m))
        return pd.DataFrame({"feature": names, "cluster": ward(1 - np.abs(np.clip(r, -1, 1)), min(k, len(names)))})

    return _grouped(series, within, index, "feature string, cluster int", f)


def cluster_components(series: DataFrame, k: int, within: list[str], index: str = "bin") -> DataFrame:
    """cluster, index, value, explained: scores of the first principal component of each cluster of features."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        m, names = matrix(x, index)
        r = m.T @ m / max(1, len(m))
        label, at, out = ward(1 - np.abs(np.clip(r, -1, 1)), min(k, len(names))), np.sort(x[index].unique()), []
        for c in sorted(set(label.tolist())):
            own = m[:, label == c]
            v, share = pca(own, 1)
            out.append(pd.DataFrame({"cluster": c, index: at, "value": (own - own.mean(0)) @ v[0], "explained": float(share[0])}))
        return pd.concat(out)

    kind = series.schema[index].dataType.simpleString()
    return _grouped(series, within, index, f"cluster int, {index} {kind}, value double, explained double", f)


def component_labels(loaded: DataFrame, within: list[str], top: int = 3, width: int = 12) -> DataFrame:
    """label: the component's features of greatest absolute loading, cut to `width` letters, joined by '+'; ties by name."""
    w = Window.partitionBy(*within, "component").orderBy(F.desc(F.abs("loading")), "feature")
    best = loaded.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= top)
    names = F.transform(F.array_sort(F.collect_list(F.struct("__k", F.substring("feature", 1, width).alias("name")))), lambda x: x["name"])
    return best.groupBy(*within, "component").agg(F.array_join(names, "+").alias("label"))


# segmentation


def _scatter(x: np.ndarray, mean: np.ndarray, post: np.ndarray, covariance: str) -> np.ndarray:
    """Covariances (k, p, p) of the states in the given form, with 1e-3 on the diagonal."""
    (k, p), w = mean.shape, post.sum(0) + 1e-9
    full = np.array([((x - mean[j]) * post[:, [j]]).T @ (x - mean[j]) for j in range(k)])
    if covariance == "tied":
        return np.repeat((full.sum(0) / w.sum() + 1e-3 * np.eye(p))[None], k, 0)
    full = full / w[:, None, None]
    if covariance == "full":
        return full + 1e-3 * np.eye(p)
    var = np.maximum(np.diagonal(full, axis1=1, axis2=2), 1e-3)
    return np.array([np.diag(np.full(p, v.mean()) if covariance == "spherical" else v) for v in var])


def _log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(mean)))
    for j, (m, c) in enumerate(zip(mean, cov, strict=True)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, j] = -0.5 * ((z**2).sum(0) + len(m) * math.log(2 * math.pi)) - np.log(np.diag(low)).sum()
    return out


def fit_hmm(x: np.ndarray, k: int, seed: int, rounds: int = 60, covariance: str = "diag") -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, Viterbi path and posteriors of a Gaussian HMM by Baum-Welch in logs, from k-means++ means; covariances are
    full, diag, tied or spherical."""
    rng, (n, p) = np.random.default_rng(seed), x.shape
    mean = x[[rng.integers(n)]]
    while len(mean) < k:
        d = squared_distances(x, mean).min(1)
        mean = np.vstack([mean, x[rng.choice(n, p=d / d.sum() if d.sum() > 0 else None)]])
    cov, start, trans = np.repeat(np.diag(x.var(0) + 1e-3)[None], k, 0), np.log(np.full(k, 1 / k)), np.log(np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)))
    last = -np.inf
    total = lambda v, axis: np.logaddexp.reduce(v, axis)
    for _ in range(rounds):
        e = _log_density(x, mean, cov)
        a, b = np.empty((n, k)), np.zeros((n, k))
        a[0] = start + e[0]
        for t in range(1, n):
            a[t] = total(a[t - 1][:, None] + trans, 0) + e[t]
        for t in range(n - 2, -1, -1):
            b[t] = total(trans + e[t + 1] + b[t + 1], 1)
        ll = float(total(a[-1], 0))
        post = np.exp(a + b - ll)
        if ll - last < 1e-3:
            break
        last = ll
        xi = np.exp(a[:-1, :, None] + trans + (e + b)[1:, None, :] - ll).sum(0) + 1e-6
        start, trans = np.log(post[0] + 1e-12), np.log(xi / xi.sum(1, keepdims=True))
        w = post.sum(0)[:, None] + 1e-9
        mean = post.T @ x / w
        cov = _scatter(x, mean, post, covariance)
    v, back = start + e[0], np.zeros((n, k), int)
    for t in range(1, n):
        s = v[:, None] + trans
        back[t] = s.argmax(0)
        v = s.max(0) + e[t]
    path = np.empty(n, int)
    path[-1] = int(v.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return ll, path, post


def hmm_states(series: DataFrame, states: list[int], restarts: int, within: list[str], index: str = "bin", covariance: str = "full") -> DataFrame:
    """index, state (from 1), prob, n_states, log_likelihood, BIC, AIC: every number of states is one group of its own, so
    Spark runs the grid of fits in parallel; the best of the restarts stands. Seeds follow from the entity."""
    grid = series.withColumn("n_states", F.explode(F.array(*map(F.lit, states))))

    def f(x: pd.DataFrame) -> pd.DataFrame:
        m, _ = matrix(x, index)
        k, n, p = int(x.n_states.iloc[0]), len(m), m.shape[1]
        seed = zlib.crc32(repr([x[c].iloc[0] for c in within]).encode())
        ll, path, post = max((fit_hmm(m, k, seed + r, covariance=covariance) for r in range(restarts)), key=lambda r: r[0])
        free = hmm_parameters(k, p, covariance)
        at = np.sort(x[index].unique())
        return pd.DataFrame({index: at, "state": path + 1, "prob": post[np.arange(n), path], "log_likelihood": ll, "BIC": free * math.log(n) - 2 * ll, "AIC": 2 * free - 2 * ll})

    kind = series.schema[index].dataType.simpleString()
    return _grouped(grid, [*within, "n_states"], index, f"{index} {kind}, state int, prob double, log_likelihood double, BIC double, AIC double", f)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By dot products: memory is that of the result, whatever the number of columns."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0.0)


def rbf_gram(m: np.ndarray) -> np.ndarray:
    d = squared_distances(m, m)
    off = d[np.triu_indices(len(m), 1)]
    med = float(np.median(off)) if len(off) else 1.0
    g = np.exp(-np.clip(d / (med if med > 0 else 1.0), 1e-2, 1e2))
    np.fill_diagonal(g, 1.0)
    return g


def kernel_cost(m: np.ndarray) -> Callable[[int, int], float]:
    """Cost of the segment [a, b) by prefix sums of the Gram matrix."""
    n = len(m)
    s = np.zeros((n + 1, n + 1))
    s[1:, 1:] = rbf_gram(m).cumsum(0).cumsum(1)
    return lambda a, b: (b - a) - (s[b, b] - s[a, b] - s[b, a] + s[a, a]) / (b - a)


def change_points(m: np.ndarray, penalty: float = 1.0, least: int = 2, jump: int = 1) -> list[int]:
    """Ends of segments by pruned exact search over the kernel cost; ends lie at multiples of `jump`, but for the last."""
    n, cost = len(m), kernel_cost(m)
    best, prev, open_ = {0: 0.0}, {}, [0]
    for t in [*[t for t in range(jump, n, jump) if t >= least], n]:
        options = [(best[a] + cost(a, t) + penalty, a) for a in open_ if t - a >= least and a in best]
        if not options:
            continue
        best[t], prev[t] = min(options)
        open_ = [a for a in open_ if t - a < least or best[a] + cost(a, t) <= best[t]] + [t]
    out, t = [], n
    while t in prev:
        out.append(t)
        t = prev[t]
    return out[::-1]


def binary_segments(m: np.ndarray, splits: int, least: int = 2, jump: int = 1) -> list[int]:
    """Ends of segments after `splits` greedy cuts, each where the kernel cost falls most; fewer where nothing can be cut."""
    n, cost = len(m), kernel_cost(m)
    ends = [0, n]
    for _ in range(splits):
        best = None
        for a, b in zip(ends, ends[1:], strict=False):
            for t in range(a + least + (-(a + least)) % jump, b - least + 1, jump):
                gain = cost(a, b) - cost(a, t) - cost(t, b)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, t)
        if best is None:
            break
        ends = sorted([*ends, best[1]])
    return ends[1:]


def changepoint_states(series: DataFrame, penalty: float, within: list[str], index: str = "bin", n_states: int | None = None, least: int = 2, jump: int = 5) -> DataFrame:
    """index, state: the segment's number from 1, by penalised search, or by n_states - 1 greedy cuts. The cost is quadratic in an
    entity's bins, as the algorithm is."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        m, _ = matrix(x, index)
        ends = change_points(m, penalty, least, jump) if n_states is None else binary_segments(m, n_states - 1, least, jump)
        return pd.DataFrame({index: np.sort(x[index].unique()), "state": np.searchsorted(ends, np.arange(len(m)), "right") + 1})

    kind = series.schema[index].dataType.simpleString()
    return _grouped(series, within, index, f"{index} {kind}, state int", f)


def kmeans(m: np.ndarray, k: int, seed: int = 0, rounds: int = 50, starts: int = 10) -> np.ndarray:
    """Labels of the start of least inertia, centres drawn by squared distance."""
    best = None
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        c = m[[rng.integers(len(m))]]
        while len(c) < k:
            d = squared_distances(m, c).min(1)
            c = np.vstack([c, m[rng.choice(len(m), p=d / d.sum() if d.sum() > 0 else None)]])
        for _ in range(rounds):
            d = squared_distances(m, c)
            label = d.argmin(1)
            new = np.array([m[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        inertia = float(squared_distances(m, c).min(1).sum())
        if best is None or inertia < best[0] - 1e-12:
            best = (inertia, label)
    return best[1]


def silhouette(m: np.ndarray, label: np.ndarray) -> float:
    d = np.sqrt(squared_distances(m, m))
    np.fill_diagonal(d, 0.0)
    values, at = np.unique(label, return_inverse=True)
    size = np.bincount(at)
    total = d @ np.eye(len(values))[at]  # distance to each cluster
    own = np.arange(len(m)), at
    a = total[own] / np.maximum(size[at] - 1, 1)
    mean = total / size
    mean[own] = np.inf
    b = mean.min(1)
    top = np.maximum(a, b)
    return float(np.where((size[at] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0).mean())


def kmeans_windows(series: DataFrame, width: int, candidates: list[int], within: list[str], index: str = "bin") -> DataFrame:
    """index, state: clusters of rolling means, their number by silhouette, or the given one; the tail takes the last window's."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        m, _ = matrix(x, index)
        w = min(width, len(m))
        roll = np.stack([np.convolve(c, np.ones(w) / w, "valid") for c in m.T], 1)
        fits = [kmeans(roll, k) for k in candidates if 1 < k < len(roll)]
        fits = [v for v in fits if len(set(v.tolist())) > 1]
        label = fits[0] if len(fits) == 1 else max(fits, key=lambda v: silhouette(roll, v)) if fits else np.zeros(len(roll), int)
        full = np.concatenate([label, np.full(len(m) - len(label), label[-1])])
        return pd.DataFrame({index: np.sort(x[index].unique()), "state": full + 1})

    kind = series.schema[index].dataType.simpleString()
    return _grouped(series, within, index, f"{index} {kind}, state int", f)


# single series


def _dickey_fuller(x: np.ndarray, lags: int, skip: int) -> tuple[float, float]:
    """t of the level and AIC of the regression with constant and `lags` differences, without the first `skip` rows."""
    d = np.diff(x)
    y = d[skip:]
    m = np.column_stack([x[skip:-1], np.ones(len(y)), *[d[skip - k : len(d) - k] for k in range(1, lags + 1)]])
    beta, *_ = np.linalg.lstsq(m, y, rcond=None)
    rss = max(float(((y - m @ beta) ** 2).sum()), 1e-300)
    se = math.sqrt(rss / max(1, len(y) - m.shape[1]) * np.linalg.pinv(m.T @ m)[0, 0])
    return float(beta[0] / se), len(y) * math.log(rss / len(y)) + 2 * m.shape[1]


def adf_statistic(x: np.ndarray, max_lag: int) -> tuple[float, int]:
    """t of the level in the Dickey-Fuller regression with constant: lags by AIC over one common sample, then all rows they allow."""
    lags = min(range(max_lag + 1), key=lambda p: _dickey_fuller(x, p, max_lag)[1])
    return _dickey_fuller(x, lags, lags)[0], lags


#: Response surface of the Dickey-Fuller distribution with constant (MacKinnon 1994): bounds, and polynomials in t of
#: the normal quantile below and above the middle bound.
ADF_LEAST, ADF_MIDDLE, ADF_MOST = -18.83, -1.61, 2.74
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p(t: float) -> float:
    if t > ADF_MOST or t < ADF_LEAST:
        return float(t > ADF_MOST)
    z = sum(c * t**k for k, c in enumerate(ADF_SMALL if t <= ADF_MIDDLE else ADF_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def stationarity(series: DataFrame, within: list[str], index: str = "bin", least: int = 20) -> DataFrame:
    """adf_stat, adf_p (response surface), lags, stationary (p < 0.05); null for fewer than `least` points or a constant."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        v = x["value"].dropna().to_numpy(float)
        if len(v) < least or v.std() == 0:
            return pd.DataFrame({"adf_stat": [None], "adf_p": [None], "lags": [None], "stationary": [None]}, dtype=object)
        t, lags = adf_statistic(v, min(20, len(v) // 4))
        p = adf_p(t)
        return pd.DataFrame({"adf_stat": [t], "adf_p": [p], "lags": [lags], "stationary": [p < 0.05]})

    return _grouped(series, within, index, "adf_stat double, adf_p double, lags int, stationary boolean", f)


def key_frames(histograms: DataFrame, within: list[str], index: str, vector: str, distance: float, gap: float, most: int) -> DataFrame:
    """Frames kept greedily: far enough (Bhattacharyya) and late enough after the last one kept, up to `most`."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        kept, last, at = [], None, None
        for i, h in zip(x[index], x[vector], strict=True):
            h = np.abs(np.asarray(h, float))
            h = h / h.sum() if h.sum() > 0 else h
            d = 1.0 if last is None else math.sqrt(max(0.0, 1 - float(np.sqrt(h * last).sum())))
            if last is None or (d >= distance and i - at >= gap):
                kept.append((i, d))
                last, at = h, i
                if len(kept) >= most:
                    break
        return pd.DataFrame(kept, columns=[index, "distance"])

    kind = histograms.schema[index].dataType.simpleString()
    return _grouped(histograms, within, index, f"{index} {kind}, distance double", f)


def spectral(samples: DataFrame, within: list[str], index: str, value: str, rate: float) -> DataFrame:
    """Centroid, bandwidth, flatness, 85 % roll-off and the frequency of greatest magnitude of each frame of samples."""

    def f(x: pd.DataFrame) -> pd.DataFrame:
        v = x[value].to_numpy(float)
        m = np.abs(np.fft.rfft(v * hann(len(v)) if len(v) > 1 else v))
        fr = np.fft.rfftfreq(len(v), 1 / rate)
        s = m.sum() or 1.0
        c = float((fr * m).sum() / s)
        power = np.maximum(m**2, 1e-10)
        return pd.DataFrame({"centroid": [c], "bandwidth": [math.sqrt(float((m * (fr - c) ** 2).sum() / s))], "flatness": [float(np.exp(np.log(power).mean()) / power.mean())], "rolloff": [float(fr[np.searchsorted(np.cumsum(m), 0.85 * m.sum())])], "pitch": [float(fr[m.argmax()])]})

    return _grouped(samples, within, index, "centroid double, bandwidth double, flatness double, rolloff double, pitch double", f)
