"""Properties that hold for any input, of the parts that need no session."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dyadspark.functions import special
from dyadspark.operators import kernels, states

runs = st.lists(st.tuples(st.integers(1, 6), st.integers(0, 3)), min_size=1, max_size=12)


@settings(max_examples=60, deadline=None)
@given(runs, st.integers(1, 5))
def test_smoothing_keeps_length_and_leaves_no_short_run(pairs, least):
    joined = []
    for n, s in pairs:
        if joined and joined[-1][1] == s:
            joined[-1] = (joined[-1][0] + n, s)
        else:
            joined.append((n, s))
    out = states.smoothed_runs([n for n, _ in joined], [s for _, s in joined], least)
    assert len(out) == sum(n for n, _ in joined)
    assert set(out) <= {s for _, s in joined}
    edges = [0, *[i for i in range(1, len(out)) if out[i] != out[i - 1]], len(out)]
    lengths = np.diff(edges)
    assert len(lengths) == 1 or lengths.min() >= least


@settings(max_examples=60, deadline=None)
@given(st.floats(0.5, 50), st.floats(0.5, 50), st.floats(0.001, 0.999))
def test_beta_symmetry(a, b, x):
    left, right = float(special.beta_inc(a, b, x)), float(special.beta_inc(b, a, 1 - x))
    assert 0 <= left <= 1
    assert abs(left + right - 1) < 1e-8


@settings(max_examples=40, deadline=None)
@given(st.floats(0, 40), st.floats(1, 40))
def test_survival_is_monotone(x, df):
    p = special.chi2_sf(np.array([x, x + 1]), np.array([df, df]))
    assert 0 <= p[1] <= p[0] + 1e-12
    assert p[0] <= 1 + 1e-12


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 9), st.integers(1, 9), st.integers(0, 1000))
def test_ward_gives_as_many_clusters_as_asked(n, k, seed):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    labels = kernels.ward(d, min(k, n))
    assert set(labels) == set(range(1, min(k, n) + 1))


@settings(max_examples=20, deadline=None)
@given(st.integers(10, 60), st.integers(0, 1000))
def test_coherence_is_bounded(n, seed):
    rng = np.random.default_rng(seed)
    _, a, b, ab = kernels.welch(rng.normal(size=n), rng.normal(size=n), 1.0)
    assert (np.abs(ab) ** 2 <= a * b * (1 + 1e-9) + 1e-12).all()
