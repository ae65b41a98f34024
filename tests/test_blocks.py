"""Operators by blocks, exact rank tests, nested output and recordings as files: by value, at ends, seams and odd rows."""

import itertools
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dyadspark.operators import align, crossed, describe, exact, frames, framing, group, nested, pairwise, results, synchrony, text
from dyadspark.plans import registry
from dyadspark.sources import catalog, readers, recordings
from tests.conftest import DATA

registry.load()


def test_correlations_over_blocks_and_lags(spark):
    """Against numpy, with gaps, a constant series, and blocks far smaller than the series."""
    rng = np.random.default_rng(3)
    n, x, y = 57, rng.normal(1e6, 1, (57, 3)), rng.normal(-5, 2, (57, 2))
    x[rng.random(x.shape) < 0.15], y[rng.random(y.shape) < 0.1] = np.nan, np.nan
    x[:, 2] = np.where(np.isnan(x[:, 2]), np.nan, 0.1)  # nothing varies
    long = lambda m, name, e: [(e, f"{name}{k}", p, float(m[p, k])) for p in range(n) for k in range(m.shape[1]) if not np.isnan(m[p, k])]
    f = spark.createDataFrame(long(x, "f", "one") + [("two", "f0", 0, 1.0)], "e string, feature string, pos long, value double")
    t = spark.createDataFrame(long(y, "t", "one") + [("two", "t0", 0, 1.0)], "e string, target string, pos long, value double")
    got = {(r.dimension, r.target, r.lag): (r.n, r.correlation) for r in crossed.correlations(f, t, ["e"], -4, 3, block=10).where("e = 'one'").collect()}
    assert len(got) == 3 * 2 * 8
    for (i, j, lag) in itertools.product(range(3), range(2), range(-4, 4)):
        a, b = (x[: n - lag, i], y[lag:, j]) if lag >= 0 else (x[-lag:, i], y[: n + lag, j])
        ok = ~np.isnan(a) & ~np.isnan(b)
        count, r = got[f"f{i}", f"t{j}", lag]
        assert count == ok.sum()
        assert r is None if i == 2 else r == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1], abs=1e-9)
    alone = crossed.correlations(f, t, ["e"], -1, 1, block=10).where("e = 'two'").collect()
    assert [(r.lag, r.n, r.correlation) for r in alone] == [(0, 1, None)]
    assert crossed.correlations(f.where("false"), t, ["e"]).collect() == []


def test_positions_are_those_of_both(spark):
    f = spark.createDataFrame([("s", "a", b, 1.0) for b in (1, 3, 5, 9)] + [("s", "b", 4, 1.0)], "subject string, feature string, bin long, value double")
    t = spark.createDataFrame([("t", b, 2.0) for b in (3, 4, 9, 10)], "target string, bin long, value double")
    x, y = crossed.positions(f, t, ["subject"], [])
    assert sorted((r.bin, r.pos) for r in x.collect()) == [(3, 0), (4, 1), (9, 2)] == sorted((r.bin, r.pos) for r in y.collect())


@pytest.mark.parametrize("reflect", [False, True])
@pytest.mark.parametrize("n", [1, 7, 64, 65, 200])
def test_frames_at_the_ends(spark, reflect, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, n).round(1)
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "rec string, i long, x double").repartition(3)
    got = {r.frame: (r.rms, r.zero_crossing_rate) for r in framing.frames(df, ["rec"], "i", "x", 16, 4, reflect, chunk=10).collect()}
    assert sorted(got) == list(range(n // 4 + 1))
    inside = {i: v for i, v in enumerate(x)}
    if reflect:  # once about each end, as far as half a frame
        inside |= {-i: x[i] for i in range(1, min(8, n - 1) + 1)} | {2 * (n - 1) - i: x[i] for i in range(max(0, n - 9), n - 1)}
    for f, (rms, zcr) in got.items():
        span = range(f * 4 - 8, f * 4 + 8)
        assert rms == pytest.approx(math.sqrt(sum(inside.get(i, 0.0) ** 2 for i in span) / 16), abs=1e-12)
        assert zcr == sum((x[i] < 0) != (x[i - 1] < 0) for i in span[1:] if 1 <= i < n) / 16


def test_filter_has_no_seams(spark):
    x = np.random.default_rng(0).normal(0, 1, 101)
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)] + [("s", 5, 2.0), ("s", 8, None)], "rec string, i long, x double")
    w = [0.2, 0.5, 1.0, -0.5, 0.3]
    whole = {r.i: r.filtered for r in framing.filtered(df, ["rec"], "i", "x", w, 1000).where("rec = 'r'").collect()}
    for size in (1, 2, 7, 100):
        parts = framing.filtered(df, ["rec"], "i", "x", w, size)
        assert {r.i: r.filtered for r in parts.where("rec = 'r'").collect()} == pytest.approx(whole)
        assert {r.i: r.filtered for r in parts.where("rec = 's'").collect()} == {5: 2.0, 8: 0.0}
    assert whole[50] == pytest.approx(sum(c * x[48 + k] for k, c in enumerate(w)))
    with pytest.raises(ValueError, match="odd"):
        framing.filtered(df, ["rec"], "i", "x", [1.0, 1.0], 5)


def test_exact_counts(spark):
    n = spark.createDataFrame([(k,) for k in range(13)], "n int")
    for r in n.select("n", exact.signed_rank_counts(F.col("n")).alias("c")).collect():
        want = Counter(sum(s) for k in range(r.n + 1) for s in itertools.combinations(range(1, r.n + 1), k))
        assert r.c == [want[i] for i in range(r.n * (r.n + 1) // 2 + 1)]
    pairs = spark.createDataFrame([(a, b) for a in range(1, 7) for b in range(1, 7)], "a int, b int")
    for r in pairs.select("a", "b", exact.rank_sum_counts(F.col("a"), F.col("b")).alias("c")).collect():
        want = Counter(sum(s) - r.a * (r.a + 1) // 2 for s in itertools.combinations(range(1, r.a + r.b + 1), r.a))
        assert r.c == [want[i] for i in range(r.a * r.b + 1)]
    large = spark.createDataFrame([(40, 300.0), (50, 600.0), (51, 600.0), (0, 0.0)], "n int, w double").select(exact.signed_rank_p(F.col("w"), F.col("n")).alias("p")).collect()
    assert 0 < large[0].p < 1 and 0 < large[1].p < 1 and large[2].p is None and large[3].p is None


def test_rank_tests_choose_exact_or_normal(spark):
    plain = spark.createDataFrame([("g", float(v)) for v in (1, -2, 3, 4, 5)], "g string, v double")
    assert group.signed_rank(plain, "v", ["g"]).first().p_wilcoxon == pytest.approx(2 * 3 / 32)  # sums 0, 1, 2
    zero = plain.unionAll(spark.createDataFrame([("g", 0.0)], "g string, v double"))
    tied = plain.unionAll(spark.createDataFrame([("g", -5.0)], "g string, v double"))
    for df in (zero, tied):
        p = group.signed_rank(df, "v", ["g"]).first().p_wilcoxon
        assert p is not None and p * 2 ** df.count() % 1 > 1e-6
    two = spark.createDataFrame([("k", "a", float(v)) for v in (1, 2, 4)] + [("k", "b", float(v)) for v in (3, 5, 6)], "k string, g string, v double")
    r = group.mann_whitney(two, "v", "g", ["k"]).first()
    assert r.u_stat == 1 and r.p_value == pytest.approx(2 * 2 / 20)
    assert group.mann_whitney(two, "v", "g", ["k"], small=False).first().p_value != pytest.approx(r.p_value)
    paired = two.groupBy("k").pivot("g", ["a", "b"]).agg(F.max("v"))
    assert group.paired_signed_rank(paired, "a", "b", ["k"]).first().p_wilcoxon == 1.0


def test_pair_statistics_over_blocks(spark):
    rng = np.random.default_rng(2)
    v = {k: rng.normal(0, 1, (n, 5)) for k, n in (("a", 41), ("b", 2), ("c", 1), ("z", 3))}
    v["a"][7:20] = v["a"][7]  # copies
    v["z"][1] = 0
    df = spark.createDataFrame([(k, i, [float(c) for c in row]) for k, m in v.items() for i, row in enumerate(m)] + [("a", 99, None)], "g string, i int, v array<float>")
    x = {r.g: [] for r in df.select("g").distinct().collect()}
    for r in df.where("v IS NOT NULL").collect():
        x[r.g].append(np.array(r.v))
    for block in (4, 512):
        for r in pairwise.pair_statistics(df, ["g"], ["i"], "v", block).collect():
            pairs = list(itertools.combinations(x[r.g], 2))
            cosine = [float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if a.any() and b.any() else 0.0 for a, b in pairs]
            assert (r.n, r.n_pairs) == (len(x[r.g]), len(pairs))
            assert r.mean_distance == pytest.approx(np.mean([np.linalg.norm(a - b) for a, b in pairs]) if pairs else 0.0, abs=1e-9)
            want = (np.mean(cosine), np.std(cosine), min(cosine), max(cosine)) if pairs else (None,) * 4
            assert (r.mean_cosine, r.sd_cosine, r.min_cosine, r.max_cosine) == (pytest.approx(want, abs=1e-7) if pairs else want)
    s = {r.g: r for r in pairwise.spread(df, ["g"], "v").collect()}
    d = np.linalg.norm(np.array(x["a"]) - np.mean(x["a"], 0), axis=1)
    assert (s["a"].n, s["a"].centroid_distance, s["a"].spread_variance) == (41, pytest.approx(d.mean()), pytest.approx(d.var()))


def test_nested_shapes(spark):
    rows = [
        (1, '{"a": 1, "b": [1, 2, 6], "b_error": "x", "error": 1, "c": "t", "d": {"q": 1}, "e": [], "f": null, "g": ["x", 1], "h": true, "video_path": "p"}'), (2, '{"features": {"a": 2.5}, "other": 1}'),
        (3, '{"one": {"features": {"a": 3, "z": 0}}, "two": {"features": {"a": 4}}}'), (4, '{"one": {"features": {"a": 3}}, "two": 7}'), (5, "[1, 2]"), (6, None), (7, "{}"), (8, '{"m": [' + ",".join(map(str, range(21))) + "]}"),
    ]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("v", F.parse_json("j"))
    got = {(r.id, r.key): r.number if r.text is None else r.text for r in nested.scalars(nested.features(df, "v", ["id"]), ["id"]).collect()}
    assert got == {
        (1, "a"): 1.0, (1, "b_mean"): 3.0, (1, "b_std"): pytest.approx(np.std([1, 2, 6])), (1, "b_min"): 1.0, (1, "b_max"): 6.0, (1, "b_0"): 1.0, (1, "b_1"): 2.0, (1, "b_2"): 6.0, (1, "c"): "t", (1, "d"): '{"q":1}', (1, "g"): '["x",1]', (1, "h"): "true",
        (2, "a"): 2.5, (3, "a"): 4.0, (3, "z"): 0.0, (4, "one"): '{"features":{"a":3}}', (4, "two"): 7.0, (8, "m_mean"): 10.0, (8, "m_std"): pytest.approx(np.std(range(21))), (8, "m_min"): 0.0, (8, "m_max"): 20.0,
    }
    texts = ['{"text": "a", "transcript": " "}', '{"transcript": {"text": "", "transcription": "b"}, "text": "x"}', '{"transcription": 7}', "3", None, '{"transcribed_text": "c"}', '{"transcript": {"text": " ", "transcription": "b"}}']
    v = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").withColumn("v", F.parse_json("j"))
    assert [r.t for r in v.select("i", nested.text_of("v").alias("t")).orderBy("i").collect()] == ["a", "b", None, None, None, "c", None]


def test_commented_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("r1", 2, 0.5, 'say "hi", all'), ("r1", 1, None, "#tag"), ("r2", 3, 1 / 3, None)]
    df = spark.createDataFrame(rows, "rec string, i int, x double, s string")
    recordings.write_commented(df, path, "rec", ["i"], {"n": F.count(F.lit(1)), "title": F.lit("a: b")})
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part")]
    assert len(files) == 2
    with open(next(f for f in files if "rec=r2" in f)) as f:
        assert f.read() == "# n: 1\n# title: a: b\ni,x,s\n3,0.333333,\n"
    back = recordings.read_commented(spark, path, "i int, x double, s string, rec string", ["n", "title", "missing"]).collect()
    assert {(r.rec, r.i, r.x, r.n, r.title, r.missing) for r in back if r.i != 1} == {("r1", 2, 0.5, "2", "a: b", None), ("r2", 3, 0.333333, "1", "a: b", None)}
    broken = df.withColumn("x", F.when(F.col("i") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        recordings.write_commented(broken, str(tmp_path / "broken"), "rec", ["i"], {"n": F.count(F.lit(1))})
    assert not [f for _, _, names in os.walk(tmp_path / "broken") for f in names if f.startswith("part")]


def test_shared_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("#r1", 2, 0.5, 'say "hi", all'), ("#r1", 1, None, "#tag"), ('a "b", {c}', 3, 1 / 3, None), (None, 4, 2.0, ""), ("", 5, 2.5, "x")] + [(f"r{k}", k, float(k), "s") for k in range(100, 200)]
    df = spark.createDataFrame(rows, "rec string, i int, x double, s string")
    recordings.write_shared(df.select("i", "rec", "x", "s"), path, "rec", ["i"], {"n": F.count(F.lit(1)), "title": F.lit("a: b")})
    files = sorted(tmp_path.glob("out/part*"))
    assert len(files) <= 4
    lines = [x for f in files for x in f.read_text().splitlines()]
    at = next(k for k, x in enumerate(lines) if '"recording":"#r1"' in x)
    assert lines[at : at + 3] == ['# {"recording":"#r1","columns":"rec,i,x,s","metadata":{"n":"2","title":"a: b"}}', '"#r1",1,,#tag', '"#r1",2,0.500000,"say ""hi"", all"']
    back = recordings.read_shared(spark, path, "rec string, i int, x double, s string", ["n", "title", "missing"])
    counts = {r: sum(q[0] == r for q in rows) for r, *_ in rows}
    want = [(r, i, x if x is None else round(x, 6), s, str(counts[r]), "a: b", None) for r, i, x, s in rows]
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_frames_files_follow_the_rows_not_the_recordings(spark):
    from pathlib import Path

    base = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(base.glob("frames-*"))
    assert registry.QUERIES["per_frame_files"](spark, DATA).select("vec_id").distinct().count() >= 50
    (folder,) = set(base.glob("frames-*")) - before
    assert 1 <= len(list(folder.rglob("part*"))) <= 4


def test_media_by_extension(spark, tmp_path):
    for name in ("a.MP4", "b.wav", "c.txt", "d.mkv", "below/e.flac"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"xy")
    got = {(r.name, r.kind, r.length) for r in recordings.media(spark, str(tmp_path)).collect()}
    assert got == {("a.MP4", "video", 2), ("b.wav", "audio", 2), ("d.mkv", "video", 2)}
    assert {r.name for r in recordings.media(spark, str(tmp_path), ("audio",), recursive=True).collect()} == {"b.wav", "e.flac"}
    with pytest.raises(FileNotFoundError, match="video"):
        recordings.media(spark, str(tmp_path / "below"), ("video",))


def test_names_by_prefix_and_pattern(spark):
    names = spark.createDataFrame([("ab_c1",), ("ab_",), ("a",), ("zz",), (None,), ("ab_c1",)], "name string")
    rows = spark.createDataFrame([("a", "A"), ("ab_", "B"), ("ab_c", "C"), ("ab_c", "D")], "prefix string, owner string")
    got = Counter((r.name, r.owner) for r in catalog.longest_prefix(names, "name", rows).collect())
    assert got == {("ab_c1", "C"): 2, ("ab_", "B"): 1, ("a", "A"): 1, ("zz", None): 1, (None, None): 1}
    seen = spark.createDataFrame([(3, "xa"), (1, "b.a"), (2, "xa"), (4, "c")], "i int, name string")
    got = [(r.name, r.position, r.pattern) for r in catalog.by_pattern(seen, "name", ["*a", "x?", "b.*"], "i").orderBy("position").collect()]
    assert got == [("b.a", 0, "*a"), ("xa", 1, "*a")]
    with pytest.raises(ValueError, match="matches"):
        catalog.by_pattern(seen, "name", ["q*"], "i")


def test_time_without_entities(spark):
    df = spark.createDataFrame([(None, 500.0), (None, 2000.0), ("a", 900.0)], "e string, Timestamp double")
    assert sorted(r.time_seconds for r in readers.resolved_time(df, []).collect()) == [0.5, 0.9, 2.0]
    assert sorted(r.time_seconds for r in readers.resolved_time(df, ["e"]).collect()) == [0.5, 2.0, 900.0]


def test_movement_among_composites(spark):
    c = spark.createDataFrame([("s", "g", 0, 0.0)], "subject string, dimension string, bin long, value double")
    m = spark.createDataFrame([("s", 0.5, 1.0), ("s", 0.9, 3.0), ("s", 7.0, 5.0)], "subject string, t double, movement_energy double")
    got = describe.with_movement(c, m, c, ["subject"], 1.0).collect()
    assert {(r.dimension, r.bin, r.value) for r in got} == {("g", 0, 0.0), ("movement_energy", 0, 2.0)}


def test_split_and_edges(spark):
    flat = spark.createDataFrame([("r", 1.0, 2.0), ("r", 1.0, 4.0)], "rec string, d double, m double")
    r = frames.split_at_quantile(flat, ["rec"], "d", "m").first()  # nothing lies before the rest
    assert (r.avg_motion_magnitude, r.foreground_motion_ratio, r.object_interaction_score) == (3.0, 0.0, 0.0) and r.background_motion_ratio == pytest.approx(1)
    ramp = spark.createDataFrame([("r", y, x, float(x)) for y in range(4) for x in range(5)] + [("one", 0, 0, 9.0)], "rec string, y int, x int, d double")
    got = {r.rec: r.depth_discontinuity_score for r in frames.edge_score(ramp, ["rec"], "y", "x", "d").collect()}
    assert got == {"r": pytest.approx(8 * 3 / 5 / 50), "one": 0.0}  # a mirrored border has no slope


def test_frames_of_a_video(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0, 2.0]), ("b", [4.0])], "rec string, v array<double>")
    got = {r.rec: r.x for r in df.select("rec", align.audio_at_frames(F.col("v"), F.lit(4), F.lit(10.0), 800, 16000).alias("x")).collect()}
    assert got == {"a": pytest.approx([1.0, 2.0, 2.0, 2.0]), "b": None}  # hops at 0, 0.05, 0.1 seconds: frame 1 stands at the last
    s = spark.createDataFrame([("same", 5, 1.0), ("same", 9, 2.0), ("few", 0, 0.0), ("few", 4, 8.0), ("one", 0, 1.0)], "rec string, f int, v double")
    r = spark.createDataFrame([("same", 2), ("few", 6), ("one", 3)], "rec string, n int")
    got = sorted((r.rec, r.frame_idx, r.value) for r in align.frame_tracks(s, r, ["rec"], "f", "v", "n").collect())
    assert got == [("few", k, min(2.0 * k, 8.0)) for k in range(6)] + [("same", 0, 1.0), ("same", 1, 2.0)]


def test_labels_and_questions(spark):
    rows = [("g", "a", "a", 0.9, 0), ("g", "a", "b", 0.7, 2), ("g", "a", "b", 0.6, 1), ("h", "a", "a", 0.5, 0)]
    got = {r.g: (r.n, r.matched, r.mismatched) for r in text.label_matches(spark.createDataFrame(rows, "g string, p string, t string, s double, i int"), ["g"], "p", "t", "s", "i").collect()}
    assert got == {"g": (3, 0.5, 0.6), "h": (1, 1.0, None)}
    s = spark.createDataFrame([(0, ["A?", "B."]), (1, ["B.", "C."]), (2, ["A?"]), (3, [])], "i int, s array<string>")
    got = {r.i: (r.q, r.a) for r in s.select("i", *[c.alias(n) for c, n in zip(text.questions_and_statements(F.col("s")), "qa", strict=True)]).collect()}
    assert got == {0: (["A?"], ["B."]), 1: (["B."], ["B.", "C."]), 2: (["A?"], ["A?"]), 3: ([], [])}


def test_lists_in_order(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 2, 5.0), ("y", 3, 7.0), ("x", 4, 5.0)], "g string, i int, v double")
    assert [(r.i, r["rank"]) for r in group.ordered(df, ["-v", "i"]).orderBy("rank").collect()] == [(3, 1), (2, 2), (4, 3), (1, 4)]
    assert {(r.g, r.i) for r in group.ordered(df, ["-v", "i"], ["g"], 1).collect()} == {("x", 2), ("y", 3)}
    assert [r.i for r in group.ordered(df, ["v", "-i"], top=2).orderBy("rank").collect()] == [4, 2]


def test_canonical_targets(spark):
    """T_CCA1 is the mix of targets that goes best with the features; here one mix of each is the same."""
    rng = np.random.default_rng(1)
    z, noise = rng.normal(0, 1, 80), rng.normal(0, 1, (80, 3))
    long = lambda m: [("s", n, b, float(v)) for b in range(80) for n, v in m(b).items()]
    f = spark.createDataFrame(long(lambda b: {"f1": z[b] + noise[b, 0], "f2": noise[b, 0]}), "e string, feature string, bin long, value double")
    t = spark.createDataFrame(long(lambda b: {"t1": 3 * z[b] - noise[b, 1], "t2": noise[b, 1], "t3": noise[b, 2]}), "e string, feature string, bin long, value double")
    got = results.targets(t, "cca", ["e"], k=1, features=f)
    scores = np.array([r.value for r in got.where("target = 'T_CCA1'").orderBy("bin").collect()])
    assert abs(np.corrcoef(scores, z)[0, 1]) == pytest.approx(1, abs=1e-6)
    assert {r.target for r in results.targets(t, "pca", ["e"], k=2).select("target").distinct().collect()} == {"T_PCA1", "T_PCA2"}
    for method in ("cca", "roi-average", "no such"):
        with pytest.raises(ValueError):
            results.targets(t, method, ["e"])


@pytest.mark.parametrize(("n", "cells"), [(23, 5), (23, 512), (9, 1)])
def test_recurrence_lines_by_enumeration(spark, n, cells, monkeypatch):
    monkeypatch.setattr(synchrony, "CELLS", cells)
    rng = np.random.default_rng(n)
    a, b = rng.normal(0, 1, n).round(1), rng.normal(0, 1, n).round(1)
    df = spark.createDataFrame([("d", "x", i, float(a[i]), float(b[i])) for i in range(n)], "dyad string, dimension string, pos long, a double, b double")
    r = synchrony.recurrence(df).first()
    d = np.round(np.abs(a[:, None] - b), 9)
    hit = d <= np.percentile(d, 10) + 1e-10
    runs = lambda lines: [len(list(g)) for line in lines for k, g in itertools.groupby(line) if k]
    diagonal, vertical = runs([np.diagonal(hit, k) for k in range(-n + 1, n)]), runs(hit.T)
    long = [x for x in diagonal if x > 1]
    p = np.array(list(Counter(long).values())) / max(1, len(long))
    assert r.rqa_rqa_RR == pytest.approx(hit.mean()) and r.rqa_rqa_DET == pytest.approx(sum(long) / sum(diagonal)) and r.rqa_rqa_Lmax == max(long, default=0)
    assert r.rqa_rqa_LAM == pytest.approx(sum(x for x in vertical if x > 1) / sum(vertical)) and r.rqa_rqa_ENTR == pytest.approx(-(p * np.log(p + 1e-12)).sum())


def test_surrogates_keep_what_must_stay(spark):
    """One block is the series itself, so every surrogate reaches; a strong coupling is reached by few."""
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, 60)
    df = spark.createDataFrame([("d", "x", i, float(v), float(v + 0.1 * rng.normal())) for i, v in enumerate(a)] + [("d", "flat", i, 1.0, float(v)) for i, v in enumerate(a)] + [("d", "x", 60, None, 1.0)], "dyad string, dimension string, pos long, a double, b double")
    one = {r.dimension: r.p_pearson for r in synchrony.surrogate_test(df, 20, 60).collect()}
    assert one == {"x": 1.0, "flat": None}
    many = {r.dimension: (r.p_pearson, r.p_concordance) for r in synchrony.surrogate_test(df, 250, 7).collect()}
    assert many["x"] == (1 / 251, 1 / 251)


def test_long_groups_are_numbered_in_cells(spark):
    """Places over cells are row_number's, with nulls first, a key that many rows share, and groups of null; no task sorts a whole group."""
    rng = np.random.default_rng(5)
    made = [("a" if i % 9 else None, None if i % 50 == 0 else 7 if i % 3 == 0 else int(rng.integers(-400, 5000)), i) for i in range(6000)] + [("b", 1, i) for i in range(5)]
    df = spark.createDataFrame(made, "g string, k long, j int").repartition(5)
    want = df.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy("k", "j")) - 1)
    for task in (100, 2500, 100_000):
        got = framing.numbered(df, ["g"], ["k", "j"], "at", task)
        assert got.columns == ["g", "k", "j", "at"] and dict(got.dtypes)["at"] == "bigint"
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    rows = framing.numbered(df.where("k <> 7 AND g = 'a'"), ["g"], ["k", "j"], "at", 100).groupBy(F.spark_partition_id()).count()
    assert rows.count() > 10 and rows.agg(F.max("count")).first()[0] < 1000
    assert framing.numbered(df.where("false"), ["g"], ["k", "j"], "at").count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        framing.numbered(df, ["g"], ["g", "k"], "at")


def test_pairs_of_blocks_keep_a_task_short(spark, monkeypatch):
    """Tasks follow the pairs of blocks, and close vectors keep their digits beside far ones."""
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (300, 4))
    v[1::2] = v[::2] * (1 + 1e-9)
    df = spark.createDataFrame([("a", i, [float(c) for c in row]) for i, row in enumerate(v)], "g string, i int, v array<double>")
    asked, plain = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *c: asked.append(n) or plain(self, n, *c))
    r = pairwise.pair_statistics(df, ["g"], ["i"], "v", 4).first()
    assert asked == [math.ceil(75 * 76 / 2 / pairwise.TASK)] == [45]
    n, distance, *_ = pairwise.block_statistics(v[:2], v[:2], True)
    assert n == 1 and distance == pytest.approx(np.linalg.norm(v[0] - v[1]), rel=1e-12)
    assert r.n_pairs == 44850 and r.mean_distance == pytest.approx(np.mean([np.linalg.norm(a - b) for a, b in itertools.combinations(v, 2)]), rel=1e-10)
