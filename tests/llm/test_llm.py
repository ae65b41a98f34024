"""The ten operators and the pipeline against brute force, on small tables with nulls, empty and long texts, ties, repeats,
extra columns with clashing names, and no rows at all."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA

from dyadspark.llm import ball_tree, fingerprint, jaccard_join, line_dedup, ngram_lm, packing, piece_bpe, quality, recurrence, substring_dedup, suffix_dedup
from dyadspark.llm import queries as Q
from dyadspark.llm.components import components
from tests.compare import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, spans string, n long, label int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus():
    """Texts by seed: near copies, shared passages, repeats, other scripts, and the corner cases."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(120).split(), text(60)
    out = ["", None, " \n\t ", "one", "One", "two words", "a b c", "same text here for all\nand a line", "same text here for all\nand a line"]
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    out += [text(30) + "\n" + passage + ".\n" + text(20) for _ in range(8)]
    out += [passage + "\n" + text(5) + " " + passage, text(4000), "日本語のテキスト。" * 30, "😀 emoji nbsp  double  spaces ", text(80).upper(), "<|endoftext|> <s> ▁"]
    return [(i, t) for i, t in enumerate(out)] + [(9, out[9]), (None, out[10]), (None, "lonely row without id"), (3, "another text with a used id")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if k % 5 == 0 else f"s{k % 2}", None, "k", 7, None, 1, None) for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (7, 7), (6, 5), (None, 3)] + [(k, k + 1) for k in range(100, 140)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 5, 6)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert all(got[k] == 100 for k in range(100, 141))
    assert 7 not in got


@pytest.mark.parametrize(("size", "similar"), [(4, (85, 100)), (5, (80, 100)), (2, (9, 10))])
def test_jaccard_groups(docs, size, similar):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and similar[1] * both >= similar[0] * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    want = sorted(((d, len(sets[i]), (min(least[root(i)]) if least[root(i)] else None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)
    got = jaccard_join.jaccard_groups(docs, "doc_id", "text", size, similar)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == want
    kept = jaccard_join.one_of_each(docs, "doc_id", "text", size, similar)
    assert kept.columns == docs.columns
    groups = {root(i) for i in range(len(rows)) if sets[i]}
    assert kept.count() == len(groups) + sum(not s for s in sets)


@pytest.mark.parametrize(("size", "similar", "block"), [(4, (85, 100), 256), (5, (80, 100), 7), (2, (9, 10), 3)])
def test_jaccard_links(docs, size, similar, block, monkeypatch):
    """Every link counts, those inside a component too, for each row, in components of one block and of several."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PACK", min(block, 4))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    linked = lambda a, b: bool(a and b) and similar[1] * len(a & b) >= similar[0] * len(a | b)
    want = [(d, sum(linked(a, b) for k, b in enumerate(sets) if k != i)) for i, ((d, _), a) in enumerate(zip(rows, sets, strict=True))]
    assert max(n for _, n in want) > 2
    got = jaccard_join.jaccard_groups(docs, "doc_id", "text", size, similar)
    assert sorted(((r["doc_id"], r["n_links"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_lists_find_what_brute_force_finds(monkeypatch):
    monkeypatch.setattr(jaccard_join, "POSTINGS", 50)
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([set(rng.sample(range(15), rng.randint(1, 13))) for _ in range(rng.randint(1, 12))] for _ in range(2))
        arrays = [[np.array(sorted(s), np.uint64) for s in x] for x in (a, b)]
        got = jaccard_join.Lists(arrays[1]).linked(arrays[0], (7, 10))
        assert got.tolist() == [[10 * len(x & y) >= 7 * len(x | y) for y in b] for x in a]


def test_t_occurrence():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(20), rng.randint(0, 12))) for _ in range(rng.randint(1, 15))]
        t = rng.randint(1, 10)
        count = Counter(x for v in lists for x in v)
        assert jaccard_join.t_occurrence(lists, t) == {k: n for k, n in count.items() if n >= t}


@pytest.mark.parametrize("similar", [(80, 100), (85, 100), (95, 100)])
def test_signatures_lose_no_link(similar):
    """Sets at the very limit of similarity share a signature, whatever their size."""
    rng = np.random.default_rng(0)
    ranges = jaccard_join.Ranges(similar)
    for n in [*range(1, 40), 90, 200, 555, 1500]:
        h = rng.integers(0, 2**63, 2 * n + 2).astype(np.uint64)
        for m in {n, n + 1, n * similar[1] // similar[0]}:
            common = -(-similar[0] * (n + m) // (similar[0] + similar[1]))
            if common > min(n, m):
                continue
            a, b = h[:n], np.concatenate([h[:common], h[n : n + m - common]])
            row, sig = jaccard_join.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, ranges)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (n, m)
            x, y = jaccard_join.folded([jaccard_join.sketch(a), jaccard_join.sketch(b)])
            assert np.bitwise_count(x ^ y).sum() <= n + m - 2 * common


def test_fingerprints(spark, docs):
    rows = sorted(((-(2**63) if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.collect()))
    got = sorted((((-(2**63) if r["id"] is None else r["id"]), r["n_chars"], r["edited_sha256"]) for r in fingerprint.edited_neighbours(docs, "doc_id", "text").collect()))
    want = []
    for k, (i, t) in enumerate(rows):
        nxt, h = rows[(k + 1) % len(rows)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    # rows of one id may stand in either order of equal texts
    assert got == sorted(want)
    f = fingerprint.edited_neighbours(docs, "doc_id", "text").collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in f)
    w = lambda c: fingerprint.words_of(fingerprint.paragraphs(c))
    d = spark.createDataFrame([("one. two. three", "three\none.\ntwo.", "two.")], "a string, b string, c string")
    r = d.select(w(F.col("a")).alias("a"), w(F.col("b")).alias("b"), fingerprint.removed(w(F.col("a")), fingerprint.paragraphs(F.col("c"))).alias("less"), w(F.lit("three\none.")).alias("rest"), fingerprint.added(w(F.lit("three\none.")), fingerprint.paragraphs(F.col("c"))).alias("more")).first()
    assert r["a"] == r["b"] == r["more"]
    assert r["less"] == r["rest"]
    near = spark.createDataFrame([("\n".join(f"line {i}" for i in range(20)), "\n".join(f"line {i}" for i in range(10, 30)), "\n".join(f"other {i}" for i in range(20)))], "a string, b string, c string")
    x = near.select(fingerprint.likeness(w(F.col("a")), w(F.col("b"))).alias("half"), fingerprint.likeness(w(F.col("a")), w(F.col("c"))).alias("none")).first()
    assert 0.25 < x["half"] < 0.75
    assert x["none"] < 0.25


def test_line_dedup(spark, docs, duck):
    rows = [(k, "a", f"menu \nbody {k}\n\nmenu\nfoot {k % 2}") for k in range(10)] + [(10, None, "menu\nx"), (11, "b", "menu"), (12, "a", None), (13, "a", "")]
    got = {r["i"]: (r["t"], r["n"], r["gone"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "i int, host string, t string"), "t", F.col("host"), counts=("n", "gone")).collect()}
    assert got[3] == ("body 3\n", 4, 3)
    assert got[10] == ("menu\nx", 2, 0)
    assert got[11] == ("menu", 1, 0)
    assert got[12] == (None, 0, 0)
    assert got[13] == ("", 0, 0)
    assert line_dedup.line_dedup(docs, "text", F.col("source")).count() == docs.count()
    same(Q.op3_line_dedup(spark, DATA), duck.sql(Q.OP3_SQL))


def test_quality(spark, none):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    big = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    known = spark.read.parquet(DATA.replace("0.001", "0.01") + "/labels.parquet")
    model = quality.train(big, known, "doc_id", "text", "quality")
    scored = quality.classify(big, model, "doc_id", "text").join(known, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    assert np.mean([r["__predicted"] == r["quality"] for r in scored]) > 0.95
    odd = quality.classify(d.limit(2).unionByName(d.limit(1).withColumn("text", F.lit(None).cast("string"))), model, "doc_id", "text").collect()
    assert {round(r["__score"], 9) for r in odd if not r["text"]} == {round(model.prior, 9)}
    flat = quality.train(none, labels.where("false"), "doc_id", "text", "quality")
    assert quality.classify(d, flat, "doc_id", "text").select("__score").distinct().count() == 1
    assert quality.classify(none, flat, "doc_id", "text").count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 3])
    got = quality.marginals(e, first, t)
    for a, b in ((0, 3), (3, 7)):
        total, good = 0.0, np.zeros(b - a)
        for code in range(1 << (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            p = math.exp(sum(v * e[a + k] for k, v in enumerate(y)) + sum(t[u, v] for u, v in zip(y, y[1:], strict=False)))
            total += p
            good += p * np.array(y)
        assert got[a:b] == pytest.approx(good / total)


def removed_by_window(rows, units, window):
    seen = Counter()
    for _, t in rows:
        u = units(t)
        for k in range(len(u) - window + 1):
            seen[tuple(u[k : k + window])] += 1
    out = []
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if seen[tuple(u[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, u, gone))
    return out


@pytest.mark.parametrize("most", [512, 2])
def test_substring_dedup(docs, monkeypatch, most):
    original = recurrence.recurring_spans
    monkeypatch.setattr(recurrence, "recurring_spans", lambda *a: original(*a, most=most))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(((i, len(u), sum(g), hashlib.sha256(" ".join(w for w, x in zip(u, g, strict=True) if not x).encode()).hexdigest()) for i, u, g in removed_by_window(rows, words, 35)), key=repr)
    got = substring_dedup.dedup(docs, "text")
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=repr) == want
    assert sum(w[2] for w in want) > 1000
    kept = {(r["doc_id"], r["text"]): r["kept"] for r in substring_dedup.dedup(docs, "text", digests=False).collect()}
    for i, u, g in removed_by_window(rows, words, 35):
        t = next(t for j, t in rows if j == i and words(t) == u)
        assert words(kept[i, t]) == [w for w, x in zip(u, g, strict=True) if not x]
        assert any(g) or kept[i, t] == t


@pytest.mark.parametrize("most", [512, 2])
def test_suffix_dedup(docs, monkeypatch, most):
    original = recurrence.recurring_spans
    monkeypatch.setattr(recurrence, "recurring_spans", lambda *a: original(*a, most=most))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = []
    for i, u, g in removed_by_window(rows, lambda t: (t or "").encode(), 100):
        want.append((i, len(u), sum(g), sum(a and not b for a, b in zip(g, [False, *g], strict=False)), hashlib.sha256(bytes(b for b, x in zip(u, g, strict=True) if not x)).hexdigest()))
    got = suffix_dedup.dedup(docs, "text", 100, 20)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_maximal_repeats():
    a = [b"xxabcdefghyy", b"zzabcdefghyq", b"abcdefgh", b"qqqq"]
    s = recurrence.stretches_of(a, recurrence.byte_items, 6)
    got = {(n, tuple(sorted(p.tolist()))) for n, p in suffix_dedup.maximal_repeats(s, 6)}
    assert (8, (2, 14, 24)) in got
    assert (9, (2, 14)) in got
    assert all(n >= 6 for n, _ in got)


def test_sentencepiece(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = piece_bpe.encode_documents(docs, "doc_id", "text", path, digests=False).collect()
    want = []
    for r in docs.collect():
        ids = lib.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), tuple(ids), lib.decode(ids)))
    assert sorted(((r["id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcdeth  \n\t▁éñ😀<s>0123.!\r") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for t, (n, ids, back) in zip(texts, piece_bpe.Encoder(path).encode(texts), strict=True):
        w = lib.encode(t)
        assert (n, ids, back) == (len(w), ",".join(map(str, w)), lib.decode(w))


def test_ball_tree(spark, duck):
    same(Q.op8_exact_top_k(spark, DATA), duck.sql(Q.OP8_SQL))
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, []), (205, [1.0]), (None, [1.0] * 4), (7, [2.0] * 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = [(i, np.pad(np.floor(256 * np.array(v, float)), (0, 4 - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted(ok, key=lambda r: (r[0], r[1].tolist())):
        if i % 7 == 0:
            asked.setdefault(i, v)
    want = set()
    for i, v in asked.items():
        top = sorted(((-int(v @ w), j) for j, w in ok if j != i))[:5]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(top)}
    got = ball_tree.top_k(d, d.where("vec_id % 7 = 0"), "vec_id", "embedding", block=10)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()} == want
    assert ball_tree.top_k(d.where("vec_id = 14"), d.where("vec_id = 14"), "vec_id", "embedding").count() == 0


def test_language_model(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens = [[*words((t or "").translate(LOWER)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i, _ in rows]
    uni, big = Counter(), Counter()
    for w, h in zip(tokens, held, strict=True):
        if h:
            uni.update(w)
            big.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    base = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    got = ngram_lm.score_documents(docs, "doc_id", "text").collect()
    want = sorted((repr(i), len(w), sum(uni[x] > 0 for x in w), h == 0, round(sum(math.log10(base(x)) for x in w), 6)) for (i, _), w, h in zip(rows, tokens, held, strict=True))
    assert sorted((repr(r["id"]), r["n_tokens"], r["n_known"], r["held_out"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert all(r["score"] < 0 for r in got)
    train = [r for r in got if not r["held_out"]]
    assert sum(r["score"] for r in train) > sum(r["base_score"] for r in train)
    weight = ngram_lm.learned_weights(np.zeros((ngram_lm.BUCKETS, ngram_lm.MOST_BIN - ngram_lm.LEAST_BIN + 1)))
    assert ((weight > 0) & (weight < 1)).all()
    assert ngram_lm.score_documents(none, "doc_id", "text").count() == 0


def first_fit(sizes):
    room = []
    for n in sorted(sizes, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(1024 - n)
        else:
            room[at] -= n
    return len(room)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = []
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = packing.best_fit_packing(docs, "doc_id", "text", path).collect()
    assert sorted(((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in filled.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    assert len(filled) <= first_fit([r["length"] for r in got])
    assert packing.best_fit_packing(none, "doc_id", "text", path).count() == 0


def test_plans_hold_every_item():
    rng = np.random.default_rng(0)
    for n, draw in ((1, lambda: rng.integers(1, 1025, 1)), (2000, lambda: rng.integers(1, 1025, 2000)), (300, lambda: rng.integers(500, 530, 300)), (3000, lambda: np.minimum(1024, rng.lognormal(5.5, 1, 3000).astype(int) + 1))):
        size = draw()
        counts = np.bincount(size, minlength=1025)
        back, used = np.zeros(1025, int), 0
        for times, lengths in packing.plan(counts):
            assert times > 0
            assert sum(lengths) <= 1024
            used += times
            np.add.at(back, lengths, times)
        assert (back == counts).all()
        assert used <= first_fit(size.tolist())
        assert n == len(size)


def test_empty_tables(spark, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert jaccard_join.jaccard_groups(none, "doc_id", "text").count() == 0
    assert jaccard_join.one_of_each(none, "doc_id", "text").count() == 0
    assert fingerprint.edited_neighbours(none, "doc_id", "text").count() == 0
    assert line_dedup.line_dedup(none, "text", F.col("source")).count() == 0
    assert substring_dedup.dedup(none, "text").count() == 0
    assert suffix_dedup.dedup(none, "text").count() == 0
    assert piece_bpe.encode_documents(none, "doc_id", "text", path).count() == 0
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ball_tree.top_k(e, e, "vec_id", "embedding").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    passage = text(70)
    good, near = text(150), None
    near = good.replace(" ", " ", 1) + " end"
    planted = [(10_000, good), (10_001, near), (10_002, text(60) + "\n" + passage), (10_003, passage + "\n" + text(60)), (10_004, "HEY!! BUY!! NOW!! " * 30), (10_005, None), (10_006, "")]
    extra = spark.createDataFrame([(i, t, "en", "x", None if t is None else len(t)) for i, t in planted], d.schema)
    d.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = {r["doc_id"]: r for r in now.collect()}
    assert 10_004 not in seen["quality classifier"]
    assert {10_000, 10_001, 10_005, 10_006} <= set(seen["quality classifier"])
    assert set(seen["line dedup"]) == set(seen["quality classifier"])
    assert 10_000 in seen["n-gram Jaccard join"]
    assert 10_001 not in seen["n-gram Jaccard join"]
    kept = seen["substring dedup"]
    assert set(kept) == set(seen["n-gram Jaccard join"])
    assert passage.split()[40] + " " + passage.split()[41] not in kept[10_002]["text"]
    assert kept[10_000]["text"] == good
    assert {r["doc_id"] for r in now.collect()} == set(kept)
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_line_dedup_deals_out_large_hosts(spark, monkeypatch):
    """Beyond the bound of what is sent to all, pages meet the lines by host, large hosts over several tasks; results are the same."""
    rows = [(k, "a" if k < 60 else f"h{k % 7}" if k % 5 else None, f"menu\nbody {k}\nfoot") for k in range(90)] + [(5, "a", None), (5, "a", ""), (7, None, "menu"), (7, None, "menu")]
    pages = spark.createDataFrame(rows, "i int, host string, t string").withColumn("__boiler", F.lit("x")).withColumn("__host", F.lit("y")).withColumn("n", F.lit(1))
    run = lambda: sorted((tuple(r) for r in line_dedup.line_dedup(pages, "t", F.col("host"), counts=("n", "gone")).collect()), key=repr)
    whole = run()
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    monkeypatch.setattr(line_dedup, "SHARES", 10)
    assert run() == whole
    assert line_dedup.line_dedup(pages, "t", F.col("host"), counts=("n", "gone")).columns == ["i", "host", "t", "__boiler", "__host", "n", "gone"]
    assert sum(r[-1] for r in whole) >= 120


def test_ball_tree_with_foreign_queries(spark):
    """Queries that no row of the table equals, with other columns about, values that doubles can't hold, and ties."""
    rng = np.random.default_rng(1)
    for big in (1, 10**9):
        rows = [(i, (rng.integers(-(2**20), 2**20, 5) * float(big)).tolist(), "x", 1) for i in range(300)]
        d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, score int")
        q = [(10_000 + i, (rng.integers(-(2**20), 2**20, 5) * float(big) / 2**20).tolist()) for i in range(10)]
        asked = spark.createDataFrame(q, "vec_id long, embedding array<double>")
        whole = lambda v: [int(math.floor(256 * x)) for x in v]
        want = set()
        for i, v in q:
            top = sorted((-sum(a * b for a, b in zip(whole(v), whole(w), strict=True)), j) for j, w, _, _ in rows)[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(top)}
        if any(abs(s) >= 2**63 for *_, s in want):
            continue
        got = ball_tree.top_k(d, asked, "vec_id", "embedding", block=4)
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()} == want
    ends = spark.createDataFrame([(1, [1e300, 1e300]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ball_tree.top_k(ends, ends, "vec_id", "embedding").collect()}
    assert got == {(1, 2): -(2**63), (2, 1): -(2**63)}


def test_products_are_exact():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**30), 2**30, (50, 6)).astype(float), rng.integers(-(2**30), 2**30, 6).astype(float)
    assert ball_tree.products(a, b).tolist() == [sum(int(x) * int(y) for x, y in zip(r, b, strict=True)) for r in a]


def test_sentencepiece_long_words():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    model = piece_bpe.Model(path)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "a", "ab", "etaoin shr", "=-.*", "é日a"):
        for n in (1, 7, 300, 2500, 32_000):
            t = "".join(rng.choice(letters) for _ in range(n)).strip() or "a"
            (k, ids, back), want = next(iter(piece_bpe.Encoder(path).encode([t]))), lib.encode(t)
            assert (k, ids, back) == (len(want), ",".join(map(str, want)), lib.decode(want))
            if n <= 300:
                word = piece_bpe.BLANK + t.replace(" ", piece_bpe.BLANK)
                assert model._heaped(word) == model._rounds([word])[0]


def test_language_model_scores(docs, monkeypatch):
    """score by brute force for given weights; the weights that EM learns from bins against EM on the ratios themselves."""
    weight, seen = 0.2 + 0.02 * np.arange(ngram_lm.BUCKETS), []
    learned = ngram_lm.learned_weights
    monkeypatch.setattr(ngram_lm, "learned_weights", lambda h: (seen.append(h), weight)[1])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens = [[*words((t or "").translate(LOWER)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i, _ in rows]
    uni, big, begin = Counter(), Counter(), ("begin",)
    for w, h in zip(tokens, held, strict=True):
        if h:
            uni.update(w)
            big.update(zip([begin, *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    times = {**uni, begin: uni[None]}
    bucket = lambda c: min(ngram_lm.BUCKETS - 1, int(math.log2(c + 1)))
    want = []
    for (i, _), w, h in zip(rows, tokens, held, strict=True):
        score = 0.0
        for c, x in zip([begin, *w], w, strict=False):
            before = times.get(c, 0)
            b = weight[bucket(before)] if before else 0
            score += math.log10(b * big[c, x] / max(before, 1) + (1 - b) * (uni[x] + 0.1) / (n + 0.1 * (v + 1)))
        want.append((repr(i), len(w), h == 0, round(score, 6)))
    got = ngram_lm.score_documents(docs, "doc_id", "text").collect()
    assert sorted((repr(r["id"]), r["n_tokens"], r["held_out"], round(r["score"], 6)) for r in got) == sorted(want)
    ratios = defaultdict(list)
    for w, h in zip(tokens, held, strict=True):
        for c, x in zip([begin, *w], w, strict=False) if h == ngram_lm.TUNING else ():
            if times[c] > 1:
                ratios[bucket(times[c] - 1)].append((big[c, x] - 1) / (times[c] - 1) / ((uni[x] - 0.9) / (n - 1 + 0.1 * (v + 1))))
    fitted = learned(seen[0])
    assert seen[0].sum() == sum(map(len, ratios.values())) > 100
    for k, r in ratios.items():
        x, b = np.array(r), 0.5
        for _ in range(100):
            b = min(1 - 1e-6, max(1e-6, ((b * x / (b * x + 1 - b)).sum() + 0.5) / (len(x) + 1)))
        assert fitted[k] == pytest.approx(b, abs=0.02)


def test_fingerprints_by_brute_force(docs):
    """Fingerprints and both likenesses of every row, from sums of hashed paragraphs in Python."""
    import struct

    import xxhash

    def sums(text):
        parts = [p for p in re.split(r"\n+|(?<=[.!?])\s+", text, flags=re.ASCII) if p]
        out = [len(parts)] + [0] * 40
        for p in parts:
            for seed in range(2):
                h = xxhash.xxh64(struct.pack("<i", seed), seed=xxhash.xxh64(p.encode(), seed=42).intdigest()).intdigest()
                for j in range(20):
                    k = 1 + 20 * seed + j
                    out[k] = (out[k] + (h >> j & fingerprint.MASK)) & fingerprint.MOD
        return out

    def like(a, b):
        if a == b:
            return 1.0
        x, y = (np.array([2 * (w >> 20 * i & 0xFFFFF) - s[0] for w in s[1:] for i in range(3)], float) for s in (a, b))
        norm = math.sqrt((x @ x) * (y @ y))
        return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0

    named = lambda s: "".join(f"{w:015x}" for w in s)
    rows = sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.collect())
    want = []
    for k, (i, t) in enumerate(rows):
        nxt, h = rows[(k + 1) % len(rows)][1], len(t) // 2
        a, b, c = sums(t), sums(t[: len(t) - h] + nxt[:h]), sums(nxt)
        want.append((i, named(a), named(b), round(like(a, b), 9), round(like(a, c), 9)))
    got = fingerprint.edited_neighbours(docs, "doc_id", "text").collect()
    assert sorted((-(2**63) if r["id"] is None else r["id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == sorted(want)


def test_fingerprints_in_the_order_of_any_ids(spark):
    """Ids of text, with a common start, repeats, an empty one and nulls; then times; and no rows."""
    rng = random.Random(8)
    ids = [f"document-{rng.randrange(10**6)}" for _ in range(120)] + ["document-5"] * 4 + ["", None, None, "é", "Z"]
    rows = [(i, f"text {k} " + "ab" * rng.randrange(6)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r["edited_sha256"] for r in fingerprint.edited_neighbours(df, "doc_id", "text").collect()) == want
    times = df.select((F.lit("2024-01-01").cast("date") + F.length("text")).alias("doc_id"), "text")
    assert fingerprint.edited_neighbours(times, "doc_id", "text").count() == len(rows)
    assert fingerprint.edited_neighbours(df.where("false"), "doc_id", "text").collect() == []


def test_quality_scores_by_enumeration(spark):
    """Scores of a fixed model against sums over all labellings of the lines."""
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=(quality.WIDTH, 3)) * 0.3, rng.normal(size=(2, 2)), 0.1, 1.3, -0.2, 0.4)
    texts = ["One line.", "A b c\nBUY!! NOW 100%\n\n  \nand the last", "x\n" * 6, "é日 1\n|||\nThe end.\nthe end. the end.", "", None, " \n "]
    d = spark.createDataFrame([(i, t, "mine", 3) for i, t in enumerate(texts)], "id int, t string, __score string, __predicted int")
    out = quality.classify(d, model, "id", "t")
    assert out.columns == ["id", "t", "__score", "__predicted"]
    got = {r["id"]: r["__score"] for r in out.collect()}
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        x = quality.lines_of(raw, np.array([0, len(raw)]))
        if not len(x.start):
            assert got[i] == model.prior
            continue
        e, n = quality.features(x) @ model.weights, len(x.start)
        odds = [e[k, 1] + (e[k - 1, 0] if k else 0) + (e[k + 1, 2] if k + 1 < n else 0) + model.bias for k in range(n)]
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            p = math.exp(sum(a * b for a, b in zip(y, odds, strict=True)) + sum(model.transitions[u, v] for u, v in zip(y, y[1:], strict=False)))
            total, good = total + p, good + p * np.array(y)
        m = float((good / total) @ (x.end - x.start) / (x.end - x.start).sum())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(1.3 * math.log(m / (1 - m)) - 0.2))), rel=1e-6)
    kept = quality.good(d, model, "id", "t").collect()
    assert {r["id"] for r in kept} == {i for i, s in got.items() if s >= quality.THRESHOLD}
    assert {r["__score"] for r in kept} <= {"mine"}


def test_training_is_bounded():
    line = b"Some words in a line.\n"
    raw = np.frombuffer(line * 1000 + line, np.uint8)
    x = quality.lines_of(raw, np.array([0, 1000 * len(line), 1001 * len(line)]))
    thin = quality._thinned(x, 2)
    assert np.bincount(thin.row).tolist() == [quality.CHAIN * quality.CHAINS, 1]
    assert thin.start.max() > 1000 * len(line) - 1


def test_crowded_sets_share_a_bucket():
    """Sets with more parts without shingles than are spared still meet, in small ranges and in large ones."""
    ranges = jaccard_join.Ranges((85, 100))
    rng = np.random.default_rng(5)
    for n in (20, 300, 3000):
        same = np.full(n, 7 << 20, np.uint64) | rng.integers(0, 1 << 20, n).astype(np.uint64)  # all in one part
        other = same.copy()
        other[:1] = rng.integers(0, 1 << 20, 1).astype(np.uint64) | np.uint64(7 << 20)
        row, sig = jaccard_join.signatures(np.repeat([0, 1], n), np.concatenate([same, other]), 2, ranges)
        assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


@pytest.mark.parametrize(("block", "sketched"), [(3, 2)])
def test_blocks_across_components(docs, block, sketched, monkeypatch):
    """Components when buckets are cut into many blocks and sketches are compared across several of them."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SKETCHED", sketched)
    monkeypatch.setattr(jaccard_join, "GATHERED", 50)
    test_jaccard_groups.__wrapped__(docs, 5, (80, 100)) if hasattr(test_jaccard_groups, "__wrapped__") else test_jaccard_groups(docs, 5, (80, 100))


def test_very_long_texts(spark):
    """A text of a million characters, and one of as many without a blank, twice, beside short ones."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long, solid = " ".join(rng.choice(vocab) for _ in range(170_000)), "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    rows = [(0, long), (1, long + " more"), (2, solid), (3, solid), (4, "short"), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_groups(d, "doc_id", "text").collect()}
    assert [got[i]["component_id"] for i in range(6)] == [0, 0, 2, 2, 4, 5]
    w = {r["doc_id"]: r for r in substring_dedup.dedup(d, "text").collect()}
    assert (w[0]["n_removed"], w[1]["n_removed"], w[2]["n_removed"]) == (170_000, 170_000, 0)
    b = {r["doc_id"]: r for r in suffix_dedup.dedup(d, "text").collect()}
    assert [b[i]["n_removed"] for i in range(5)] == [len(long), len(long), 1_000_000, 1_000_000, 0]
    assert [b[i]["n_spans"] for i in range(5)] == [1, 1, 1, 1, 0]
    f = {r["id"]: r for r in fingerprint.edited_neighbours(d, "doc_id", "text").collect()}
    assert f[2]["fingerprint"] == f[3]["fingerprint"]
    s = {r["id"]: r for r in ngram_lm.score_documents(d, "doc_id", "text").collect()}
    assert s[0]["n_tokens"] == 170_001
    p = packing.best_fit_packing(d, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")).groupBy("id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert max(r["most"] for r in p) == 1024
    n = {r["id"]: r["n"] for r in p}
    assert n[2] == n[3] > 100_000
    e = {r["id"]: r for r in piece_bpe.encode_documents(d, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert e[2]["ids_sha256"] == e[3]["ids_sha256"]
    assert e[2]["decoded_sha256"] == hashlib.sha256(solid.encode()).hexdigest()
    assert line_dedup.line_dedup(d, "text", F.lit("h")).count() == 6
    model = quality.Model(np.zeros((quality.WIDTH, 3)), np.zeros((2, 2)), 0.0, 1.0, 0.0, 0.5)
    assert quality.classify(d, model, "doc_id", "text").count() == 6


def test_pipeline_corner_cases(spark, tmp_path):
    """No documents at all; then nulls in every column, repeated rows, and columns with the names of the stages' own."""
    import corpus_pipeline

    d, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    for k, docs in enumerate((d.where("false"), d.where("doc_id % 10 = 0"))):
        odd = spark.createDataFrame([(None, None, None, None, None), (None, "a lonely text without id", None, None, None), (3, "", None, "s", 0), (3, "", None, "s", 0)], d.schema)
        own = (docs.unionByName(odd) if k else docs).withColumn("__score", F.lit("s")).withColumn("__host", F.lit(None).cast("int")).withColumn("key", F.lit(1)).withColumn("n_words", F.lit(2)).withColumn("kept", F.lit("k"))
        now = own
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, DATA)
            assert now.columns == own.columns, name
            assert set(now.select("__score").distinct().toPandas()["__score"]) <= {"s"}
        packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
        assert packed.where("piece = 0").count() == now.count()
        assert now.count() >= 3 * k
        assert labels.count() > 0


def test_clear_and_shared_folder(spark, docs):
    from dyadspark.llm import common

    common.clear(spark)
    assert suffix_dedup.dedup(docs, "text", 100, 20).count() == docs.count()
    tables = {t.name for t in spark.catalog.listTables()}
    assert any(t.startswith("texts_") for t in tables)
    assert common.clear(spark) > 1
    assert not any(t.name.startswith("texts_") for t in spark.catalog.listTables())

    with common.owned(spark, "one", docs):
        kept = common.written(docs, "kept")
        common.written(docs, "gone")
    with common.owned(spark, "two", docs):
        common.written(docs, "others")
    with common.owned(spark, "one", kept.where("id > 0")):  # what is still read stays, as does what others own
        assert kept.count() == docs.count()
        assert {(w.rsplit("/", 1)[1][:4], o) for _, w, o in common._left(spark)} == {("kept", "one"), ("othe", "two")}
    assert common.clear(spark) == 2

    class Conf:
        def __init__(self, master):
            self.conf = {"spark.master": master}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Conf("yarn"))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Conf("local-cluster[3,2,1024]"))
    assert common.shared_dir(Conf("local[2]"))
