"""Deleted interpolation: a bigram language model learned from the corpus and applied to all of it.

p(w | c) = b * n(c w) / n(c) + (1 - b) * base(w), where the weight b belongs to the bucket of the context's frequency and
base(w) = (n(w) + 0.1) / (N + 0.1 (V + 1)). Weights come from expectation-maximisation over the tokens of one fold of the
training documents, each token's own occurrence deleted from all counts.

Counts never leave the executors. Texts are coded into batches, each batch sends its distinct keys once to the parts of the
key space, packed and with its own counts, and each part answers with the whole corpus's counts in the keys' order. Keys are
64-bit hashes of words and of pairs of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import fold, written
from dyadspark.llm.textvec import U, Words, in_parts, mix, packed, slices, unpacked

ADD, FOLDS, TUNING, BUCKETS = 0.1, 10, 1, 32
END, START = mix(np.array([0xE0D, 0x57A27], U))
#: Keys that a part of the key space holds, about, and the least number of parts (a power of two).
PART_KEYS, PARTS = 1_600_000, 64
#: Bytes of text in a coded batch: it sends a row to each part, so few and large ones keep rows few.
CODED = 6_000_000
STEP, LEAST_BIN, MOST_BIN = 8, -160, 320


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * U(0xC2B2AE3D27D4EB4F) + word)


def _coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each batch: ids and folds of its documents, their numbers of tokens, its words' hashes, and its tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng()
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column(2), CODED):
                words = Words(raw, offsets, lower=True)
                group = batch.column(1).slice(a, b - a).to_numpy()
                size = np.diff(words.first)
                tokens = np.insert(words.h[0], words.first[1:], END)
                row = np.repeat(np.arange(b - a), size + 1)
                for tuning in (False, True):
                    own = np.flatnonzero((group == TUNING) == tuning)
                    if not len(own):
                        continue
                    vocab, local = np.unique(tokens[np.isin(row, own)], return_inverse=True)
                    values = [
                        pa.array([int(rng.integers(2**62))]), pa.array([tuning]), pa.array([len(local)], pa.int64()), pa.array([len(vocab)], pa.int64()),
                        pa.array([batch.column(0).slice(a, b - a).take(pa.array(own)).to_pylist()], pa.list_(batch.column(0).type)),
                        pa.array([group[own].astype(np.int8).tobytes()], pa.binary()), pa.array([packed((size[own] + 1).astype(np.int32))], pa.binary()),
                        pa.array([packed(np.diff(vocab, prepend=U(0)))], pa.binary()), pa.array([packed(local.astype(np.uint32))], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(values, ["batch", "tuning", "n", "n_vocab", "ids", "folds", "sizes", "vocab", "tokens"])

    picked = docs.select(F.col(id_col).alias("id"), fold(F.col(id_col), FOLDS).cast("int").alias("fold"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"batch long, tuning boolean, n long, n_vocab long, ids array<{kind}>, folds binary, sizes binary, vocab binary, tokens binary")


class Batch:
    """A coded batch unpacked: token hashes, contexts, training flags, and its distinct words and pairs in key order."""

    def __init__(self, n: int, n_vocab: int, folds: bytes, sizes: bytes, vocab: bytes, tokens: bytes):
        self.folds = np.frombuffer(folds, np.int8)
        self.size = unpacked(sizes, np.int32, len(self.folds))
        with np.errstate(over="ignore"):
            self.words = np.cumsum(unpacked(vocab, U, n_vocab), dtype=U)
        self.word = unpacked(tokens, np.uint32, n).astype(np.int64)
        h = self.words[self.word]
        self.begin = np.cumsum(self.size) - self.size
        context = np.empty(n, U)
        context[1:] = h[:-1]
        context[self.begin] = START
        self.train = np.repeat(self.folds != 0, self.size)
        self.pairs, self.pair = np.unique(pair_keys(context, h), return_inverse=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training occurrences of its words and of its pairs."""
        return np.bincount(self.word[self.train], minlength=len(self.words)), np.bincount(self.pair[self.train], minlength=len(self.pairs))

    def looked_up(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the corpus's counts: of itself, of its context, of both."""
        own = words[self.word].astype(float)
        before = np.empty_like(own)
        before[1:] = own[:-1]
        end = words[np.searchsorted(self.words, END)]
        before[self.begin] = end  # as many documents begin as end
        return own, before, pairs[self.pair].astype(float)


_CODED = ("n", "n_vocab", "folds", "sizes", "vocab", "tokens")


def _batches(batch: pa.RecordBatch) -> Iterator[Batch]:
    cols = [batch.column(c) for c in _CODED]
    for i in range(batch.num_rows):
        yield Batch(*(c[i].as_py() for c in cols))


def _asked(coded: DataFrame, bits: int) -> DataFrame:
    """A row for each batch and each part of the key space that it has keys of: a batch's rows and work are bounded by its keys,
    however many parts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, x in zip(batch.column("batch").to_pylist(), _batches(batch), strict=True):
                rows = []
                sides = [(keys, n, in_parts(keys, bits)) for keys, n in zip((x.words, x.pairs), x.counts(), strict=True)]
                for part in sorted({p for _, _, cut in sides for p in cut}):
                    row = [part, name]
                    for keys, n, cut in sides:
                        i, j = cut.get(part, (0, 0))
                        row += [j - i, packed(np.diff(keys[i:j], prepend=U(0))), packed(n[i:j].astype(np.uint32))]
                    rows.append(row)
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "batch", "n1", "k1", "c1", "n2", "k2", "c2"])

    return coded.select("batch", *_CODED).mapInArrow(run, "part int, batch long, n1 int, k1 binary, c1 binary, n2 int, k2 binary, c2 binary")


def _answered(asked: DataFrame) -> DataFrame:
    """For each batch and part the corpus's counts; a row without batch has the part's training tokens and words."""

    def answer(part: int, rows: list[dict]) -> pa.RecordBatch:
        out: dict[str, list] = {"part": [part] * len(rows), "batch": [r["batch"] for r in rows]}
        for s in "12":
            with np.errstate(over="ignore"):
                keys = [np.cumsum(unpacked(r["k" + s], U, r["n" + s]), dtype=U) for r in rows]
            n = [unpacked(r["c" + s], np.uint32, r["n" + s]) for r in rows]
            _, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, np.concatenate(n)) if len(back) else np.zeros(0)
            cut = np.cumsum([0, *map(len, keys)])
            out["n" + s] = [len(k) for k in keys]
            out["c" + s] = [packed(total[back[i:j]].astype(np.int64)) for i, j in zip(cut, cut[1:], strict=False)]
            if s == "1":
                stats = int(total.sum()), int((total > 0).sum())
        last = {"part": part, "batch": None, "n1": 0, "c1": b"", "n2": 0, "c2": b""}
        cols = [pa.array([*out[c], last[c]], k) for c, k in (("part", pa.int32()), ("batch", pa.int64()), ("n1", pa.int32()), ("c1", pa.binary()), ("n2", pa.int32()), ("c2", pa.binary()))]
        none = [None] * len(rows)
        cols += [pa.array([*none, x], pa.int64()) for x in stats]
        return pa.RecordBatch.from_arrays(cols, ["part", "batch", "n1", "c1", "n2", "c2", "tokens", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["part"] != part:
                    yield answer(part, held)
                    held = []
                part = r["part"]
                held.append(r)
        if held:
            yield answer(part, held)

    dealt = asked.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "part int, batch long, n1 int, c1 binary, n2 int, c2 binary, tokens long, words long")


def _with_answers(coded: DataFrame, answers: DataFrame) -> DataFrame:
    lists = answers.where(F.col("batch").isNotNull()).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "n1", "c1", "n2", "c2"))).alias("answers"))
    return coded.join(lists, "batch")


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[int, Batch, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    for i, (x, answers) in enumerate(zip(_batches(batch), batch.column("answers").to_pylist(), strict=True)):
        found = [np.concatenate([unpacked(a["c" + s], np.int64, a["n" + s]) for a in answers]) for s in "12"]
        yield i, x, x.looked_up(*found)


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.log2(n + 1).astype(np.int64))


def _base(n: np.ndarray, tokens: int, words: int) -> np.ndarray:
    return (n + ADD) / (tokens + ADD * (words + 1))


def learned_weights(histogram: np.ndarray, rounds: int = 100) -> np.ndarray:
    """EM for each bucket's weight; histogram[b, k]: held-out tokens whose ratio of the two estimates falls in bin k."""
    ratio = np.exp2((np.arange(histogram.shape[1]) + LEAST_BIN) / STEP)
    ratio[0] = 0
    weight = np.full(BUCKETS, 0.5)
    n = histogram.sum(1)
    for _ in range(rounds):
        mine = weight[:, None] * ratio
        share = (histogram * mine / (mine + 1 - weight[:, None])).sum(1)
        weight = np.clip((share + 0.5) / (n + 1), 1e-6, 1 - 1e-6)
    return weight


def _histogram(joined: DataFrame, tokens: int, words: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = MOST_BIN - LEAST_BIN + 1
        total = np.zeros(BUCKETS * width, np.int64)
        for batch in batches:
            for _, _x, (own, before, both) in _counted(batch):
                one, context = _base(own - 1, tokens - 1, words), before - 1
                some = context > 0
                ratio = (both[some] - 1) / context[some] / one[some]
                place = np.where(ratio > 0, np.clip(np.round(np.log2(np.maximum(ratio, 1e-30)) * STEP), LEAST_BIN + 1, MOST_BIN), LEAST_BIN).astype(np.int64) - LEAST_BIN
                total += np.bincount(_bucket(context[some]) * width + place, minlength=BUCKETS * width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(BUCKETS * (MOST_BIN - LEAST_BIN + 1))
    for r in joined.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # BUCKETS times bins at most
        out[r["at"]] = r["n"]
    return out.reshape(BUCKETS, -1)


def score_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Fold 0 by crc32 of the id is never learned from. Null and empty texts are one end token. Repeated rows count as often as
    they stand there; null ids fall into the fold of an empty text. Without training documents both scores are those of the
    base with no counts.
    """
    coded = written(_coded(docs, id_col, text_col), "coded")
    size = coded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    bits = max(PARTS, 2 * int(size) // PART_KEYS).bit_length() - 1
    answers = written(_answered(_asked(coded, bits)), "counts")
    total = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    tokens, words = int(total.tokens), int(total.words)
    weight = learned_weights(_histogram(_with_answers(coded.where("tuning"), answers), tokens, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, (own, before, both) in _counted(batch):
                base = _base(own, tokens, words)
                b = np.where(before > 0, weight[_bucket(before)], 0)
                p = b * both / np.maximum(before, 1) + (1 - b) * base
                sums = [np.add.reduceat(v, x.begin) for v in ((own > 0).astype(np.int64), np.log10(base), np.log10(p))]
                cols = [batch.column("ids").slice(i, 1).flatten(), pa.array(x.folds == 0), pa.array(x.size.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(len(x.size), tokens)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _with_answers(coded, answers).mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
