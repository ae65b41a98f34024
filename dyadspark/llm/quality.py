"""A linear-chain conditional random field over lines, for document quality.

Every line is labelled good or bad. A line's evidence comes from its own shape and that of the lines before and after it:
frequencies of pairs of neighbouring character classes, and in bins its length, shares of character classes, words said
again at once, and repetition. Weights and transitions
are fitted to documents with known quality, each of whose lines takes its document's label. A document's score is the mean
over its lines, weighted by length, of the forward-backward marginal of good, put through a logistic fit to the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import fold, numbered
from dyadspark.llm.textvec import Words, slices

#: Most labelled documents that the model is fitted on, the least by hash of their id; lines a training chain, at most; and
#: chains of a training document, spread evenly over it.
SAMPLE, CHAIN, CHAINS = 3000, 64, 2
THRESHOLD = 0.3
#: Character classes of UTF-8 bytes: other letters of words, white space, upper case, digits, and punctuation by kind.
CLASS = np.full(256, 15, np.uint8)
for _k, _set in enumerate([range(97, 123), [32, 9, 11, 12, 13], range(65, 91), range(48, 58), b".", b",", b"!?", b"|", b"*", b"$%", b"#&", b"'\"-:;", b"()[]{}<>", b"/\\@_=+~^`", range(128, 256)]):
    for _b in _set:
        CLASS[_b] = _k
N_CLASS, N_BIN = 16, 8
PAIRS = N_CLASS * N_CLASS
BINNED = 8
WIDTH = PAIRS + BINNED * N_BIN


@dataclass
class Lines:
    """start, end: byte places of lines that hold more than white space; row: of their text; pair: class pairs by byte."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    pair: np.ndarray
    bins: np.ndarray


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> Lines:
    cls = CLASS[raw].astype(np.int32)
    cls[raw == 10] = 1
    pair = np.zeros(len(raw), np.int32)
    if len(raw):
        pair[1:] = cls[:-1] * N_CLASS + cls[1:]
    breaks = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(raw)]
    stop = np.unique(np.concatenate([offsets[1:], breaks]))
    start = start[raw[start] != 10]
    end = stop[np.searchsorted(stop, start, "right")]
    count = lambda hit: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(hit)]))
    blank = count(cls == 1)
    some = end - start > blank
    start, end = start[some], end[some]
    if not len(start):
        return Lines(raw, start, end, np.zeros(0, np.int64), pair, np.zeros((0, BINNED), np.int64))
    n = (end - start).astype(float)
    words = count(cls == 1) + 1.0
    share = lambda hit, of: np.minimum(N_BIN - 1, np.ceil(np.log2(1 + 127 * np.minimum(1, count(hit) / of)))).astype(int)
    row = np.searchsorted(offsets, start, "right") - 1
    said = Words(raw, offsets)
    line = np.searchsorted(start, said.start, "right") - 1
    again = np.zeros(len(line), bool)
    for back in (1, 2):
        again[back:] |= (said.h[0][back:] == said.h[0][:-back]) & (line[back:] == line[:-back])
    echo = np.bincount(line[again], minlength=len(start)) / np.maximum(1, np.bincount(line, minlength=len(start)))
    # lines of one text with the same length and the same bytes at three places count as repeated
    key = row * 1_000_003 + (end - start) * 7919 + raw[start].astype(np.int64) * 31 + raw[(start + end) // 2].astype(np.int64) * 257 + raw[end - 1]
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    per = np.bincount(row, minlength=len(offsets) - 1)[row]
    bins = np.stack(
        [
            np.minimum(N_BIN - 1, np.log2(n).astype(int)),
            share(cls == 2, n),
            share((cls >= 6) & (cls <= 13), n),
            share(cls == 3, n),
            np.minimum(N_BIN - 1, (n / words / 2).astype(int)),
            np.minimum(N_BIN - 1, np.log2(times[back]).astype(int)),
            np.minimum(N_BIN - 1, np.log2(per).astype(int)),
            np.minimum(N_BIN - 1, (echo * N_BIN).astype(int)),
        ],
        1,
    )
    return Lines(raw, start, end, row, pair, bins)


def _thinned(x: Lines, rows: int) -> Lines:
    """Of texts with more than CHAINS chains of lines, CHAINS of them, the first and others at even distances."""
    first = np.searchsorted(x.row, np.arange(rows + 1))
    n = np.diff(first)[x.row]
    chain, chains = (np.arange(len(x.row)) - first[x.row]) // CHAIN, -(-n // CHAIN)
    keep = (chains <= CHAINS) | (chain * CHAINS // np.maximum(chains, 1) != (chain - 1) * CHAINS // np.maximum(chains, 1))
    return Lines(x.raw, x.start[keep], x.end[keep], x.row[keep], x.pair, x.bins[keep])


def features(x: Lines) -> np.ndarray:
    """A row for each line: frequencies of class pairs, then one-hot bins."""
    out = np.zeros((len(x.start), WIDTH), np.float32)
    for i, (a, b) in enumerate(zip(x.start, x.end, strict=True)):
        out[i, :PAIRS] = np.bincount(x.pair[a:b], minlength=PAIRS) * (8 / (b - a))
        out[i, PAIRS + np.arange(BINNED) * N_BIN + x.bins[i]] = 1
    return out


def evidence(x: Lines, w: np.ndarray) -> np.ndarray:
    """features(x) @ w without the features: w (WIDTH, k)."""
    n = len(x.start)
    if not n:
        return np.zeros((0, w.shape[1]))
    out = np.empty((n, w.shape[1]))
    cut = np.empty(2 * n, np.int64)
    cut[0::2], cut[1::2] = x.start, x.end
    for k in range(w.shape[1]):
        v = np.append(w[:PAIRS, k][x.pair], 0.0)
        out[:, k] = np.add.reduceat(v, cut)[0::2] * 8 / (x.end - x.start)
    return out + w[PAIRS + np.arange(BINNED) * N_BIN + x.bins].sum(1)


def chained(e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds of good at each line from its own (column 1) and its neighbours' evidence (0: of the next line's past, 2)."""
    out = e[:, 1].copy()
    inner = np.ones(len(e), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    out[at] += e[at - 1, 0]
    out[at - 1] += e[at, 2]
    return out


def _step(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds that reach the next line through transitions t[from, to]."""
    return np.logaddexp(r + t[1, 1], t[0, 1]) - np.logaddexp(r + t[1, 0], t[0, 0])


def marginals(e: np.ndarray, first: np.ndarray, t: np.ndarray) -> np.ndarray:
    """P(good) of each line by forward-backward; e: log odds; first: where each chain begins. Chains advance together."""
    size = np.diff(np.append(first, len(e)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    fwd, bwd = e.copy(), np.zeros(len(e))
    alive = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
    for i in range(1, len(alive)):
        at = first[: alive[i]] + i
        fwd[at] += _step(fwd[at - 1], t)
    last = first + size - 1
    for i in range(1, len(alive)):
        at = last[: alive[i]] - i
        bwd[at] = _step(e[at + 1] + bwd[at + 1], t.T)
    return 1 / (1 + np.exp(-np.clip(fwd + bwd, -50, 50)))


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray
    bias: float
    scale: float
    shift: float
    prior: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One score for each text; a text without lines gets the share of good documents among the labels."""
        x = lines_of(raw, offsets)
        out = np.full(len(offsets) - 1, self.prior)
        if len(x.start):
            first = np.flatnonzero(np.concatenate([[True], x.row[1:] != x.row[:-1]]))
            p = marginals(chained(evidence(x, self.weights), first) + self.bias, first, self.transitions)
            out[x.row[first]] = self.scaled(_mean(p, x.end - x.start, first))
        return out

    def scaled(self, m: np.ndarray) -> np.ndarray:
        m = np.clip(m, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.scale * np.log(m / (1 - m)) + self.shift, -30, 30)))


def _mean(p: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(p * length, first) / np.add.reduceat(length, first)


def fit(docs: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 160, rate: float = 0.15, decay: float = 1e-5) -> Model:
    """docs: (label, features of lines, lengths). Adam on the mean conditional log likelihood of chains, from zero."""
    labels = np.array([y for y, _, _ in docs], float)
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    lines = [(y, f, n) for y, f, n in docs if len(f)]
    weights, t, bias = np.zeros((WIDTH, 3)), np.zeros((2, 2)), np.zeros(1)
    if not lines:
        return Model(weights, t, 0.0, 1.0, 0.0, prior)
    feats = np.concatenate([f for _, f, _ in lines]).astype(np.float32)
    whole = np.cumsum([0] + [len(f) for _, f, _ in lines])[:-1]
    first, label = [], []
    for (y, f, _), at in zip(lines, whole, strict=True):
        first += range(at, at + len(f), CHAIN)
        label += [y] * len(range(0, len(f), CHAIN))
    first, label = np.array(first), np.array(label)
    size = np.diff(np.append(first, len(feats)))
    wide = int(size.max())
    grid = np.minimum(first[:, None] + np.arange(wide), len(feats) - 1)
    live = np.arange(wide) < size[:, None]
    params = [weights, t, bias]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for k in range(1, rounds + 1):
        e = chained((feats @ weights.astype(np.float32)).astype(float), first) + bias
        g = np.where(live, e[grid], 0.0)
        # alpha, beta over two labels; label 0 has no evidence
        alpha, beta = np.zeros((*g.shape, 2)), np.zeros((*g.shape, 2))
        alpha[:, 0, 1] = g[:, 0]
        for i in range(1, wide):
            for y in (0, 1):
                alpha[:, i, y] = np.where(live[:, i], np.logaddexp(alpha[:, i - 1, 0] + t[0, y], alpha[:, i - 1, 1] + t[1, y]) + y * g[:, i], alpha[:, i - 1, y])
        for i in range(wide - 2, -1, -1):
            for y in (0, 1):
                beta[:, i, y] = np.where(live[:, i + 1], np.logaddexp(t[y, 0] + beta[:, i + 1, 0], t[y, 1] + g[:, i + 1] + beta[:, i + 1, 1]), 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * live
        d_e = np.zeros(len(feats))
        d_e[grid[live]] = (label[:, None] * live - p1)[live]
        d_t = np.zeros((2, 2))
        inner = live[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(alpha[:, :-1, a] + t[a, b] + b * g[:, 1:] + beta[:, 1:, b] - z[:, None])
                d_t[a, b] = (((label[:, None] == a) & (a == b)) * inner - pair * inner).sum()
        keep = np.ones(len(feats), bool)
        keep[first] = False
        past, future = np.zeros(len(feats)), np.zeros(len(feats))
        at = np.flatnonzero(keep)
        past[at - 1], future[at] = d_e[at], d_e[at - 1]
        n = len(docs)
        grads = [(feats.T @ np.stack([past, d_e, future], 1).astype(np.float32)).astype(float) / n - decay * weights, d_t / n - decay * t, np.array([d_e.sum() / n])]
        for p, d, (m, v) in zip(params, grads, state, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = Model(weights, t, float(bias[0]), 1.0, 0.0, prior)
    e = chained((feats @ weights.astype(np.float32)).astype(float), whole) + bias
    m = np.clip(_mean(marginals(e, whole, t), np.concatenate([n for _, _, n in lines]), whole), 1e-6, 1 - 1e-6)
    model.scale, model.shift = _logistic(np.log(m / (1 - m)), np.array([y for y, _, _ in lines], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below zero) and intercept of a ridged logistic fit by Newton's method."""
    w = np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 0.01 * len(y) * (w - [1.0, 0.0])
        w = w + np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 0.01 * len(y) * np.eye(2), grad)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, folds: int = 5) -> Model:
    """Fits to at most `sample` labelled documents outside fold 0 by crc32 of their id; features are made on the executors.

    A document gives CHAINS * CHAIN lines at most, so what reaches the driver is bounded by the parameters. Every line takes
    its document's label, there being no others: the chain learns that neighbouring lines go together, and which lines are bad
    in good documents only as far as bad documents show it.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (fold(F.col("id"), folds) != 0))
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # `sample` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column(1)):
                x = lines_of(raw, offsets)
                x = _thinned(x, b - a)
                f, n, cut = features(x), (x.end - x.start).astype(np.int64), np.searchsorted(x.row, np.arange(b - a + 1))
                cols = [[f[i:j].astype(np.float16).tobytes() for i, j in zip(cut, cut[1:], strict=False)], [n[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array(c, pa.binary()) for c in cols)], ["id", "y", "f", "n"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.select("id", "text", "y").mapInArrow(run, f"id {kind}, y int, f binary, n binary").collect()
    rows.sort(key=lambda r: (r.id, r.y, bytes(r.n), bytes(r.f)))
    return fit([(r.y, np.frombuffer(bytes(r.f), np.float16).reshape(-1, WIDTH), np.frombuffer(bytes(r.n), np.int64)) for r in rows])


def classify(docs: DataFrame, model: Model, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs with __score double and __predicted int (1 at the threshold or over). Null texts count as empty.

    Only the text is looked at. Empty texts and texts of white space get the share of good documents in the sample.
    Repeated rows get equal scores; an empty table gives none. Columns named __score and __predicted give way.
    """
    docs, names, (text_col,) = numbered(docs, text_col, added=("__score", "__predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores(raw, offsets) for _, _, raw, offsets in slices(batch.column(at))]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names, "__score", "__predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, __score double, __predicted int").toDF(*names, "__score", "__predicted")


def good(docs: DataFrame, model: Model, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model predicts to be good, with all their columns, whatever their names."""
    own, names, (i, text) = numbered(docs, id_col, text_col)
    return classify(own, model, i, text, threshold).where(F.col("__predicted") == 1).select(own.columns).toDF(*names)
