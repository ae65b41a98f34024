"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The text's blanks become U+2581, with one put before it. No piece has that sign after another character, so texts are cut
before each run of it, and each such word merges by itself. Words not yet known to the worker are merged together as flat
arrays: each round finds every word's best rank, merges all pairs of that rank at once, of overlapping ones the leftmost, and
closes the gaps. That is exact while none of these merges makes a pair of an equal or better rank, which would come before the
rest; in words where one does, the leftmost merges alone. Words of over LONG characters are merged by a heap of pairs, since
rounds over them would cost the square of their length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
NORMAL, BYTE = 1, 6
NONE = np.iinfo(np.int64).max
#: Characters of a word that rounds merge, at most, and of a word that is kept.
LONG, KEPT = 2000, 100


class Model:
    """pieces: of a BPE model file; pair (a, b) of symbol numbers gives a rank and a symbol where the joined text is a piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not m.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback, an identity normalizer and a dummy prefix is needed")
        self.text = [p.piece for p in m.pieces]
        kinds = [p.type for p in m.pieces]
        self.byte_of = {i: int(t[3:5], 16) for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == BYTE}
        self.byte_id = np.zeros(256, np.int64)
        for i, b in self.byte_of.items():
            self.byte_id[b] = i
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == NORMAL}
        if any(BLANK in t.lstrip(BLANK) for t in self.id):
            raise ValueError("a piece spans words")
        # ranks: higher scores first; equal scores are equal ranks, so that the leftmost wins
        scores = sorted({m.pieces[i].score for i in self.id.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(len(self.text), NONE)
        for i in self.id.values():
            self.rank[i] = order[m.pieces[i].score]
        # symbols: pieces by id, and other single characters from len(text) on, which no pair holds
        pairs = {(a, b): i for t, i in self.id.items() for k in range(1, len(t)) if (a := self.id.get(t[:k])) is not None and (b := self.id.get(t[k:])) is not None}
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        at = np.argsort(keys)
        self.keys, self.joined = keys[at], np.array(list(pairs.values()), np.int64)[at]

    @cached_property
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.joined.tolist(), strict=True))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no piece) and symbol of each pair."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        symbol = np.where(hit, self.joined[at], 0)
        return np.where(hit, self.rank[symbol], NONE), symbol

    def merged(self, words: list[str]) -> list[list[int]]:
        """Each word's ids."""
        short = iter(self._rounds([w for w in words if len(w) <= LONG]))
        return [next(short) if len(w) <= LONG else self._heaped(w) for w in words]

    def _ids(self, symbols: list[int]) -> list[int]:
        """Symbols as pieces; a character without a piece as its bytes."""
        ids: list[int] = []
        for x in symbols:
            ids += [x] if x < len(self.text) else self.byte_id[list(chr(x - len(self.text)).encode("utf-8", "surrogatepass"))].tolist()
        return ids

    def _heaped(self, word: str) -> list[int]:
        """Merges the best pair, leftmost on ties, until none is left; pairs wait in a heap, neighbours are linked."""
        symbol = [self.id.get(c, len(self.text) + ord(c)) for c in word]
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        rank, table, heap = self.rank.tolist(), self.table, []

        def offer(a: int, b: int) -> None:
            if (new := table.get(symbol[a] << 32 | symbol[b])) is not None:
                heap.append((rank[new], a, symbol[a], symbol[b], new)) if start else heapq.heappush(heap, (rank[new], a, symbol[a], symbol[b], new))

        start = True
        for a in range(len(symbol) - 1):
            offer(a, a + 1)
        start = False
        heapq.heapify(heap)
        while heap:
            _, a, x, y, new = heapq.heappop(heap)
            b = after[a]
            if symbol[a] != x or b == len(symbol) or symbol[b] != y:
                continue
            symbol[a], symbol[b], after[a] = new, -1, after[b]
            if after[a] < len(symbol):
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return self._ids([x for x in symbol if x >= 0])

    def _rounds(self, words: list[str]) -> list[list[int]]:
        if not words:
            return []
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, place = np.unique(code, return_inverse=True)
        known = np.array([self.id.get(chr(c), -1) for c in chars], np.int64)
        symbol = np.where(known >= 0, known, len(self.text) + chars.astype(np.int64))[place]
        length = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), length)
        done_w, done_s, done_k = [], [], []
        at = np.arange(len(symbol))  # where each symbol began, for the order at the end
        rank, new = np.full(len(symbol), NONE), np.zeros(len(symbol), np.int64)
        stale = np.arange(len(symbol))  # where pairs have changed
        while len(symbol):
            inner = stale[stale < len(symbol) - 1]
            inner = inner[word[inner + 1] == word[inner]]
            rank[stale] = NONE
            rank[inner], new[inner] = self.pairs(symbol[inner], symbol[inner + 1])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            best = np.repeat(least, np.diff(np.append(first, len(symbol))))
            live = best != NONE
            if not live.all():  # finished words leave the arrays
                done_w.append(word[~live])
                done_s.append(symbol[~live])
                done_k.append(at[~live])
            hit = self._apart(np.flatnonzero(live & (rank == best)), symbol, new, word, best)
            symbol[hit] = new[hit]
            changed = np.zeros(len(symbol), bool)
            changed[hit], changed[hit - (hit > 0)] = True, True
            keep = live
            keep[hit + 1] = False
            symbol, word, at, rank, new, changed = (x[keep] for x in (symbol, word, at, rank, new, changed))
            stale = np.flatnonzero(changed)
        w, s, k = np.concatenate(done_w), np.concatenate(done_s), np.concatenate(done_k)
        order = np.argsort(k)
        w, s = w[order], s[order]
        cut = np.searchsorted(w, np.arange(len(words) + 1))
        return [self._ids(s[cut[i] : cut[i + 1]].tolist()) for i in range(len(words))]

    def _apart(self, hit: np.ndarray, symbol: np.ndarray, new: np.ndarray, word: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of the pairs of their words' best rank (places in order) those that can merge at once."""
        first = np.ones(len(hit), bool)
        first[1:] = word[hit[1:]] != word[hit[:-1]]
        if first.all():
            return hit
        begin = np.ones(len(hit), bool)
        begin[1:] = hit[1:] != hit[:-1] + 1
        run = np.flatnonzero(begin)
        odd = (np.arange(len(hit)) - run[np.cumsum(begin) - 1]) % 2 == 0  # of runs of overlapping pairs the first, third and so on
        hit, first = hit[odd], first[odd]
        last = len(symbol) - 1
        made = [  # with the symbol before, the symbol after, and the next pair's
            (symbol[np.maximum(hit - 1, 0)], new[hit], (hit > 0) & (word[np.maximum(hit - 1, 0)] == word[hit])),
            (new[hit], symbol[np.minimum(hit + 2, last)], (hit + 2 <= last) & (word[np.minimum(hit + 2, last)] == word[hit])),
            (new[hit[:-1]], new[hit[1:]], (hit[1:] == hit[:-1] + 2) & ~first[1:]),
        ]
        sooner = np.zeros(int(word[-1]) + 1, bool)
        for a, b, real in made:
            own = hit[: len(a)]
            sooner[word[own[real & (self.pairs(a, b)[0] <= best[own])]]] = True
        return hit[first | ~sooner[word[hit]]]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: runs of byte pieces as UTF-8, one leading blank dropped."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text[i])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return (text[1:] if text.startswith(BLANK) else text).replace(BLANK, " ")


class Encoder:
    """Texts to (number of ids, ids as decimal text joined by commas, decoded text), with a bounded cache of words."""

    MOST = 600_000

    def __init__(self, path: str):
        self.model, self.cache = Model(path), {}

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        if len(self.cache) > self.MOST:
            self.cache.clear()
        cut, new = [], set()
        for t in texts:
            if not t:
                cut.append([])
                continue
            if "  " in t or t[0] == " " or t[-1] == " " or BLANK in t:
                words = CHUNK.findall(BLANK + t.replace(" ", BLANK))
            else:  # single blanks: each word has one before it
                words = t.split(" ")
            cut.append(words)
            new.update(words)
        fresh = [w for w in new if w not in self.cache]
        for ids, w in zip(self.model.merged([w if w[0] == BLANK else BLANK + w for w in fresh]), fresh, strict=True):
            text = self.model.decode([self.model.id[BLANK], *ids])  # the leading blank that decode drops is not the word's
            self.cache[w] = (len(ids), ",".join(map(str, ids)), text)
        for words in cut:
            got = [self.cache[w] for w in words]
            yield sum(x[0] for x in got), ",".join([x[1] for x in got]), "".join([x[2] for x in got])[1:]
        for w in fresh:
            if len(w) > KEPT:
                del self.cache[w]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One a worker process, so that its words last from task to task."""
    return Encoder(path)


def encode_documents(docs: DataFrame, id_col: str, text_col: str, path: str, digests: bool = True) -> DataFrame:
    """id, n_tokens long, then ids_sha256, decoded_sha256 or with digests=False ids array<int>, decoded string.

    Null texts count as empty: no ids, and an empty text back. Any text is encoded: characters without a piece, line breaks
    among them, become their bytes. Repeated rows and null ids give rows like any other; no other column is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    more = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            texts, n, ids, back = batch.column(1).to_pylist(), [], [], []
            for at in range(0, len(texts), 256):
                for k, x, text in encoder.encode([t or "" for t in texts[at : at + 256]]):
                    n.append(k)
                    ids.append(hashlib.sha256(x.encode()).hexdigest() if digests else [int(i) for i in x.split(",") if i])
                    back.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", *more])

    kinds = "string" if digests else "array<int>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, {more[0]} {kinds}, {more[1]} string")
