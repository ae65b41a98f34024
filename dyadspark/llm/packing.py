"""Packs documents into sequences of a fixed number of tokens by the linear grouping scheme.

Lengths are whole numbers from 1 to the capacity, so the whole problem is one histogram of that many counts, however many
documents there are. The driver packs the histogram; documents take their places by rank within their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import written

CAPACITY, END_ID = 1024, 2
#: (groups, length up to which items are small), as shares of the capacity; the plan of fewest sequences is taken.
SETTINGS = ((0.25, 0.25), (1, 0.25), (1, 0.5))
#: Ranks are counted within so many buckets of documents; each bucket is one stream of rows with one counter a length.
BUCKETS = 1024


#: Characters that every version of Unicode classes alike, in texts that ranks may encode: Latin, dashes and quotes.
PLAIN = "\n\x20-\x7e\xa1-\u024f\u2010-\u2027"
#: Blanks in a row that they may hold; only texts of LONG characters or more are searched for such runs.
RUN, LONG = 1000, 100_000


def _by_ranks(path: str):
    """The tokenizer as ranks alone, which is faster for single words; None unless it must give the same ids.

    It merges any two neighbours whose joined bytes are a token, lowest id first, while the tokenizer merges listed pairs in
    the list's order. If ids follow the list and each token's own bytes merge to that token by listed pairs, then whenever a
    token is due its span has gone through just the merges of the token alone, so its neighbours are the listed pair.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["dropout"]:
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    if [vocab.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    for a, b in pairs:  # in order: the parts are known to merge to themselves, so it is enough to see the whole do so
        parts = list(a + b)
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            if (parts[at], parts[at + 1]) not in rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens={})


class Encoder:
    """Ids as bytes (little-endian unsigned 32-bit), text by text.

    Where ranks give the tokenizer's ids they encode whole texts of Latin letters, which needs no list of ids. All other
    texts, and those with very long runs of blanks, on which the pattern would have to go back too far, go to the tokenizer,
    which is loaded with the first of them.
    """

    def __init__(self, path: str):
        self.path, self.ranks = path, _by_ranks(path)
        self.other, self.blank = re.compile(f"[^{PLAIN}]").search, re.compile(f"[ \n]{{{RUN}}}").search

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def encode(self, text: str) -> bytes:
        if self.ranks is None or self.other(text) or (len(text) >= LONG and self.blank(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return bytes(self.ranks._core_bpe.encode_to_tiktoken_buffer(text, set()))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One a worker process, so that it is loaded once."""
    return Encoder(path)


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece int, start long, length long, ids_crc32 long: the token pieces of each row; a null text has the end id alone.

    Only a document longer than the capacity is cut: its first piece takes what is left over, the others are full.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for i, text in enumerate(texts):
                data = memoryview(encoder.encode(text or "") + end)
                n = len(data) // 4
                head = n % capacity or capacity
                cuts = [0, *range(head, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(i, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            i, k, a, n, crc = map(list, zip(*rows, strict=True)) if rows else [[]] * 5
            cols = [batch.column(0).take(pa.array(i, pa.int64())), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, capacity: int = CAPACITY, settings: tuple[tuple[float, float], ...] = SETTINGS) -> list[tuple[int, list[int]]]:
    """The best of the grouped plans for the settings; counts[n] is the number of items of length n."""
    plans = [grouped_plan(counts, capacity, max(1, round(g * capacity)), round(s * capacity)) for g, s in settings]
    return min(plans, key=lambda p: sum(times for times, _ in p))


def grouped_plan(counts: np.ndarray, capacity: int, groups: int, small: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) configurations that hold counts[n] items of length n for each n, few sequences in all.

    Linear grouping: items longer than `small`, longest first, are cut into groups of equally many, and each is taken to be
    as long as its group's longest. Configurations of these few lengths are found by knapsacks (`_cover`). Actual items then
    take the places of their group, longest first, so none is longer than the place made for it. The small items go by
    best fit into the room that actual lengths leave, else into new sequences.
    """
    left = counts.astype(np.int64).copy()
    made: dict[tuple[int, ...], int] = {}

    def put(lengths: tuple[int, ...], times: int) -> None:
        if times:
            made[lengths] = made.get(lengths, 0) + times

    full = int(left[capacity])
    left[capacity] = 0
    done = [(full, [capacity])] if full else []
    sizes = [int(n) for n in np.flatnonzero(left) if n > small]
    total = int(left[small + 1 :].sum())
    if total:
        group, bound, held = max(1, -(-total // groups)), [], []  # longest first
        for n in reversed(sizes):
            c = int(left[n])
            while c:
                if not held or sum(x for _, x in held[-1]) >= group:
                    held.append([])
                    bound.append(n)
                take = min(c, group - sum(x for _, x in held[-1]))
                held[-1].append([n, take])
                c -= take
        need = np.array([sum(x for _, x in g) for g in held])
        for config, times in _cover(bound, need, capacity):
            queue = dict(config)
            while times > 0:  # actual items take the places, longest first; a run lasts while no length changes
                now, run = [], times
                for g, k in queue.items():
                    items = held[g]
                    if not items:
                        continue
                    n, have = items[0]
                    if have < k:  # the last few of a length go with the next length
                        got, j = [], 0
                        while len(got) < k and j < len(items):
                            got += [items[j][0]] * min(items[j][1], k - len(got))
                            j += 1
                        run = 1
                    else:
                        got = [n] * k
                        run = min(run, have // k)
                    now.append((g, got))
                if not now:
                    break
                for g, got in now:
                    for n in set(got):
                        item = next(x for x in held[g] if x[0] == n)
                        item[1] -= run * got.count(n)
                    held[g] = [x for x in held[g] if x[1]]
                put(tuple(sorted((n for _, got in now for n in got), reverse=True)), run)
                times -= run
        left[small + 1 :] = 0
        for g in held:
            for n, c in g:
                left[n] += c
    return done + _best_fit(made, left, capacity)


def _cover(sizes: list[int], need: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Configurations over the groups' lengths (longest first) and how often each is taken.

    Each holds the longest length that is left, so that none of the hard ones stays to the end, and the dearest filling of
    the rest of the sequence, a bounded knapsack in which a length's price is the length. It is taken half as often as its
    lengths last, once more with the prices that are then left, and so on.
    """
    rest, out = need.astype(np.int64), []
    while rest.any():
        g = int(np.argmax(rest > 0))
        most = rest.copy()
        most[g] -= 1
        config = dict(_knapsack(sizes, most, capacity - sizes[g]))
        config[g] = config.get(g, 0) + 1
        last = min(int(rest[i]) // k for i, k in config.items())
        times = last if last * config[g] >= rest[g] - config[g] or last < 16 else -(-last // 2)
        out.append((sorted(config.items()), times))
        for i, k in config.items():
            rest[i] -= times * k
    return out


def _knapsack(sizes: list[int], most: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The fullest filling of the room with at most so many of each length: [(group, number)]."""
    reach, back = np.zeros(room + 1, bool), []
    reach[0] = True
    for g, s in enumerate(sizes):
        took, now = np.zeros(room + 1, np.int16), reach.copy()
        for k in range(1, min(int(most[g]), room // s) + 1):
            new = np.zeros(room + 1, bool)
            new[k * s :] = reach[: room + 1 - k * s]
            took[new & ~now] = k
            now |= new
        back.append(took)
        reach = now
    out, at = [], int(np.flatnonzero(reach)[-1])
    for g in range(len(sizes) - 1, -1, -1):
        if k := int(back[g][at]):
            out.append((g, k))
            at -= k * sizes[g]
    return out


def _best_fit(made: dict[tuple[int, ...], int], left: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Puts the items left, longest first, where they leave least room; runs of equal sequences are filled at once."""
    free: dict[int, list[list]] = {}
    for lengths, times in made.items():
        free.setdefault(capacity - sum(lengths), []).append([times, list(lengths)])
    done: list[tuple[int, list[int]]] = [(t, x) for t, x in free.pop(0, [])]
    rooms = np.zeros(capacity + 1, bool)
    rooms[list(free)] = True
    for n in range(capacity, 0, -1):
        c = int(left[n])
        while c:
            fit = n + int(np.argmax(rooms[n:])) if rooms[n:].any() else 0
            if not fit:
                per = capacity // n
                whole, last = divmod(c, per)
                for times, k in ((whole, per), (1 if last else 0, last)):
                    if times:
                        room = capacity - k * n
                        free.setdefault(room, []).append([times, [n] * k])
                        rooms[room] = room > 0
                c = 0
                done += [(t, x) for t, x in free.pop(0, [])]
                break
            run = free[fit].pop()
            per = min(fit // n, c)
            times = min(run[0], c // per)
            if run[0] > times:
                free[fit].append([run[0] - times, run[1]])
            if not free[fit]:
                del free[fit]
                rooms[fit] = False
            room = fit - per * n
            if room:
                free.setdefault(room, []).append([times, run[1] + [n] * per])
                rooms[room] = True
            else:
                done.append((times, run[1] + [n] * per))
            c -= per * times
    return done + [(t, x) for runs in free.values() for t, x in runs]


def places(configs: list[tuple[int, list[int]]], capacity: int) -> dict[str, np.ndarray]:
    """By length and rank within it: runs of items, item j of a run going to sequence + j // per, offset + length * (j % per)."""
    rows, sequence, rank = [], 0, np.zeros(capacity + 1, np.int64)
    for times, lengths in configs:
        at = 0
        for n in sorted(set(lengths), reverse=True):
            k = lengths.count(n)
            rows.append((n, rank[n], sequence, at, k))
            rank[n] += times * k
            at += n * k
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "offset", "per"), cols, strict=True))


def best_fit_packing(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id long, offset long: one row a piece, each sequence without gaps from 0.

    Null and empty texts are the end id alone; repeated rows and null ids are packed like any other; an empty table gives no
    rows. Texts are tokenized once, into a table of pieces without tokens. Its counts a bucket and length, BUCKETS times the
    capacity at most, are all that reaches the driver.
    """
    cut = pieces(docs, id_col, text_col, tokenizer, capacity, end_id)
    cut = written(cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(BUCKETS)).cast("int")), "pieces")
    counts = np.zeros((BUCKETS, capacity + 1), np.int64)
    for batch in cut.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n")).toArrow().to_batches():
        counts[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    where = places(plan(counts.sum(0), capacity), capacity)
    before = np.cumsum(counts, 0) - counts
    key = where["length"] << 40 | where["rank"] if len(where["length"]) else np.zeros(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((before.astype(np.int64), where, key))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, where, key = shared.value
        bucket, seen = -1, None
        for batch in batches:
            b, n = batch.column("bucket").to_numpy(), batch.column("length").to_numpy()
            rank = np.empty(len(b), np.int64)
            for at in np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []:
                end = at + int(np.searchsorted(b[at:], b[at], "right"))
                if b[at] != bucket:
                    bucket, seen = int(b[at]), before[b[at]].copy()
                own = n[at:end]
                order = np.argsort(own, kind="stable")
                sizes, first, times = np.unique(own[order], return_index=True, return_counts=True)
                within = np.empty(end - at, np.int64)
                within[order] = np.arange(end - at) - np.repeat(first, times)
                rank[at:end] = seen[own] + within
                seen[sizes] += times
            run = np.searchsorted(key, n << 40 | rank, "right") - 1
            j = rank - where["rank"][run]
            cols = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(where["sequence"][run] + j // where["per"][run]), pa.array(where["offset"][run] + n * (j % where["per"][run]))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["id"].dataType.simpleString()
    dealt = cut.repartition("bucket").sortWithinPartitions("bucket", "id", "piece", "start", "length", "ids_crc32")
    return dealt.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
