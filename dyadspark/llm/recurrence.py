"""Finds what recurs across texts without comparing all with all: minimizer anchors, routed stretches, exact checks.

A sequence (words, or bytes) has a window of `window` items at each place. The least hash among the `gram`-item grams of a
window is its anchor, so equal windows have equal anchors at equal places. Only stretches around anchors that occur more
than once travel, each to the shard of its anchor, where a matcher finds the windows that recur. An anchor with more than
MOST stretches is dealt over several shards by salt; windows that recur only between its shards are found by their
128-bit hashes: each shard sends its different windows once, packed, to as many parts of the hashes as the anchor has salts.

Each different text is handled once; exact copies meet again at the end, by their key.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import bucketed, distinct_texts, numbered, parts_for, text_key, written
from dyadspark.llm.textvec import Rolling, Words, _byte_values, sliding_argmin, slices, windows_within

MOST, CHUNK, STRETCH = 512, 1_500_000, 500_000
#: Spans that a task gathers before it sends each part of the keys its own.
GATHERED = 200_000
#: Different texts, about, whose spans one task unites.
TEXTS = 200_000


@dataclass
class Items:
    """first[r]: row r's first item; value: a hash for each item; start, end: its bytes."""

    raw: np.ndarray
    first: np.ndarray
    value: list[np.ndarray]
    start: np.ndarray
    end: np.ndarray


def word_items(raw: np.ndarray, offsets: np.ndarray, seeds: int = 1) -> Items:
    w = Words(raw, offsets, seeds=seeds)
    return Items(raw, w.first, w.h, w.start, w.end)


def byte_items(raw: np.ndarray, offsets: np.ndarray, seeds: int = 1) -> Items:
    at = np.arange(len(raw))
    return Items(raw, np.asarray(offsets), [_byte_values(s)[raw] for s in range(seeds)], at, at + 1)


@dataclass
class Anchors:
    """An occurrence each: row of its text, hash, and the first and last window that has it (places of items)."""

    row: np.ndarray
    hash: np.ndarray
    low: np.ndarray
    high: np.ndarray


def anchors_of(x: Items, window: int, gram: int) -> Anchors:
    starts = windows_within(x.first, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none)
    grams = Rolling(x.value[0]).windows(np.arange(len(x.value[0]) - gram + 1), gram)
    place = sliding_argmin(grams, window - gram + 1)[starts]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    low, high = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    return Anchors(np.searchsorted(x.first, low, "right") - 1, grams[place[new]].view(np.int64), low, high)


@dataclass
class Stretches:
    """A chunk of stretches in a shard: their items, and for each the windows' hashes and whether a window recurs here.

    windows: first item of each window; of: its stretch; same: number of its hash; times: how often that occurs here.
    """

    items: Items
    windows: np.ndarray
    of: np.ndarray
    same: np.ndarray
    times: np.ndarray
    hashes: list[np.ndarray]

    @property
    def recurs(self) -> np.ndarray:
        return self.times[self.same] > 1


#: Gets the stretches of some anchors; gives spans of items (stretch, begin, end) that windows which recur cover.
Matcher = Callable[[Stretches], tuple[np.ndarray, np.ndarray, np.ndarray]]


def stretches_of(data: list[bytes], view: Callable, window: int) -> Stretches:
    offsets = np.cumsum([0, *map(len, data)])
    x = view(np.frombuffer(b"".join(data), np.uint8), offsets, 2)
    at = windows_within(x.first, window)
    h = [Rolling(v, k).windows(at, window) for k, v in enumerate(x.value)]
    order = np.lexsort(h)
    new = np.ones(len(order), bool)
    new[1:] = (h[0][order][1:] != h[0][order][:-1]) | (h[1][order][1:] != h[1][order][:-1])
    same = np.empty(len(order), np.int64)
    same[order] = np.cumsum(new) - 1
    return Stretches(x, at, np.searchsorted(x.first, at, "right") - 1, same, np.bincount(same) if len(same) else np.zeros(0, np.int64), h)


def different_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """distinct_texts as a table bucketed by key in the warehouse: later joins by key move no text."""
    return bucketed(distinct_texts(docs, text_col), "key")


def recurring_spans(texts: DataFrame, view: Callable, window: int, gram: int, matcher: Matcher, most: int = MOST) -> DataFrame:
    """key, spans array<struct<low, high>>: of each different text the runs of items that windows which recur cover, if any do."""
    parts = max(parts_for(texts.sparkSession, 8), texts.count() // TEXTS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in slices(batch.column(0), STRETCH):
                h, n = np.unique(anchors_of(view(raw, offsets), window, gram).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["anchor", "n"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, raw, offsets in slices(batch.column(1), STRETCH):
                x = anchors_of(view(raw, offsets), window, gram)
                order = np.lexsort((x.hash, x.row))
                row, h = x.row[order], x.hash[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new] + a)), pa.array(h[new])], ["key", "anchor"])

    often = texts.select("text").mapInArrow(counted, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    marks = texts.select("key", "text").mapInArrow(named, "key binary, anchor long").join(often, "anchor").groupBy("key").agg(F.collect_list(F.struct("anchor", "n")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column("text"), STRETCH):
                marks = batch.column("marks").slice(a, b - a).flatten()
                known, at = np.unique(marks.field("anchor").to_numpy(), return_index=True)
                salts = -(-marks.field("n").to_numpy()[at] // most)
                x = view(raw, offsets)
                found = anchors_of(x, window, gram)
                place = np.minimum(np.searchsorted(known, found.hash), len(known) - 1)
                keep = np.flatnonzero(known[place] == found.hash)
                row, low, high, n = found.row[keep], found.low[keep], found.high[keep], salts[place[keep]]
                data, keys = raw.tobytes(), batch.column("key")
                blobs = [data[s:e] for s, e in zip(x.start[low].tolist(), x.end[high + window - 1].tolist(), strict=True)]
                own = low - x.first[row]
                named = keys.take(pa.array(row + a))
                salt = [zlib.crc32(k.as_py() + z.to_bytes(8)) % m if m > 1 else 0 for k, z, m in zip(named, own.tolist(), n.tolist(), strict=True)]
                cols = [pa.array(found.hash[keep]), pa.array(salt, pa.int32()), pa.array(n.astype(np.int32)), named, pa.array(own), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "salt", "salts", "key", "low", "stretch"])

    cuts = texts.select("key", "text").join(marks, "key").mapInArrow(cut, "anchor long, salt int, salts int, key binary, low long, stretch binary")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for chunk in _chunks(batches):
            s = stretches_of(chunk.column("stretch").to_pylist(), view, window)
            keys, low, salts = _key_bytes(chunk.column("key")), chunk.column("low").to_numpy(), chunk.column("salts").to_numpy()
            base = low - s.items.first[:-1]
            stretch, begin, end = matcher(s)
            row, begin, end = united(stretch, begin, end)
            held.append((keys[row], begin + base[row], end + base[row]))
            n += len(row)
            if n >= GATHERED:
                yield _spans(held, parts)
                held, n = [], 0
            own = np.flatnonzero(salts[s.of] > 1)
            if len(own):
                yield _windows(s, own, base, salts, chunk.column("anchor").to_numpy(), keys)
        if held:
            yield _spans(held, parts)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for own in _groups(batches, "anchor", "part"):
            h = np.concatenate([np.frombuffer(r["hashes"], np.uint64).reshape(2, -1) for r in own], 1)
            alone = np.concatenate([np.arange(r["n"]) < r["alone"] for r in own])
            order = np.lexsort(h)
            new = np.ones(len(order), bool)
            new[1:] = (h[:, order[1:]] != h[:, order[:-1]]).any(0)
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            hit = (np.bincount(group)[group] > 1)[alone]
            at = _numbers(own, "places")[hit]
            held.append((_key_rows(own)[hit], at, at + window))
            if sum(len(x[1]) for x in held) >= GATHERED:
                yield _spans(held, parts)
                held = []
        if held:
            yield _spans(held, parts)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, "part"):
            keys, low, high = _key_rows(own), _numbers(own, "places"), _numbers(own, "ends")
            k = np.concatenate([keys, np.zeros((len(keys), 4), np.uint8)], 1).view(np.uint64)
            _, first, text = np.unique(k, axis=0, return_index=True, return_inverse=True)
            row, low, high = united(text.reshape(-1), low, high)
            spans = pa.StructArray.from_arrays([pa.array(low), pa.array(high)], ["low", "high"])
            named = pa.array([keys[i].tobytes() for i in first], pa.binary())
            yield pa.RecordBatch.from_arrays([named, pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(first) + 1)).astype(np.int32)), spans)], ["key", "spans"])

    schema = ", ".join(f"{c} {k}" for c, k in zip(_SENT, ("long", "int", "int", "int", *["binary"] * 4), strict=True))
    found = written(cuts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(matched, schema), "spans")
    more = found.where(F.col("anchor").isNotNull()).repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(between, schema)
    spans = found.where(F.col("anchor").isNull()).unionByName(more).select("part", "places", "ends", "keys")
    return spans.repartition("part").sortWithinPartitions("part").mapInArrow(gathered, "key binary, spans array<struct<low: long, high: long>>")


#: Rows that travel between tasks. Either n spans (places to ends) of the texts with these keys, which belong to a part of the
#: keys; or the n windows that a shard of a salted anchor sends to a part of the hashes, two numbers each: those that occur
#: once in the shard first, with their places and keys.
_SENT = {"anchor": pa.int64(), "part": pa.int32(), "n": pa.int32(), "alone": pa.int32(), "hashes": pa.binary(), "places": pa.binary(), "ends": pa.binary(), "keys": pa.binary()}
KEY = 20


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(_SENT)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, _SENT.values(), strict=True)], list(_SENT))


def _groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[list[dict]]:
    rows = (r for batch in batches for r in batch.to_pylist())
    for _, own in groupby(rows, key=lambda r: tuple(r[c] for c in by)):
        yield list(own)


def _numbers(rows: list[dict], c: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[c] for r in rows), np.int64)


def _key_rows(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, KEY)


def _key_bytes(keys: pa.Array) -> np.ndarray:
    """A row of KEY bytes for each key."""
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, KEY)


def united(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of each row's spans as maximal runs, by row and place."""
    if not len(row):
        return row, low, high
    wide = int(high.max()) + 2
    a, b = merged(low + row * wide, high + row * wide)
    row = a // wide
    return row, a - row * wide, b - row * wide


def _spans(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """A row for each part of the keys that has spans."""
    keys, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
    part = (np.ascontiguousarray(keys[:, :4]).view(np.uint32)[:, 0] % np.uint32(parts)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    order = np.argsort(part, kind="stable")
    keys, low, high, part = keys[order], low[order], high[order], part[order]
    new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    ends = [*new[1:], len(part)]
    return _rows([(None, int(part[i]), int(j - i), None, None, low[i:j].tobytes(), high[i:j].tobytes(), keys[i:j].tobytes()) for i, j in zip(new, ends, strict=True)] if len(part) else [])


def _windows(s: Stretches, own: np.ndarray, base: np.ndarray, salts: np.ndarray, anchors: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """The different ones of the windows `own`, a row for each anchor and part."""
    _, one = np.unique(s.same[own], return_index=True)
    own = own[one]
    of = s.of[own]
    lonely = s.times[s.same[own]] == 1
    part = (s.hashes[0][own] % salts[of].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((~lonely, part, anchors[of]))
    own, of, lonely, part, anchor = own[order], of[order], lonely[order], part[order], anchors[of][order]
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1])]))
    h, at = np.stack([x[own] for x in s.hashes]), s.windows[own] + base[of]
    rows = []
    for i, j in zip(new.tolist(), [*new[1:].tolist(), len(own)], strict=True):
        m = i + int(lonely[i:j].sum())
        rows.append((int(anchor[i]), int(part[i]), j - i, m - i, h[:, i:j].tobytes(), at[i:m].tobytes(), None, keys[of[i:m]].tobytes()))
    return _rows(rows)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and salt, in chunks of about CHUNK bytes that end where an anchor's or salt's rows end."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        a, s = batch.column("anchor").to_numpy(), batch.column("salt").to_numpy()
        ends = np.append(np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1])) + 1, batch.num_rows)
        length = np.cumsum(np.diff(np.frombuffer(batch.column("stretch").buffers()[1], np.int32, batch.num_rows + 1, batch.column("stretch").offset * 4)))
        if held and size >= CHUNK and (held[-1].column("anchor")[-1].as_py(), held[-1].column("salt")[-1].as_py()) != (a[0], s[0]):
            yield joined()
            held, size = [], 0
        at, before = 0, 0
        for end in ends[:-1]:  # the last group may go on in the next batch
            if size + length[end - 1] - before >= CHUNK:
                held.append(batch.slice(at, end - at))
                yield joined()
                held, size, at, before = [], 0, int(end), int(length[end - 1])
        held.append(batch.slice(at))
        size += int(length[-1]) - before
    if held:
        yield joined()


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(order) else high
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    at = np.flatnonzero(new)
    return low[at], high[np.append(at[1:], len(low)) - 1] if len(at) else high


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The different texts with `spans`, null where nothing recurs."""
    return texts.join(spans, "key", "left")


def back_to_rows(docs: DataFrame, text_col: str, results: DataFrame) -> DataFrame:
    """docs with the columns of results, found by the text's key; null for null texts. Columns so named give way."""
    more = tuple(results.columns[1:])
    docs, names, (text_col,) = numbered(docs, text_col, added=more)
    results = results.withColumnRenamed("key", "__key")
    return docs.withColumn("__key", text_key(F.col(text_col))).join(results, "__key", "left").select(*docs.columns, *more).toDF(*names, *more)


def removed_runs(batch: pa.RecordBatch, i: int, items: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of row i of with_spans: maximal runs of items to remove; all of a text that has exact copies, if a window fits in."""
    if batch.column("copies")[i].as_py() > 1:
        return (np.array([0]), np.array([items])) if items >= window else (np.zeros(0, np.int64),) * 2
    spans = batch.column("spans")[i].values
    if spans is None or not len(spans):
        return (np.zeros(0, np.int64),) * 2
    return merged(spans.field("low").to_numpy(), spans.field("high").to_numpy())
