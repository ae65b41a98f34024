"""Removes byte strings that recur, found as the maximal repeats of enhanced suffix arrays.

In a shard of `recurrence` only suffixes whose first `window` bytes recur are of interest; they are brought together by these
bytes' hashes, which are the tree's nodes at that depth. A node whose suffixes all follow the same byte lies inside the repeat
that begins one byte earlier, so only nodes with different left neighbours, or at the edge of a stretch, are refined: their
suffixes are sorted, common prefixes of neighbours computed, and a stack scan gives the intervals of the common-prefix tree,
each a maximal repeat with all of its occurrences. A stretch reaches as far as windows have its anchor, so a longer repeat
shows as overlapping pieces that together cover it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dyadspark.llm import recurrence as rec
from dyadspark.llm.textvec import Rolling

WINDOW, GRAM = 400, 48


def _heads(s: rec.Stretches) -> np.ndarray:
    """Windows in nodes that recur and whose left neighbours differ or which touch a stretch's edge."""
    at = np.flatnonzero(s.recurs)
    edge = s.windows[at] == s.items.first[s.of[at]]
    left = np.where(edge, -1, s.items.raw[np.maximum(s.windows[at] - 1, 0)].astype(np.int64))
    low, high = np.full(len(s.times), 999), np.full(len(s.times), -2)
    np.minimum.at(low, s.same[at], left)
    np.maximum.at(high, s.same[at], left)
    return at[(low[s.same[at]] < 0) | (low[s.same[at]] != high[s.same[at]])]


def suffix_array(s: rec.Stretches, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the heads: places in suffix order (nodes apart), ends of their stretches, nodes, and common prefix with the one before (0 across nodes)."""
    heads = _heads(s)
    at, end, node = s.windows[heads], s.items.first[s.of[heads] + 1], s.same[heads]
    raw = s.items.raw.tobytes()
    tails = [raw[a:b] for a, b in zip((at + window).tolist(), end.tolist(), strict=True)]
    order = np.array(sorted(range(len(at)), key=lambda i: (node[i], tails[i])), np.int64)
    at, end, node = at[order], end[order], node[order]
    common = np.zeros(len(at), np.int64)
    pair = np.flatnonzero(node[1:] == node[:-1]) + 1
    if len(pair):  # longest common prefixes by bisection on hashes of prefixes
        hashed = Rolling(s.items.value[0])
        a, b = at[pair - 1], at[pair]
        low, high = np.full(len(pair), window), np.minimum(end[pair - 1] - a, end[pair] - b)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = hashed.windows(a, mid) == hashed.windows(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        common[pair] = low
    return at, end, node, common


def maximal_repeats(s: rec.Stretches, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of each maximal repeat of `window` bytes or more: an interval of the common-prefix tree that
    differs to the left, with all occurrences."""
    at, _, _, common = suffix_array(s, window)
    raw, first = s.items.raw, set(s.items.first.tolist())
    left = [-1 if p in first else int(raw[p - 1]) for p in at.tolist()]
    depth = [*common.tolist(), 0]
    stack: list[tuple[int, int]] = []  # (length, first suffix) of open intervals
    for i in range(1, len(depth)):
        begin = i - 1
        while stack and stack[-1][0] > depth[i]:
            length, begin = stack.pop()
            edge = left[begin:i]
            if -1 in edge or len(set(edge)) > 1:
                yield length, at[begin:i]
        if depth[i] >= window and (not stack or stack[-1][0] < depth[i]):
            stack.append((depth[i], begin))


def locate(window: int):
    def matcher(s: rec.Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        reach: dict[int, int] = {}
        for length, places in maximal_repeats(s, window):
            for p in places.tolist():
                if length > reach.get(p, 0):
                    reach[p] = length
        at = np.array(sorted(reach), np.int64)
        length = np.array([reach[p] for p in at.tolist()], np.int64)
        return np.searchsorted(s.items.first, at, "right") - 1, at, at + length

    return matcher


def repeats(docs: DataFrame, text_col: str, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The different texts (key, text, copies), and by key the runs of bytes that recur: spans of (low, high).

    A run is the union of occurrences of shards' maximal repeats, the longest from each place, and of windows that recur only
    between salts of an anchor. Runs aren't grouped by repeat.
    """
    texts = rec.different_texts(docs, text_col)
    return texts, rec.recurring_spans(texts, rec.byte_items, window, gram, locate(window))


def dedup(docs: DataFrame, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans long and kept_sha256 string.

    A byte of the UTF-8 text goes if a string of `window` bytes that covers it also starts anywhere else in the table, its own
    document included; n_spans counts the maximal runs that go, and kept_sha256 is of the bytes left. Null texts count as
    empty; texts shorter than the window lose nothing; of exact copies, repeated rows among them, all goes.
    """
    texts, spans = repeats(docs, text_col, window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = text.encode()
                low, high = rec.removed_runs(batch, i, len(raw), window)
                ends = [0, *high.tolist()]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*low.tolist(), len(raw)], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(low), hashlib.sha256(kept).hexdigest()))
            cols = [pa.array(list(c)) for c in zip(*rows, strict=True)] if rows else [pa.array([], k) for k in (pa.int64(),) * 3 + (pa.string(),)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *cols], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    results = rec.with_spans(texts, spans).select("key", "text", "copies", "spans").mapInArrow(run, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return rec.back_to_rows(docs, text_col, results).fillna(0, ["n_bytes", "n_removed", "n_spans"]).fillna(hashlib.sha256(b"").hexdigest(), ["kept_sha256"])
