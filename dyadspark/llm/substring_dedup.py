"""Removes passages of words that recur, located by Aho-Corasick automata.

The shards of `recurrence` confirm which windows of words recur, join neighbouring ones to passages, compile the passages of
a chunk of anchors to an automaton over numbered words, and stream all stretches of documents with these anchors through
it. Each match of a passage is a span to remove. The automata find no place that the hashes of windows don't already tell, and
windows that recur only between salts of an anchor come from these hashes without passing one; documents aren't streamed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dyadspark.llm import recurrence as rec
from dyadspark.llm.common import numbered

WINDOW, GRAM = 35, 8


def locate(window: int):
    def matcher(s: rec.Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import ahocorasick

        recurs = np.flatnonzero(s.recurs)
        if not len(recurs):
            return (np.zeros(0, np.int64),) * 3
        at, of = s.windows[recurs], s.of[recurs]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])]))
        begin, end = at[new], at[np.append(new[1:], len(at)) - 1] + window
        _, word = np.unique(s.items.value[0], return_inverse=True)
        word = word.tolist()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            automaton.add_word(tuple(word[a:b]), b - a)
        automaton.make_automaton()
        found = []
        first = s.items.first.tolist()
        for i in np.unique(of).tolist():
            a = first[i]
            reach: dict[int, int] = {}
            for last, n in automaton.iter(tuple(word[a : first[i + 1]])):
                if n > reach.get(last, 0):
                    reach[last] = n
            found += [(i, a + last + 1 - n, a + last + 1) for last, n in reach.items()]
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    return matcher


def passages(docs: DataFrame, text_col: str, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The different texts (key, text, copies), and by key the runs of recurring passages in them: spans of (low, high), places of words."""
    texts = rec.different_texts(docs, text_col)
    return texts, rec.recurring_spans(texts, rec.word_items, window, gram, locate(window))


def dedup(docs: DataFrame, text_col: str, window: int = WINDOW, gram: int = GRAM, digests: bool = True) -> DataFrame:
    """docs with n_words long, n_removed long and kept_sha256 string, or with digests=False kept string.

    A word goes if a window of `window` words that covers it also starts anywhere else in the table, its own document
    included. kept_sha256 is of the words left, joined by blanks; kept is the text without the words removed and the white
    space after each, and the text itself where nothing goes. Null texts have no words and keep nothing (digests: of an
    empty text; kept: null); texts shorter than the window lose nothing; of exact copies all go. Repeated rows are copies; an empty table gives none.
    """
    texts, spans = passages(docs, text_col, window, gram)
    last = "kept_sha256" if digests else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = text.encode()
                words = raw.split()
                low, high = rec.removed_runs(batch, i, len(words), window)
                n_words.append(len(words))
                n_removed.append(int((high - low).sum()))
                if digests:
                    ends = [0, *high.tolist()]
                    left = [w for a, b in zip(ends, [*low.tolist(), len(words)], strict=True) for w in words[a:b]] if len(low) else words
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                elif len(low):
                    x = rec.word_items(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    starts = np.append(x.start, len(raw))
                    cuts = [0, *(starts[k] for pair in zip(low, high, strict=True) for k in pair), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(cuts[0::2], cuts[1::2], strict=True)).decode())
                else:
                    kept.append(text)
            cols = [batch.column("key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n_words", "n_removed", last])

    results = rec.with_spans(texts, spans).select("key", "text", "copies", "spans").mapInArrow(run, f"key binary, n_words long, n_removed long, {last} string")
    if digests:
        return rec.back_to_rows(docs, text_col, results).fillna(0, ["n_words", "n_removed"]).fillna(hashlib.sha256(b"").hexdigest(), ["kept_sha256"])
    return rec.back_to_rows(docs, text_col, results).fillna(0, ["n_words", "n_removed"])


def without_passages(docs: DataFrame, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with each text as it is kept (see dedup), and all other columns, whatever their names."""
    own, names, (text,) = numbered(docs, text_col)
    kept = dedup(own, text, window, gram, digests=False)
    return kept.select(*["kept" if c == text else c for c in own.columns]).toDF(*names)
