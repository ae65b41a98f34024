"""Language identification: words first, then ever shorter character n-grams for words that were not seen.

A word, a run of letters in lower case, scores in each language the logarithm of its frequency there. A word that no language
has falls back to its character n-grams, blanks around it included: the longest n of which any is known decides, by the mean
over its known n-grams. A text takes the language of the highest mean over its words.

Counts come from labelled texts, `sample` a language at most in the mean (`SAMPLE`), the least by hash of their id, whole. The
frequencies are one table, gram by language. Scoring has two ways with equal results: a model of at most ENTRIES rows goes to
every task, where batches of texts are looked up by numpy; beyond it words, then n-grams, are joined with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import distinct_texts, fold, numbered, text_key, written
from dyadspark.llm.textvec import Rolling, Words, mix, slices

#: Texts of a language that are learned from, as the mean of a draw by hash; letters of the longest n-grams; the count that
#: a language lends to what it has never had; rows of the model that go to every task at most; languages at most.
SAMPLE, LONGEST, ALPHA, ENTRIES, LANGUAGES = 3000, 5, 0.1, 2_000_000, 1000
#: What separates words: anything but letters and the marks on them.
BETWEEN = r"[^\p{L}\p{M}]+"
LETTER = r"\p{L}"
UNKNOWN = "und"


def spaced(text: Column) -> Column:
    """The text's words in lower case with one blank between them; empty without a letter."""
    plain = F.trim(F.regexp_replace(F.lower(text), BETWEEN, " "))
    return F.when(plain.rlike(LETTER), plain).otherwise("")


def grams(word: Column, n: int) -> Column:
    """The runs of n characters of a word with a blank before and after it, but for the lone blanks."""
    wide = F.concat(F.lit(" "), word, F.lit(" ")) if n > 1 else word
    return F.when(F.length(wide) >= n, F.transform(F.sequence(F.lit(1), F.length(wide) - (n - 1)), lambda i: F.substring(wide, i, n))).otherwise(F.array().cast("array<string>"))


@dataclass
class Model:
    """languages: those learned, by name; likeliest: the place of the one with most texts; table: n (0: words), gram, values array<double>."""

    languages: list[str]
    likeliest: int
    table: DataFrame


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, folds: int = 4, held_out: int = 2) -> Model:
    """Learns from rows with a language and an id outside the held-out fold; rows of one id count as one, the least by language and text.

    Null texts teach nothing, but their language is learned. There are LANGUAGES languages at most, else an error: lang names
    a language, it isn't free text. A language with fewer texts than `sample` gives all of them.
    """
    docs, _, (i, t, g) = numbered(docs, id_col, text_col, lang_col)
    known = docs.select(F.col(i).alias("id"), F.col(t).alias("text"), F.col(g).cast("string").alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("id"), folds) != held_out))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    languages = sorted(sizes)
    spark = docs.sparkSession
    if not languages:
        return Model([], 0, spark.createDataFrame([], "n int, gram string, values array<double>"))
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, sample / max(1, sizes[k]))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < share * (1 << 30)
    texts = known.where(drawn).groupBy("id").agg(F.min(F.struct("lang", "text")).alias("t")).select("t.lang", "t.text")
    words = texts.select("lang", F.explode(F.split(spaced(F.col("text")), " ")).alias("gram")).where("gram <> ''").groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c"))
    words = written(words, "language-words")
    parts = [words.select(F.lit(0).alias("n"), "gram", "lang", "c")]
    parts += [words.select(F.lit(n).alias("n"), F.explode(grams(F.col("gram"), n)).alias("gram"), "lang", "c") for n in range(1, LONGEST + 1)]
    counts = reduce(DataFrame.unionAll, parts).groupBy("n", "gram").pivot("lang", languages).agg(F.sum("c"))
    columns = [f"l{k}" for k in range(len(languages))]
    counts = written(counts.toDF("n", "gram", *columns).fillna(0, columns), "language-counts")
    totals = {r.n: r for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("kinds"), *[F.sum(c).alias(c) for c in columns]).collect()}

    def value(column: str) -> Column:
        whole = F.create_map(*[F.lit(x) for n, r in totals.items() for x in (n, float(r[column] + ALPHA * r.kinds))]) if totals else F.lit(None)
        return F.log10((F.col(column) + ALPHA) / (F.element_at(whole, F.col("n")) if totals else F.lit(1.0)))

    table = counts.select("n", "gram", F.array(*[value(c) for c in columns]).alias("values"))
    return Model(languages, max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k)), table)


def hashed(codes: np.ndarray, n: int) -> tuple[Rolling, np.uint64]:
    """Windows of n code points of a sequence have hashes windows(starts, n) ^ salt."""
    return Rolling(mix(codes.astype(np.uint64))), mix(np.array([n], np.uint64))[0]


class Lookup:
    """The model by 64-bit hashes: words by their bytes, n-grams by their code points."""

    def __init__(self, n: np.ndarray, gram: pa.Array, values: np.ndarray):
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(LONGEST + 1):
            own = np.flatnonzero(n == k)
            strings = gram.take(pa.array(own))
            if k == 0:
                data = strings.cast(pa.large_binary())
                raw, offsets = b"".join(data.to_pylist()), np.cumsum([0, *(len(x) for x in data.to_pylist())])
                h = Words(np.frombuffer(raw, np.uint8), offsets).h[0]
            else:
                codes = np.frombuffer("".join(strings.to_pylist()).encode("utf-32-le"), np.uint32)
                rolling, salt = hashed(codes, k)
                h = rolling.windows(np.arange(len(own)) * k, k) ^ salt
            order = np.argsort(h)
            self.by[k] = (h[order], values[own][order])

    def find(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the places of those."""
        keys = self.by[k][0]
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        return known, at[known]

    def words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of each word by language, and which words have any."""
        known, at = self.find(0, h)
        out = np.zeros((len(h), self.by[0][1].shape[1]))
        out[known] = self.by[0][1][at]
        rest = np.flatnonzero(~known)
        if not len(rest):
            return out, known
        text = " " + " ".join(raw[a:b].tobytes().decode() for a, b in zip(start[rest], end[rest], strict=True)) + " "
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        blank = np.flatnonzero(codes == 32)
        left, right = blank[:-1], blank[1:]  # the blanks around each word
        for k in range(LONGEST, 0, -1):
            edge = int(k == 1)
            a, size = left + edge, np.maximum(right - left + 1 - 2 * edge - k + 1, 0)
            starts = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            word = np.repeat(np.arange(len(rest)), size)
            rolling, salt = hashed(codes, k)
            hit, at = self.find(k, rolling.windows(starts, k) ^ salt)
            word = word[hit]
            some = np.unique(word)
            if len(some):
                times = np.bincount(word, minlength=len(rest))[some]
                got = np.stack([np.bincount(word, self.by[k][1][at, g], len(rest))[some] for g in range(out.shape[1])], 1)
                out[rest[some]] = got / times[:, None]
                known[rest[some]] = True
                keep = np.ones(len(rest), bool)
                keep[some] = False
                rest, left, right = rest[keep], left[keep], right[keep]
            if not len(rest):
                break
        return out, known

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts as by `spaced`: sums of values by language, and numbers of words that have any."""
        w = Words(raw, offsets)
        h, first, back = np.unique(w.h[0], return_index=True, return_inverse=True)
        values, known = self.words(raw, w.start[first], w.end[first], h)
        rows = len(offsets) - 1
        total = np.stack([np.bincount(w.row, values[back, g], rows) for g in range(values.shape[1])], 1)
        return total, np.bincount(w.row[known[back]], minlength=rows)


def _decided(total: np.ndarray, words: np.ndarray, likeliest: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the best language and its share of the frequencies that the means stand for; ties go to the likeliest, then by name."""
    mean = total / np.maximum(words, 1)[:, None]
    mean -= mean.max(1, keepdims=True)
    best = np.where(mean[:, likeliest] >= -1e-12, likeliest, (mean >= -1e-12).argmax(1))
    return best, 1 / (10.0**mean).sum(1)


def predict(docs: DataFrame, model: Model, text_col: str, entries: int = ENTRIES) -> DataFrame:
    """The columns of docs with __lang string and __score double, the share of the language among all, 0 to 1.

    `und` and score 0 for null texts, texts without a letter and where no language was learned. A text none of whose words
    has a known letter gets the language with most texts and an even share. Equal texts get equal results; an empty table
    gives none. Columns named __lang and __score give way; only the text is read.
    """
    docs, names, (text,) = numbered(docs, text_col, added=("__lang", "__score"))
    if not model.languages:
        out = docs.withColumn("__lang", F.lit(UNKNOWN)).withColumn("__score", F.lit(0.0))
    elif model.table.count() <= entries:
        out = _by_lookup(docs, model, text)
    else:
        out = _by_joins(docs, model, text)
    return out.toDF(*names, "__lang", "__score")


def _by_lookup(docs: DataFrame, model: Model, text: str) -> DataFrame:
    got = model.table.toArrow().combine_chunks()  # at most `entries` rows: predict has counted them
    values = np.array(got.column("values").combine_chunks().flatten()).reshape(got.num_rows, len(model.languages))
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(got.column("n").to_numpy(), got.column("gram").combine_chunks(), values), np.array(model.languages, object), model.likeliest))
    own = docs.columns
    docs = docs.withColumn("__spaced", spaced(F.col(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, languages, likeliest = shared.value
        for batch in batches:
            lang, score = [], []
            for _, _, raw, offsets in slices(batch.column(len(own))):
                total, words = lookup.scores(raw, offsets)
                best, share = _decided(total, words, likeliest)
                some = np.diff(offsets) > 0
                lang.append(np.where(some, languages[best], UNKNOWN))
                score.append(np.where(some, share, 0.0))
            cols = [pa.array(np.concatenate(lang or [np.zeros(0, object)]), pa.string()), pa.array(np.concatenate(score or [np.zeros(0)]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *cols], [*own, "__lang", "__score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(own)])
    return docs.mapInArrow(run, f"{schema}, __lang string, __score double")


def _by_joins(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """The same by joins of words and n-grams with the table; equal texts are one, so groups of copies cost one row a task."""
    texts = distinct_texts(docs, text).select("key", spaced(F.col("text")).alias("words"))
    said = texts.select("key", F.explode(F.split("words", " ")).alias("gram")).where("gram <> ''").groupBy("key", "gram").agg(F.count(F.lit(1)).alias("times"))
    said = written(said, "language-said")
    table = written(model.table, "language-model")
    kinds = said.select("gram").distinct().join(table.where("n = 0").select("gram", "values"), "gram", "left")
    kinds = written(kinds, "language-kinds")
    missing = kinds.where("values IS NULL").select(F.col("gram").alias("word"))
    runs = reduce(DataFrame.unionAll, [missing.select("word", F.lit(n).alias("n"), F.explode(grams(F.col("word"), n)).alias("gram")) for n in range(1, LONGEST + 1)])
    met = runs.join(table.where("n > 0"), ["n", "gram"])
    at = lambda k: F.avg(F.col("values")[k])
    by_n = met.groupBy("word", "n").agg(F.array(*[at(k) for k in range(len(model.languages))]).alias("values"))
    longest = by_n.groupBy(F.col("word").alias("gram")).agg(F.max_by("values", "n").alias("values"))
    values = kinds.where("values IS NOT NULL").unionByName(longest)
    sums = [F.sum(F.col("values")[k] * F.col("times")).alias(f"s{k}") for k in range(len(model.languages))]
    per = said.join(values, "gram").groupBy("key").agg(F.sum("times").alias("m"), *sums)
    mean = F.array(*[F.coalesce(F.col(f"s{k}") / F.col("m"), F.lit(0.0)) for k in range(len(model.languages))])
    out = texts.where("words <> ''").select("key").join(per, "key", "left").withColumn("mean", mean)
    out = out.withColumn("mean", F.transform("mean", lambda x: x - F.array_max("mean")))
    names = F.array(*[F.lit(g) for g in model.languages])
    first = F.array_position(F.transform("mean", lambda x: x >= -1e-12), F.lit(True)).cast("int")
    best = F.when(F.col("mean")[model.likeliest] >= -1e-12, F.lit(model.likeliest + 1)).otherwise(first)
    share = 1 / F.aggregate("mean", F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x))
    out = out.select("key", F.element_at(names, best).alias("__lang"), share.alias("__score"))
    docs = docs.join(out, text_key(F.col(text)) == F.col("key"), "left").drop("key")
    return docs.withColumn("__lang", F.coalesce("__lang", F.lit(UNKNOWN))).withColumn("__score", F.coalesce("__score", F.lit(0.0)))
