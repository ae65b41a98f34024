"""Sentences, heuristic labels, perturbations, dialogue statistics, transcripts, sentiment and agreement scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dyadspark.functions.columns import clip, held
from dyadspark.operators import pairwise

#: What negates, in a text with a blank before and after it.
NEGATIONS = (" not ", "n't", " never ", " no ")
#: Weights (rows: negative, neutral, positive; columns: angry, happy, sad, neutral) and biases.
WEIGHTS = ((2.10, -1.35, 1.75, -0.42), (-0.35, 0.42, -0.28, 1.67), (-1.85, 2.24, -1.47, 0.31))
BIASES = (-0.22, 0.10, 0.12)
SENTIMENTS = ("negative", "neutral", "positive")


def sentences_kept(text: Column) -> Column:
    """Cut after stops, which stay; the whole text where there is nothing to cut."""
    parts = F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def sentences_bare(text: Column) -> Column:
    """Cut at runs of stops, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")


def paragraphs(text: Column, long: int = 200, group: int = 3) -> Column:
    """Cut at blank lines; one long paragraph is cut to groups of three sentences."""
    p = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = lambda s: F.floor((F.size(s) + group - 1) / group).cast("int")
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(n(s) - 1, F.lit(0))), lambda i: F.array_join(F.slice(s, i * group + 1, F.lit(group)), " "))
    groups = held(sentences_kept(text), cut)
    return F.when((F.size(p) == 1) & (F.length(text) > long), groups).otherwise(p)


def consecutive(sentences: Column) -> Column:
    """Pairs (left, right) of neighbours; a single sentence stands with itself."""
    two = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.struct(F.element_at(s, i).alias("left"), F.element_at(s, F.least(i + 1, F.size(s))).alias("right")))
    return held(sentences, lambda s: F.when(F.size(s) > 0, two(s)))


def negated(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    out = F.lit(False)
    for n in NEGATIONS:
        out = out | F.contains(padded, F.lit(n))
    return out


def inference_label(premise: Column, hypothesis: Column) -> Column:
    """neutral for a blank hypothesis, entailment where one holds the other, contradiction where only one negates, else neutral."""
    a, b = F.lower(premise), F.lower(hypothesis)
    label = F.when(F.trim(b) == "", "neutral").when(F.contains(a, b) | F.contains(b, a), "entailment")
    return label.when(negated(premise) != negated(hypothesis), "contradiction").otherwise("neutral")


def label_name(label: Column) -> Column:
    """Labels in one spelling; the rules apply in order, so 'unacceptable' is met by 'acceptable'."""
    x = F.lower(label)
    has = lambda *parts: F.greatest(*[F.contains(x, F.lit(p)) for p in parts]) if len(parts) > 1 else F.contains(x, F.lit(parts[0]))
    out = F.when(has("entail") | x.endswith("_2"), "entailment").when(has("contrad") | x.endswith("_0"), "contradiction").when(has("neutral") | x.endswith("_1"), "neutral")
    return out.when(has("acceptable"), "acceptable").when(has("duplicate", "paraphrase", "yes"), "positive").when(has("no"), "negative").otherwise(x)


def answerable(question: Column, statement: Column) -> Column:
    """Both share a word of more than three characters."""
    words = lambda t: F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"(\w+)")), lambda w: F.length(w) > 3)
    return F.arrays_overlap(words(question), words(statement))


def acceptable(sentence: Column) -> Column:
    """Three words at least, no lower-case start, as many brackets opened as closed, no word over 25 characters."""
    words = F.filter(F.split(F.trim(sentence), r"\s+"), lambda w: w != "")
    count = lambda c: F.length(sentence) - F.length(F.replace(sentence, F.lit(c), F.lit("")))
    start = F.substring(sentence, 1, 1)
    lower_start = (start == F.lower(start)) & (start != F.upper(start))
    return (F.size(words) >= 3) & ~lower_start & (count("(") == count(")")) & ~F.exists(words, lambda w: F.length(w) > 25)


def perturbations(sentence: Column) -> dict[str, Column]:
    """The sentence changed in one way each; replacements of ' not ' and "n't" touch the first one only."""
    words = F.filter(F.split(F.trim(sentence), r"\s+"), lambda w: w != "")
    lower = F.lower(sentence)
    first = lambda x: F.concat(F.substring_index(sentence, x, 1), F.lit(" " if x == " not " else ""), F.substring(sentence, F.locate(x, sentence) + len(x), F.length(sentence)))
    without = lambda x: F.when(F.locate(x, sentence) > 0, first(x)).otherwise(sentence)
    return {
        "lowered": lower,
        "rotated": F.when(F.size(words) >= 3, F.concat_ws(" ", F.slice(words, F.lit(2), F.size(words)), F.slice(words, 1, 1))).otherwise(sentence),
        "the_to_a": F.regexp_replace(sentence, r"(?i)\bthe\b", "a"),
        "expanded": F.concat(sentence, F.lit(" in this context.")),
        "negated": F.when(F.contains(lower, F.lit(" not ")), without(" not ")).when(F.contains(lower, F.lit("n't")), without("n't")).otherwise(F.concat(sentence, F.lit(" not"))),
        "repeated": F.concat_ws(" ", sentence, sentence),
        "inverted": F.reverse(sentence),
        "asked": F.concat(F.lit("What happens when "), lower),
    }


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two strings, as they are; there is no built-in like it. For sentences, not documents: its time is quadratic."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=object)


def text_counts(text: Column) -> list[Column]:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return [F.length(text).cast("long").alias("n_chars"), F.size(words).cast("long").alias("n_words"), F.size(sentences_bare(text)).cast("long").alias("n_sentences")]


def conversation_stats(turns: DataFrame, conversation: str, order: str, speaker: str, text: str) -> DataFrame:
    """Words, distinct words, utterance lengths, speakers, turn changes and duration (2.5 words a second) by conversation."""
    w = Window.partitionBy(conversation).orderBy(order)
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda x: x != "")
    x = turns.withColumn("__words", words).withColumn("__n", F.size("__words")).withColumn("__turn", F.when(F.lag(speaker).over(w) != F.col(speaker), 1).otherwise(0))
    counts = x.groupBy(conversation).agg(F.count(F.lit(1)).alias("num_utterances"), F.sum("__n").alias("num_words"), F.avg("__n").alias("avg_utterance_length"), F.max("__n").cast("long").alias("max_utterance_length"), F.count_distinct(speaker).alias("num_speakers"), (F.sum("__turn") + 1).alias("num_dialogues"))
    unique = x.select(conversation, F.explode("__words").alias("word")).groupBy(conversation).agg(F.count_distinct("word").alias("unique_words"))
    return counts.join(unique, conversation, "left").withColumn("unique_words", F.coalesce("unique_words", F.lit(0))).withColumn("duration", F.col("num_words") / F.lit(2.5))


def changes(rows: DataFrame, within: list[str], order: str, column: str) -> DataFrame:
    """How often a label differs from the one before."""
    w = Window.partitionBy(*within).orderBy(order)
    return rows.withColumn("__c", F.when(F.lag(column).over(w) != F.col(column), 1).otherwise(0)).groupBy(*within).agg(F.sum("__c").alias("n_changes"))


def label_shares(rows: DataFrame, within: list[str], label: str, labels: list[str]) -> DataFrame:
    """Share of each label (uniform where there are none), the greatest one and its share."""
    counts = [F.count_if(F.col(label) == v).cast("double").alias(f"__{v}") for v in labels]
    x = rows.groupBy(*within).agg(*counts)
    total = sum((F.col(f"__{v}") for v in labels), F.lit(0.0))
    x = x.select(*within, *[F.when(total > 0, F.col(f"__{v}") / total).otherwise(F.lit(1.0 / len(labels))).alias(f"share_{v}") for v in labels])
    top = F.array_max(F.array(*[F.struct(F.col(f"share_{v}").alias("s"), F.lit(-i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(labels)]))
    return x.withColumn("dominant", top["v"]).withColumn("intensity", top["s"])


def speaker_summary(words: DataFrame, recording: str) -> DataFrame:
    """Words, speaking time (of words that end after they start) and mean score of each speaker."""
    time = F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start")).otherwise(F.lit(0.0))
    return words.groupBy(recording, "speaker").agg(F.count(F.lit(1)).alias("n_words"), F.sum(time).alias("speaking_time"), F.avg("score").alias("avg_score"))


def capped_speakers(rows: DataFrame, recording: str, most: int) -> DataFrame:
    """Speakers past the `most` first by name are taken for one of these, in turn."""
    names = rows.select(recording, "speaker").distinct()
    names = names.withColumn("rank", F.row_number().over(Window.partitionBy(recording).orderBy("speaker")) - 1)
    kept = names.where(F.col("rank") < most).select(recording, F.col("rank").alias("slot"), F.col("speaker").alias("mapped"))
    return rows.join(names.withColumn("slot", F.col("rank") % most).join(kept, [recording, "slot"]).select(recording, "speaker", "mapped"), [recording, "speaker"])


def uniform_alignment(text: Column, duration: Column) -> Column:
    """Words at even steps over the duration, a quarter second each at least."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    steps = held(words, lambda x: F.struct(x.alias("words"), F.try_divide(F.greatest(duration, 0.25 * F.size(x)), F.size(x)).alias("step")))
    return held(steps, lambda x: F.transform(x["words"], lambda w, i: F.struct(w.alias("word"), F.round(i * x["step"], 3).alias("start"), F.round((i + 1) * x["step"], 3).alias("end"))))


def logistic_sentiment(angry: Column, happy: Column, sad: Column, neutral: Column, loudness: Column, voicing: Column) -> list[Column]:
    """Shares of sentiments from emotion scores by a softmax of fixed weights, moved by energy, then scaled to 1 again."""
    raw = [F.coalesce(x, F.lit(0.0)) for x in (angry, happy, sad, neutral)]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    v = [F.when(total > 0, x / total).otherwise(F.lit(0.25)) for x in raw]
    e = [F.exp(sum((v[k] * w for k, w in enumerate(row)), F.lit(b))) for row, b in zip(WEIGHTS, BIASES, strict=True)]
    z = e[0] + e[1] + e[2]
    move = clip(0.35 * F.coalesce(loudness, F.lit(0.0)) + 0.15 * F.coalesce(voicing, F.lit(0.0)), -0.5, 0.5)
    p = [F.greatest(F.lit(1e-5), x / z + m) for x, m in zip(e, (-move, -0.5 * move, move), strict=True)]
    z = p[0] + p[1] + p[2]
    p = [x / z for x in p]
    top = F.array_max(F.array(*[F.struct(x.alias("p"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, (x, s) in enumerate(zip(p, SENTIMENTS, strict=True))]))
    return [*[x.alias(f"arvs_{s}") for x, s in zip(p, SENTIMENTS, strict=True)], top["s"].alias("arvs_dominant_sentiment"), top["p"].alias("arvs_confidence")]


def hashed_embedding(text: Column) -> Column:
    """128 numbers: the 32 bytes of the text's SHA-256 four times over, standardised (population sd, + 1e-6)."""
    digest = F.sha2(text, 256)
    one = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double"))
    mean = F.aggregate(one, F.lit(0.0), lambda s, x: s + x) / 32
    sd = F.sqrt(F.aggregate(one, F.lit(0.0), lambda s, x: s + F.pow(x - mean, 2)) / 32)
    return F.flatten(F.array_repeat(F.transform(one, lambda x: (x - mean) / (sd + 1e-6)), 4))


def first_text(*candidates: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in candidates])


def clean_name(name: Column) -> Column:
    """Acoustic feature names in one spelling: numbered cepstra, filter bands and line spectra, else signs as underscores."""
    low = F.lower(name)
    number = lambda pattern, of: F.regexp_extract(of, pattern, 1)
    has = lambda c, x: F.contains(c, F.lit(x))
    cepstrum, band, line = number(r"mfcc.*?(\d+)", low), number(r"(\d+)", name), number(r"(\d+)", name)
    plain = F.concat(F.lit("osm_"), F.translate(F.replace(name, F.lit("]"), F.lit("")), "[.-", "___"))
    return (
        F.when(has(low, "mfcc") & has(name, "sma") & (cepstrum != ""), F.concat(F.lit("osm_mfcc"), cepstrum, F.lit("_sma")))
        .when(has(low, "audspec") & has(low, "rfilt") & (band != ""), F.concat(F.lit("osm_audSpec_Rfilt_sma_"), band))
        .when((has(low, "lsf") | has(low, "lsp")) & (line != ""), F.concat(F.lit("osm_lsf"), line))
        .otherwise(plain)
    )


def agreement(rows: DataFrame, within: list[str], score: str, truth: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and Matthews correlation of score >= threshold against 0/1 truth."""
    p = F.col(score) >= threshold
    t = F.col(truth) == 1
    x = rows.groupBy(*within).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"), F.avg(score).alias("__mean"))
    d = {c: F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")}
    n = d["tp"] + d["fp"] + d["fn"] + d["tn"]
    precision, recall = F.coalesce(F.try_divide(d["tp"], d["tp"] + d["fp"]), F.lit(0.0)), F.coalesce(F.try_divide(d["tp"], d["tp"] + d["fn"]), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    root = F.sqrt((d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"]))
    mcc = F.coalesce(F.try_divide(d["tp"] * d["tn"] - d["fp"] * d["fn"], root), F.lit(0.0))
    one_class = (d["tp"] + d["fn"] == 0) | (d["fp"] + d["tn"] == 0)
    return x.select(*within, "tp", "fp", "fn", "tn", F.when(one_class, F.col("__mean")).otherwise((d["tp"] + d["tn"]) / n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), mcc.alias("mcc"))


def label_matches(rows: DataFrame, within: list[str], predicted: str, target: str, score: str, place: str) -> DataFrame:
    """n, matched and mismatched: the share of predictions that equal their target, over pairs at even and at odd places; the
    mean score where none of a kind does, null where there are none of a kind."""

    def share(odd: int) -> Column:
        own = F.col(place) % 2 == odd
        hit = F.when(own, (F.col(predicted) == F.col(target)).cast("double"))
        return F.when(F.max(hit) > 0, F.avg(hit)).otherwise(F.avg(F.when(own, F.col(score))))

    return rows.groupBy(*within).agg(F.count(F.lit(1)).alias("n"), share(0).alias("matched"), share(1).alias("mismatched"))


def questions_and_statements(sentences: Column) -> tuple[Column, Column]:
    """The sentences that end in a question mark and the others; the first of all stands where there are none of a kind."""
    asks = lambda s: F.endswith(s, F.lit("?"))
    first = F.slice(sentences, 1, 1)
    some = lambda x: F.when(F.size(x) > 0, x).otherwise(first)
    return some(F.filter(sentences, asks)), some(F.filter(sentences, lambda s: ~asks(s)))


def ranked_passages(scored: DataFrame, within: list[str], score: str, tie: str, top: int = 10) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", k).where(F.col("rank") <= top)


def embedding_spread(vectors: DataFrame, within: list[str], vector: str) -> DataFrame:
    """Mean and variance (population) of the distances to the group's centroid."""
    return pairwise.spread(vectors, within, vector)


def alternating_speakers(sentences: Column) -> Column:
    """Utterances where nobody knows who speaks: sentences by two speakers in turn, with their numbers of letters and words."""
    words = lambda s: F.size(F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != ""))
    return F.transform(sentences, lambda s, i: F.struct(F.concat(F.lit("SPEAKER_0"), (i % 2).cast("string")).alias("speaker"), s.alias("text"), F.length(s).alias("length"), words(s).alias("word_count")))


def correlation_score(rows: DataFrame, within: list[str], prediction: str, target: str, order: str) -> DataFrame:
    """Mean of Pearson's and Spearman's r of predictions and targets. One pair, or targets all alike, give the first prediction in
    the given order; predictions all alike give their mean."""
    # equal pairs are one row with their number: what is sorted for the ranks is distinct pairs, not rows
    x = rows.where(F.col(prediction).isNotNull() & F.col(target).isNotNull())
    x = x.groupBy(*within, F.col(prediction).alias("__p"), F.col(target).alias("__t")).agg(F.count(F.lit(1)).alias("__k"), F.min(order).alias("__o"))
    whole = Window.partitionBy(*within)

    def rank(c: str) -> Column:
        upto, ties = F.sum("__k").over(whole.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("__k").over(Window.partitionBy(*within, c))
        return upto - (ties - 1) / F.lit(2.0)

    x = x.withColumn("__rp", rank("__p")).withColumn("__rt", rank("__t"))
    # squares are of differences from the mean
    names = ("__p", "__t", "__rp", "__rt")
    weight = lambda c: F.sum(F.col("__k") * c)
    mean = {c: weight(F.col(c)).over(whole) / F.sum("__k").over(whole) for c in names}
    x = x.select("*", *[(F.col(c) - mean[c]).alias(f"{c}_d") for c in names])

    def r(a: str, b: str) -> Column:
        da, db = F.col(f"{a}_d"), F.col(f"{b}_d")
        return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), weight(da * db) / F.sqrt(weight(da * da) * weight(db * db)))

    out = x.groupBy(*within).agg(F.sum("__k").alias("n"), (F.min("__t") == F.max("__t")).alias("__alike"), F.min_by("__p", "__o").alias("__first"), (weight(F.col("__p")) / F.sum("__k")).alias("__mean"), r("__p", "__t").alias("pearson"), r("__rp", "__rt").alias("spearman"))
    score = F.when(F.col("__alike"), F.col("__first")).otherwise(F.coalesce((F.col("pearson") + F.col("spearman")) / 2, F.col("__mean")))
    return out.select(*within, "n", "pearson", "spearman", score.alias("score"))


def positive_score(candidates: Column, prefixes: list[str]) -> Column:
    """Score of the first candidate (label, score) whose label, in lower case, starts with one of the prefixes; else the best score."""
    positive = F.filter(candidates, lambda c: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.lower(F.trim(c["label"])), p)))
    return F.coalesce(F.try_element_at(positive, F.lit(1))["score"], F.array_max(F.transform(candidates, lambda c: c["score"])))


def distinct_sentences(text: Column) -> Column:
    """Sentences in order, each once."""
    return F.array_distinct(sentences_kept(text))
