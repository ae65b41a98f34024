"""Homomorphic multiset fingerprints of documents. DataFrame functions only.

A document is the multiset of its paragraphs: lines, cut again at sentence ends. Each paragraph is hashed to a wide vector of
LANES bits, and the fingerprint is the sum of these vectors and of their number. Three lanes of 20 bits share a word and
words add modulo 2**60, so a sum doesn't depend on order, and a paragraph can be put in or taken out by one addition or
subtraction (`added`, `removed`) without the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StructField, StructType

from dyadspark.llm.common import parts_for, written

PARAGRAPH = r"\n+|(?<=[.!?])\s+"
LANE_BITS, PER_WORD, HASHES = 20, 3, 2
LANES = LANE_BITS * PER_WORD * HASHES
MASK = sum(1 << LANE_BITS * i for i in range(PER_WORD))
MOD = (1 << LANE_BITS * PER_WORD) - 1
NO_ID = -(2**63)


def paragraphs(text: Column, pattern: str = PARAGRAPH) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern, -1), lambda x: x != "")


def words_of(units: Column) -> Column:
    """array<long>: the number of units, then LANE_BITS words for each hash; each the sum over units modulo 2**60."""
    hashed = F.transform(units, lambda u: F.struct(*[F.xxhash64(u, F.lit(seed)).alias(f"h{seed}") for seed in range(HASHES)]))

    def term(j: Column, p: Column) -> Column:
        out = F.lit(1).cast("long")
        for seed in range(HASHES):
            bits = F.call_function("shiftrightunsigned", p[f"h{seed}"], j - 1 - seed * LANE_BITS).bitwiseAND(F.lit(MASK))
            out = F.when(j > seed * LANE_BITS, bits).otherwise(out)
        return out

    zero = F.array_repeat(F.lit(0).cast("long"), 1 + HASHES * LANE_BITS)
    return F.aggregate(hashed, zero, lambda acc, p: F.transform(acc, lambda a, j: (a + term(j, p)).bitwiseAND(F.lit(MOD))))


def _merged(a: Column, b: Column, sign: int) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y if sign > 0 else x - y + F.lit(MOD + 1)).bitwiseAND(F.lit(MOD)))


def added(words: Column, units: Column) -> Column:
    """The words after the units have joined the document, without its text."""
    return _merged(words, words_of(units), 1)


def removed(words: Column, units: Column) -> Column:
    """The words after the units have left the document."""
    return _merged(words, words_of(units), -1)


def digest(words: Column) -> Column:
    """The fingerprint as text: the words in hex, 15 digits each."""
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 15, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the sums, each bit taken as -1 or 1; near the share of paragraphs in common.

    Fingerprints without paragraphs are alike (1) only among themselves.
    """

    def centred(words: Column) -> Column:
        lane = lambda w, i: F.call_function("shiftright", w, F.lit(LANE_BITS * i)).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
        body = F.slice(words, 2, HASHES * LANE_BITS)
        return F.flatten(F.transform(body, lambda w: F.array(*[(lane(w, i) * 2 - F.element_at(words, 1)).cast("double") for i in range(PER_WORD)])))

    x, y = centred(a), centred(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, F.lit(1.0)).when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(x, y) / norm))).otherwise(F.lit(0.0))


def _with_next(docs: DataFrame, id_col: str) -> DataFrame:
    """docs (__key long, text, words) with next_text, next_words: of the next row by key then text; after the last, the first.

    No task sees all rows: approximate quantiles cut the keys into ranges, and each range also gets the first row of the
    next one. Only the quantiles and each range's least key, a number set by the shuffle partitions, pass the driver.
    """
    spark, n = docs.sparkSession, 4 * parts_for(docs.sparkSession, 8)
    ids = docs.select("__key")
    cuts = ids.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], 4 * n).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    span = F.aggregate(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), F.lit(0), lambda s, c: s + F.when(c <= F.col("__key"), 1).otherwise(0)) if cuts else F.lit(0)
    first = sorted((r.span, r.least) for r in ids.groupBy(span.alias("span")).agg(F.min("__key").alias("least")).collect())
    if not first:
        return docs.withColumn("next_text", F.lit("")).withColumn("next_words", F.col("words"))
    heads = [(least, first[i - 1][0]) for i, (_, least) in enumerate(first)]
    after = spark.createDataFrame(heads, "__key long, span int")
    rows = docs.withColumn("span", span.cast("int")).withColumn("guest", F.lit(False))
    guests = docs.join(F.broadcast(after), "__key").withColumn("guest", F.lit(True)).select(rows.columns)
    w = Window.partitionBy("span").orderBy("guest", "__key", "text")
    out = rows.unionByName(guests)
    return out.withColumn("next_text", F.lead("text").over(w)).withColumn("next_words", F.lead("words").over(w)).where(~F.col("guest")).drop("span", "guest")


def _with_next_by_range(docs: DataFrame) -> DataFrame:
    """The same for ids of any other type that has an order: Spark's ranges of it, written so that they stay as they are."""
    spark, n = docs.sparkSession, 4 * parts_for(docs.sparkSession, 8)
    rows = written(docs.repartitionByRange(n, "id").withColumn("span", F.spark_partition_id()), "ranges")
    first = sorted((r.span, r.least.id) for r in rows.groupBy("span").agg(F.min(F.struct("id")).alias("least")).collect())
    if not first:
        return docs.withColumn("next_text", F.lit("")).withColumn("next_words", F.col("words"))
    heads = [(least, first[i - 1][0]) for i, (_, least) in enumerate(first)]
    after = spark.createDataFrame(heads, StructType([StructField("__least", docs.schema["id"].dataType), StructField("__span", IntegerType())]))
    rows = rows.withColumn("guest", F.lit(False))
    guests = rows.join(F.broadcast(after), F.col("id").eqNullSafe(F.col("__least"))).withColumns({"guest": F.lit(True), "span": F.col("__span")}).select(rows.columns)
    w = Window.partitionBy("span").orderBy("guest", "id", "text")
    out = rows.unionByName(guests)
    return out.withColumn("next_text", F.lead("text").over(w)).withColumn("next_words", F.lead("words").over(w)).where(~F.col("guest")).drop("span", "guest")


def fingerprint_documents(docs: DataFrame, id_col: str, text_col: str, pattern: str = PARAGRAPH) -> DataFrame:
    """id, text, words array<long>, fingerprint: one row for each row of docs; null texts count as empty.

    Empty texts have no paragraphs and one fingerprint, of zeros. Texts with the same paragraphs in another order have
    equal fingerprints. Repeated rows give repeated rows; no other column is read, so their names can't clash.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.withColumn("words", words_of(paragraphs(F.col("text"), pattern))).withColumn("fingerprint", digest(F.col("words")))


def edited_neighbours(docs: DataFrame, id_col: str, text_col: str, pattern: str = PARAGRAPH) -> DataFrame:
    """Fingerprints each text, its edited form (its last half replaced by the start of the next document) and compares them.

    Ids have the order of their type, be they numbers, texts or times. Ids that are null come first; rows with one id are
    ordered by text, in one task. A single document is its own next one.
    """
    base = fingerprint_documents(docs, id_col, text_col, pattern).drop("fingerprint")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    if isinstance(base.schema["id"].dataType, IntegralType):
        out = _with_next(base.withColumn("__key", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID))), "id")
    else:
        out = _with_next_by_range(base)
    out = out.withColumn("n_chars", n.cast("long"))
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    out = out.withColumn("edited_words", words_of(paragraphs(F.col("edited"), pattern)))
    return out.select(
        "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest(F.col("words")).alias("fingerprint"), digest(F.col("edited_words")).alias("edited_fingerprint"),
        likeness(F.col("words"), F.col("edited_words")).alias("near_edited"), likeness(F.col("words"), F.col("next_words")).alias("near_next"),
    )
