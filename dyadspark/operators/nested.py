"""Analyzer output of any shape, as VARIANT: features out of groups, scalars out of arrays, the text out of the keys that may hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that may hold a transcript, in order, and what an object under one of them may hold it in.
TEXT_KEYS = ("transcription", "whisperx_transcription", "transcript", "text", "speech_text", "transcribed_text")
INNER_KEYS = ("text", "transcription")
#: Keys that hold no features of a recording.
SKIPPED = ("per_frame", "GMP_SM_pic", "video_path")


def _fields(v: Column, path: str = "$") -> Column:
    """An object's fields as a map of variants; null for other kinds of values."""
    return F.try_variant_get(v, path, "map<string,variant>")


def features(df: DataFrame, variant: str, ids: list[str]) -> DataFrame:
    """ids, key, value (variant) of the features of an output in one of three shapes.

    {name: value}; {"features": {name: value}, ...}; or {group: {"features": {...}}, ...} where every group has one. Of groups
    that share a name the last by group name counts. An object in which only some groups have features is taken as flat, and
    what is no object has none. All within the row: nothing is joined or moved.
    """
    v = F.col(variant)
    named = lambda fields, group: F.transform(F.map_entries(fields), lambda f: F.struct(f["key"].alias("key"), group.alias("in"), f["value"].alias("value")))
    whole, direct = _fields(v), _fields(v, "$.features")
    grouped = (F.size(whole) > 0) & F.forall(F.map_values(whole), lambda x: _fields(x, "$.features").isNotNull())
    each = F.flatten(F.transform(F.map_entries(whole), lambda g: named(_fields(g["value"], "$.features"), g["key"])))
    last = F.filter(each, lambda x: ~F.exists(each, lambda y: (y["key"] == x["key"]) & (y["in"] > x["in"])))
    found = F.when(direct.isNotNull(), named(direct, F.lit(""))).when(grouped, last).otherwise(named(whole, F.lit("")))
    return df.select(*ids, F.explode(found).alias("__f")).select(*ids, "__f.key", "__f.value")


def scalars(named: DataFrame, ids: list[str], few: int = 20) -> DataFrame:
    """ids, key, number double, text string: one row for each scalar of features (ids, key, value).

    Arrays of numbers give key_mean, key_std (population), key_min and key_max over what is finite, and key_0, key_1, ... where
    they have `few` elements at most; other arrays, and objects, are JSON in text; empty arrays and nulls give nothing.
    Booleans are text. Keys that are or end in error, and those of whole frames, are left out.
    """
    kept = named.where(~(F.col("key").isin(*SKIPPED) | (F.col("key") == "error") | F.col("key").endswith("_error")))
    number = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"
    x = kept.withColumn("__kind", F.schema_of_variant("value"))
    x = x.withColumn("__n", F.when(F.col("__kind").rlike(f"^ARRAY<{number}>$"), F.try_variant_get("value", "$", "array<double>")))
    row = lambda name, v, text: F.struct(name.alias("key"), v.cast("double").alias("number"), text.cast("string").alias("text"))
    null = F.lit(None)
    at = lambda name: F.concat_ws("_", "key", name)
    finite = F.filter("__n", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x = x.withColumn("__f", finite)
    mean = F.aggregate("__f", F.lit(0.0), lambda s, v: s + v) / F.size("__f")
    x = x.withColumn("__m", F.when(F.size("__f") > 0, mean))
    spread = F.sqrt(F.aggregate("__f", F.lit(0.0), lambda s, v: s + (v - F.col("__m")) * (v - F.col("__m"))) / F.size("__f"))
    summary = F.array(*[row(at(F.lit(n)), v, null) for n, v in (("mean", F.col("__m")), ("std", spread), ("min", F.array_min("__f")), ("max", F.array_max("__f")))])
    none = F.array().cast("array<struct<key:string,number:double,text:string>>")
    each = F.when(F.size("__n") <= few, F.transform("__n", lambda v, i: row(at(i.cast("string")), v, null))).otherwise(none)
    json = F.to_json("value")
    kind = F.col("__kind")
    out = (
        F.when(kind.rlike(f"^{number}$"), F.array(row(F.col("key"), F.try_variant_get("value", "$", "double"), null)))
        .when(kind.isin("STRING", "BOOLEAN"), F.array(row(F.col("key"), null, F.try_variant_get("value", "$", "string"))))
        .when(F.col("__n").isNotNull(), F.concat(F.when(F.size("__f") > 0, summary).otherwise(none), each))
        .when((kind.startswith("ARRAY") & (json != "[]")) | kind.startswith("OBJECT"), F.array(row(F.col("key"), null, json)))
        .otherwise(none)
    )
    return x.select(*ids, F.explode(out).alias("__s")).select(*ids, "__s.key", "__s.number", "__s.text")


def text_of(variant: str) -> Column:
    """The transcript in an output: the first of the keys that holds a text that isn't blank, by itself or in an object's text or transcription."""
    v = F.col(variant)
    at = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    blank = lambda c: F.when(c.rlike(r"\S"), c)
    # of an object's two keys the first that isn't empty counts, even if it is blank
    inner = lambda k: blank(F.coalesce(*[F.nullif(at(f"$.{k}.{i}"), F.lit("")) for i in INNER_KEYS]))
    return F.coalesce(*[c for k in TEXT_KEYS for c in (blank(at(f"$.{k}")), inner(k))])
