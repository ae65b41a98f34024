"""Scans of recordings and results: time columns, subjects, regions, states, commented files, discovery and path attributes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of time columns in order of preference, and those that may hold milliseconds.
TIME_COLUMNS, MS_COLUMNS = ("time_seconds", "time", "window_time", "time_second"), ("Timestamp", "VideoTime")
METHODS = ("grouped-pca", "grouped", "pca", "fa", "ica", "cca", "cluster", "every")


def scan(spark: SparkSession, path: str | list[str], schema: str | None = None, comment: bool = False) -> DataFrame:
    """CSV (with header; '#' lines skipped if asked), JSON or Parquet by extension. A schema saves the pass that infers it."""
    first = path if isinstance(path, str) else path[0]
    if first.rstrip("/").endswith((".parquet", "/")) or "." not in first.rsplit("/", 1)[-1]:
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if first.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    reader = spark.read.option("header", True)
    reader = reader.option("comment", "#") if comment else reader
    return reader.csv(path, schema=schema) if schema else reader.option("inferSchema", True).csv(path)


def resolved_time(df: DataFrame, entity: list[str], always_ms: bool = False) -> DataFrame:
    """time_seconds from the first time column there is; Timestamp and VideoTime count as milliseconds where an entity's
    greatest exceeds 1000 (always, if asked). Raises without any time column."""
    for c in TIME_COLUMNS:
        if c in df.columns:
            return df.withColumnRenamed(c, "time_seconds")
    for c in MS_COLUMNS:
        if c in df.columns:
            t = F.col(c).cast("double")
            if always_ms:
                return df.withColumn("time_seconds", t / 1000).drop(c)
            # one row an entity; null-safe, for rows without an entity have a greatest time as well
            keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(entity)] or [F.lit(0).alias("__k0")]
            ms = df.groupBy(*keys).agg((F.max(t) > 1000).alias("__ms"))
            same = reduce(and_, [(F.col(k) if entity else F.lit(0)).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(entity or [""])])
            out = df.join(ms if entity else F.broadcast(ms), same, "left")  # without an entity: a single row
            return out.withColumn("time_seconds", F.when(F.col("__ms"), t / 1000).otherwise(t)).drop(c, "__ms", *[f"__k{i}" for i in range(len(keys))])
    raise ValueError(f"no time column among {df.columns}")


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema])


def load_features(df: DataFrame, entity: list[str]) -> DataFrame:
    """Long series (entity, feature, t, value) of a wide recording table: NaN and -100 are null, frame numbers are dropped."""
    from dyadspark.operators.describe import unpivoted

    x = nan_to_null(resolved_time(df, entity))
    x = x.drop("frame_idx", "bin_time")
    out = unpivoted(x, [*entity, "time_seconds"]).withColumnRenamed("time_seconds", "t")
    return out.withColumn("value", F.nullif("value", F.lit(-100.0)))


def load_target(df: DataFrame, entity: list[str], value: str = "Value") -> DataFrame:
    """A target's t and value; VideoTime is always in milliseconds here."""
    x = df if "time_seconds" in df.columns else resolved_time(df.select(*entity, "VideoTime", value), entity, True)
    return x.select(*entity, F.col("time_seconds").alias("t"), F.col(value).cast("double").alias("value"))


def load_subjects(df: DataFrame) -> DataFrame:
    if "subject" not in df.columns:
        raise ValueError("a subject column is needed")
    return df.withColumn("subject", F.col("subject").cast("string"))


def facing(series: DataFrame, subjects: DataFrame) -> DataFrame:
    """series with facing_direction; Spark broadcasts the subjects if they turn out small."""
    return series.join(subjects.select("subject", "facing_direction"), "subject", "left")


def load_states(df: DataFrame) -> DataFrame:
    time = F.coalesce(*[F.col(c) for c in ("time_seconds", "bin_time") if c in df.columns])
    return df.select(time.alias("t"), F.round("state").cast("int").alias("state"), *[c for c in df.columns if c not in ("time_seconds", "bin_time", "state")])


def header_metadata(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value of '# key: value' lines."""
    lines = spark.read.text(path).where(F.col("value").startswith("#")).select(F.col("_metadata.file_path").alias("file"), "value")
    kv = F.split(F.regexp_replace("value", r"^#\s*", ""), ":", 2)
    return lines.where(F.size(kv) == 2).select("file", F.trim(kv[0]).alias("key"), F.trim(kv[1]).alias("value"))


def discovered(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """path, length and time of files below a directory by glob, without those in an output folder named `group`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(directory)
    return files.select("path", "length", "modificationTime").where(~F.col("path").contains("/group/"))


def path_attributes(path: Column) -> dict[str, Column]:
    """subject, pair, dyad and reduction method from a path."""
    some = lambda x: F.when(x != "", x)
    method = None
    for m in METHODS:
        hit = path.rlike(f"[/_-]{m}([/_.]|$)")
        method = F.when(hit, m) if method is None else method.when(hit, m)
    return {
        "subject": some(F.regexp_extract(path, r"(sub\d+)", 1)), "sub_a": some(F.regexp_extract(path, r"(sub\d+)_(sub\d+)", 1)), "sub_b": some(F.regexp_extract(path, r"(sub\d+)_(sub\d+)", 2)),
        "dyad": some(F.regexp_extract(path, r"(dyad[^/_]+)", 1)), "method": method, "rater": some(F.regexp_extract(path, r"([^/]+)_rates_([^/]+)_correlation", 1)), "target_id": some(F.regexp_extract(path, r"([^/]+)_rates_([^/]+)_correlation", 2)),
    }


def discovery_counts(files: DataFrame) -> DataFrame:
    a = path_attributes(F.col("path"))
    return files.select(*[v.alias(k) for k, v in a.items()]).groupBy("method").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("dyad").alias("n_dyads"), F.count_distinct("subject").alias("n_subjects"))


def regions(config: DataFrame, column: str) -> DataFrame:
    """roi, feature rows of a JSON object of arrays."""
    m = F.from_json(column, "map<string,array<string>>")
    return config.select(F.explode(m).alias("roi", "channels")).select("roi", F.explode("channels").alias("feature"))
