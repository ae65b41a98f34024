"""Sinks: partitioned tables, CSV with metadata, nested JSON, reports. Nothing passes the driver but what is one file by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema])


def save(df: DataFrame, path: str, partition_by: list[str] | None = None, overwrite: bool = False, digits: int | None = None) -> None:
    """Parquet by partitions; what is there stays unless overwrite is set, and then only the partitions written change."""
    out = df if digits is None else rounded(df, digits)
    w = out.write.mode("overwrite" if overwrite else "ignore").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def save_csv(df: DataFrame, path: str, metadata: dict[str, str] | None = None, digits: int = 6) -> None:
    """CSV with header; metadata as '# key: value' lines in a file of its own beside the parts, where readers that skip
    comments see it as well."""
    rounded(df, digits).write.mode("overwrite").option("header", True).csv(path)
    if metadata:
        lines = df.sparkSession.createDataFrame([(f"# {k}: {v}",) for k, v in metadata.items()], "value string")
        lines.coalesce(1).write.mode("append").text(path)


def save_json(df: DataFrame, path: str, digits: int | None = None) -> None:
    (df if digits is None else rounded(df, digits)).write.mode("overwrite").json(path)


def nested(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """A `json` column: {group: {features: {...}}} from columns by group."""
    return df.withColumn("json", F.to_json(F.struct(*[F.struct(F.struct(*cols).alias("features")).alias(g) for g, cols in groups.items()])))


def report(df: DataFrame, label: str) -> DataFrame:
    """metric, value rows of the numeric columns' means, with the number of rows."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    one = df.agg(F.count(F.lit(1)).cast("double").alias("n_rows"), *[F.avg(c).alias(c) for c in numeric])
    return one.unpivot([], ["n_rows", *numeric], "metric", "value").withColumn("report", F.lit(label))
