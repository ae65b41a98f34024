"""False-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def benjamini_hochberg(df: DataFrame, p: str, within: list[str] | None = None, out: str = "p_fdr") -> DataFrame:
    """p_fdr over the non-null p of each result set: the least of p m / rank over all p no smaller. Tied p are peers.

    A result set is one partition: its rows are tests, of which there are dimensions times lags at most.
    """
    own = Window.partitionBy(*(within or [F.lit(0)]), F.col(p).isNull())
    x = F.col(p) * F.count(p).over(own) / F.row_number().over(own.orderBy(p))
    least = F.min("__x").over(own.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__x", x).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("__x")
