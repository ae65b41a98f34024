"""Shared plumbing: shared-folder tables, exact text keys, deterministic folds and bounded-size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, one of our own serves a local master; on a cluster executors wouldn't see it, so that is
    an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(spark, "_own_shared_dir", None) or tempfile.mkdtemp(prefix="shared_")
        spark._own_shared_dir = folder
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back.

    Unlike an executor-local cache the table outlives any executor that made it.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    _leaves(df.sparkSession, "path", path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table in the warehouse, bucketed by key: later joins by key don't move its rows."""
    spark, name = df.sparkSession, f"texts_{uuid.uuid4().hex}"
    _leaves(spark, "table", name)
    df.write.bucketBy(parts_for(spark, 8), key).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _left(spark: SparkSession) -> list[tuple[str, str, str]]:
    """What this session has written: (kind, name, owner)."""
    if not hasattr(spark, "_llm_left"):
        spark._llm_left = []
    return spark._llm_left


def _leaves(spark: SparkSession, kind: str, name: str) -> None:
    _left(spark).append((kind, name, getattr(spark, "_llm_owner", "")))


@contextmanager
def owned(spark: SparkSession, owner: str, docs: DataFrame) -> Iterator[None]:
    """Deletes what the owner has left before, but for what docs still reads, and notes what is written from now on as its own."""
    clear(spark, owner, docs)
    before, spark._llm_owner = getattr(spark, "_llm_owner", ""), owner
    try:
        yield
    finally:
        spark._llm_owner = before


def clear(spark: SparkSession, owner: str | None = None, docs: DataFrame | None = None) -> int:
    """Deletes the intermediate files and tables that the operators have written in this session; gives their number.

    With an owner only what is noted as its own, and with docs only what docs doesn't read. Results are lazy and read them, so
    they must be stored first.
    """
    gone = [x for x in _left(spark) if owner is None or x[2] == owner]
    if docs is not None and gone:
        read = {part for f in docs.inputFiles() for part in f.split("/")}
        gone = [x for x in gone if x[1].rsplit("/", 1)[-1] not in read]
    for kind, name, _ in gone:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _left(spark)[:] = [x for x in _left(spark) if x not in gone]
    return len(gone)


def numbered(docs: DataFrame, *cols: str, added: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """docs with columns c0, c1, ..., which no column of an operator's own can clash with; its names; and the new ones of cols.

    Columns that bear the name of one to be added give way to it.
    """
    names = [c for c in docs.columns if c not in added]
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), names, [f"c{names.index(c)}" for c in cols]


def text_key(text: Column) -> Column:
    """A 20-byte key under which equal texts, and only they, meet."""
    return F.unhex(F.sha1(text.cast("binary")))


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """key binary, text string, copies long: one row for each different text that isn't null.

    Copies meet on the map side first, so a group of copies of any size sends one row from each task.
    """
    t = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return t.groupBy(text_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def parts_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
