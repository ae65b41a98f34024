"""Recordings as text files: media folders by extension, and CSV with a head of `# ` lines, one file a recording or many in a file.

All through Spark's readers and writers, so paths may be remote, files are listed once, and a task that fails leaves no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Extensions of media files by kind.
EXTENSIONS = {"video": ("mp4", "avi", "mov", "mkv"), "audio": ("wav", "mp3", "flac")}


def media(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("video", "audio"), recursive: bool = False) -> DataFrame:
    """path, name, kind, length, modificationTime of the media files in a folder, upper case or lower; no file is opened.

    Raises FileNotFoundError where there are none.
    """
    known = [(e, k) for k in kinds for e in EXTENSIONS[k]]
    glob = "*.{" + ",".join(x for e, _ in known for x in (e, e.upper(), e.capitalize())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder)
    extension = F.lower(F.substring_index("path", ".", -1))
    kind = F.coalesce(*[F.when(extension == e, k) for e, k in known])
    out = files.select("path", F.substring_index("path", "/", -1).alias("name"), kind.alias("kind"), "length", "modificationTime")
    if out.isEmpty():
        raise FileNotFoundError(f"no {' or '.join(kinds)} files in {folder}")
    return out


def _shown(df: DataFrame, digits: int) -> list[Column]:
    """Columns as text: fractions with as many digits, others as they are, nulls as null."""
    return [F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c)) if isinstance(df.schema[c].dataType, (DoubleType, FloatType)) else F.col(c).cast("string") for c in df.columns]


def write_commented(rows: DataFrame, path: str, recording: str, order: list[str], metadata: dict[str, Column], digits: int = 6) -> None:
    """One file a recording below path/<recording>=..: lines `# key: value` of the metadata, the names of the columns, the rows in order.

    metadata: aggregates over a recording's rows. A recording is one file, so its rows meet in one task; nulls are empty fields.
    Quoting is CSV's. The folder is replaced as a whole.
    """
    body = rows.drop(recording)
    names = body.columns
    text = F.to_csv(F.struct(*[c.alias(n) for c, n in zip(_shown(body, digits), names, strict=True)]), {"emptyValue": '""'})
    lines = rows.select(recording, F.lit(1).alias("__part"), F.struct(*order).alias("__at"), text.alias("value"))
    keys = F.array(*[F.concat(F.lit(f"# {k}: "), v.cast("string")) for k, v in metadata.items()])
    head = rows.groupBy(recording).agg(F.concat_ws("\n", keys, F.lit(",".join(names))).alias("value"))
    head = head.select(recording, F.lit(0).alias("__part"), F.lit(None).cast(lines.schema["__at"].dataType).alias("__at"), "value")
    out = head.unionByName(lines).repartition(F.col(recording)).sortWithinPartitions(recording, "__part", "__at")
    out.select(recording, "value").write.mode("overwrite").partitionBy(recording).text(path)


def read_commented(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Rows of all commented CSV files below path with their file and its metadata of the given keys, null where a file has none.

    schema: of the columns and of the folder names. Heads are a few rows a file; rows meet them by the file's name.
    """
    file = F.col("_metadata.file_path").alias("file")
    rows = spark.read.schema(schema).option("header", True).option("comment", "#").option("escape", '"').csv(path)
    lines = spark.read.text(path).select(file, "value").where(F.startswith("value", F.lit("#")))
    pair = F.split(F.regexp_replace("value", r"^#\s*", ""), ":", 2)
    key, value = F.trim(pair[0]), F.trim(F.try_element_at(pair, F.lit(2)))
    head = lines.groupBy("file").agg(*[F.max(F.when(key == k, value)).alias(k) for k in keys])
    return rows.select("*", file).join(head, "file", "left")


def write_shared(rows: DataFrame, path: str, recording: str, order: list[str], metadata: dict[str, Column], digits: int = 6) -> None:
    """CSV files that recordings share: a line `# {json}` of a recording's name, columns and metadata, then its rows in order.

    For many short recordings: files, listings and commits follow the size of the rows, not the number of recordings, and never
    exceed the shuffle partitions. A recording stays whole in one file, and each row holds its name, so readers may split files.
    metadata: aggregates over a recording's rows; nulls are empty fields. The folder is replaced as a whole.
    """
    whole = rows.select(recording, *[c for c in rows.columns if c != recording])
    names = whole.columns
    text = F.to_csv(F.struct(*[c.alias(n) for c, n in zip(_shown(whole, digits), names, strict=True)]), {"emptyValue": '""', "comment": "#", "escape": '"'})
    lines = whole.select(recording, F.lit(1).alias("__part"), F.struct(*order).alias("__at"), text.alias("value"))
    head = whole.groupBy(recording).agg(*[v.cast("string").alias(f"__{k}") for k, v in metadata.items()])
    about = F.struct(F.col(recording).cast("string").alias("recording"), F.lit(",".join(names)).alias("columns"), F.struct(*[F.col(f"__{k}").alias(k) for k in metadata]).alias("metadata"))
    head = head.select(recording, F.lit(0).alias("__part"), F.lit(None).cast(lines.schema["__at"].dataType).alias("__at"), F.concat(F.lit("# "), F.to_json(about)).alias("value"))
    out = head.unionByName(lines).repartition(F.col(recording)).sortWithinPartitions(recording, "__part", "__at")
    out.select("value").write.mode("overwrite").text(path)


def read_shared(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Rows of all CSV files that recordings share with their recording's metadata of the given keys, null where it has none.

    schema: of the columns as they were written, the recording first.
    """
    rows = spark.read.schema(schema).options(comment="#", escape='"', nullValue="\0").csv(path)  # so that "" isn't null, but nothing is
    recording = rows.columns[0]
    text = F.expr("substring(value, 3)")
    about = F.from_json(text, "recording string, metadata map<string,string>")
    head = spark.read.text(path).where(F.startswith("value", F.lit("# {"))).select(about.alias("a"))
    head = head.groupBy(F.col("a.recording").alias("__recording")).agg(*[F.max(F.col("a.metadata")[k]).alias(k) for k in keys])
    return rows.join(head, F.col(recording).cast("string").eqNullSafe(F.col("__recording")), "left").drop("__recording")
