"""Long signals in pieces: places in their order, chunks with halos for filters without seams, and overlapping frames from sums by hop."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Rows that a task sorts at about; parts follow the number of rows.
TASK = 1 << 18
#: Rows of a small table that go to all tasks.
MANY = 1_000_000

#: Under this a sample counts as zero, which is positive.
SILENT = 1e-10


def parts(rows: DataFrame, n: int, task: int = TASK) -> int:
    """Partitions for n rows: a task's rows stay the same number as the table grows."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / task))


def numbered(rows: DataFrame, within: list[str], order: list[str], name: str, task: int = TASK) -> DataFrame:
    """Rows with their place in their group's order, from 0: long, as row_number gives, but a long group spreads over many tasks.

    The first column of the order holds whole numbers. Where the largest group has over `task` rows, quantiles of that column cut
    all groups into cells, rows are numbered within their cell, and a cell begins behind the rows of those before it. Nulls come
    first. Collected are the numbers of rows and groups, the largest group and the quantiles. Rows that share a first key share a
    cell. Rows that are equal in the whole order are numbered in any order.
    """
    from pyspark.ml.feature import Bucketizer

    if not isinstance(rows.schema[order[0]].dataType, IntegralType):
        raise ValueError("the first column of the order must hold whole numbers")
    one = F.count(F.lit(1))
    sizes = rows.groupBy(*within).agg(one.alias("n"))
    groups, total, most = sizes.agg(one, F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    into = parts(rows, total, task)
    if most <= task:
        place = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1
        return (rows.repartition(into, *within) if total > task else rows).withColumn(name, place.cast("long"))
    cells = 2 * math.ceil(most / task)
    key = F.col(order[0]).cast("double")
    cuts = rows.select(key.alias("k")).approxQuantile("k", [k / cells for k in range(1, cells)], 1 / (4 * cells))
    cut = Bucketizer(splits=[-math.inf, *sorted(set(cuts)), math.inf], inputCol="__key", outputCol="__cell")
    # nulls join the first cell, where they sort first
    placed = cut.transform(rows.withColumn("__key", F.coalesce(key, F.lit(-math.inf)))).drop("__key").withColumn("__cell", F.col("__cell").cast("int"))
    before = Window.partitionBy(*within).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy(*within, "__cell").agg(one.alias("n")).withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ahead = ahead.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("__cell").alias("__of"), F.col("n").alias("__ahead"))
    same = F.col("__cell") == F.col("__of")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = F.row_number().over(Window.partitionBy(*within, "__cell").orderBy(*order)) - 1
    out = placed.repartition(into, *within, "__cell").withColumn("__own", own)
    # one row a group and cell: small, unless the groups are very many
    out = out.join(F.broadcast(ahead) if groups * cells <= MANY else ahead, same)
    return out.select(*rows.columns, (F.col("__own") + F.col("__ahead")).cast("long").alias(name))


def haloed(samples: DataFrame, index: str, size: int, halo: int) -> DataFrame:
    """Each sample in its own chunk (core) and in those whose halo it lies in: chunk long, core boolean.

    Chunks are `size` indexes long. What looks at most `halo` indexes around a sample can be computed chunk by chunk, so one
    long signal spreads over many tasks; the rows of the core are its result, and no others are needed.
    """
    i = F.col(index)
    own = F.floor(i / size)
    chunks = F.sequence(F.floor((i - halo) / size), F.floor((i + halo) / size))
    return samples.withColumn("chunk", F.explode(chunks)).withColumn("core", F.col("chunk") == own)


def dealt(chunks: DataFrame, within: list[str], into: int | None) -> DataFrame:
    return chunks.repartition(into, *within, "chunk") if into else chunks


def filtered(samples: DataFrame, within: list[str], index: str, value: str, weights: list[float], size: int, into: int | None = None) -> DataFrame:
    """The signal through a finite filter centred on each sample, in chunks: sum of weights by neighbours, missing ones counting 0.

    An odd number of weights, the first for the earliest neighbour. Indexes are whole and each stands once; where one is
    missing its weight meets nothing. into: partitions that the chunks are dealt to, see `parts`; else Spark's.
    """
    if len(weights) % 2 == 0:
        raise ValueError("an odd number of weights")
    half = len(weights) // 2
    w = Window.partitionBy(*within, "chunk").orderBy(index).rangeBetween
    near = [F.sum(value).over(w(k, k)) if k else F.col(value) for k in range(-half, half + 1)]
    total = sum((F.coalesce(x, F.lit(0.0)) * F.lit(float(c)) for x, c in zip(near, weights, strict=True)), F.lit(0.0))
    return dealt(haloed(samples, index, size, half), within, into).withColumn("filtered", total).where("core").drop("chunk", "core")


def frames(samples: DataFrame, within: list[str], index: str, value: str, frame: int = 2048, hop: int = 512, reflect: bool = False, chunk: int = 1 << 16, into: int | None = None) -> DataFrame:
    """within, frame long, rms, zero_crossing_rate of overlapping frames of a signal, centred: frame k around sample k * hop.

    Samples are numbered from 0 without gaps; there are 1 + n // hop frames. Beyond the ends the squares are of zeros, or of
    the signal reflected about its first and last sample; signs beyond the ends are those of the end samples, so nothing crosses there.
    A frame is a whole number of hops either side of its middle. Each sample enters one sum by hop, reflected ones another;
    a frame adds up its hops. Nulls count as zeros. into: partitions that the chunks are dealt to, see `parts`; else Spark's.
    """
    half = frame // 2
    if half % hop or frame % 2 or not within:
        raise ValueError("half a frame must be a whole number of hops, and `within` must name the recording")
    x = samples.select(*within, F.col(index).cast("long").alias("i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"))
    size = x.groupBy(*within).agg((F.max("i") + 1).alias("n"))
    negative = F.col("x") < -SILENT
    before = F.lag(negative).over(Window.partitionBy(*within, "chunk").orderBy("i"))
    x = dealt(haloed(x, "i", chunk, 1), within, into).withColumn("cross", F.coalesce(before != negative, F.lit(False)).cast("long")).where("core").drop("chunk", "core")
    places = F.array(F.col("i"))
    if reflect:
        x = x.join(F.broadcast(size), within)
        left = F.when((F.col("i") >= 1) & (F.col("i") <= half), F.array(-F.col("i")))
        right = F.when((F.col("i") >= F.col("n") - 1 - half) & (F.col("i") <= F.col("n") - 2), F.array(2 * (F.col("n") - 1) - F.col("i")))
        none = F.array().cast("array<bigint>")
        places = F.concat(places, F.coalesce(left, none), F.coalesce(right, none))
    x = x.withColumn("at", F.explode(places)).withColumn("hop", F.floor(F.col("at") / hop))
    own = F.col("at") == F.col("i")
    sums = x.groupBy(*within, "hop").agg(F.sum(F.col("x") * F.col("x")).alias("square"), F.sum(F.when(own, F.col("cross")).otherwise(0)).alias("cross"), F.max(F.when(own & (F.col("i") == F.col("hop") * hop), F.col("cross")).otherwise(0)).alias("first"))
    reach = half // hop
    spread = sums.withColumn("frame", F.explode(F.sequence(F.col("hop") - reach + 1, F.col("hop") + reach)))
    # the first hop of a frame: what crosses into its first sample happened before the frame
    crossed = F.col("cross") - F.when(F.col("hop") == F.col("frame") - reach, F.col("first")).otherwise(0)
    total = spread.groupBy(*within, "frame").agg(F.sum("square").alias("square"), F.sum(crossed).alias("crossed"))
    grid = size.select(*within, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / hop))).alias("frame"))
    out = grid.join(total, [*within, "frame"], "left")
    return out.select(*within, "frame", F.sqrt(F.coalesce("square", F.lit(0.0)) / frame).alias("rms"), (F.coalesce("crossed", F.lit(0)) / frame).alias("zero_crossing_rate"))
