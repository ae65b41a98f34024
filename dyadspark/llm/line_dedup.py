"""Drops boilerplate lines by their frequency among the pages of one host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.common import written

RATIO, MIN_PAGES = 0.1, 3
#: Hosts and boilerplate lines, 16 bytes each, that are sent to every executor at most; with more, pages go to their host's.
SMALL = 100_000
#: A host with more than one in SHARES of all pages, or with more than PAGES of them, is dealt out over several tasks, but never
#: one with less than one in LARGEST: so there are fewer such hosts than that, whatever the number of pages.
SHARES, PAGES, LARGEST = 1000, 20_000, 100_000


def host_of(url: Column) -> Column:
    """The authority of a URL in lower case; null without one."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    return F.when(h != "", h)


def line_dedup(
    pages: DataFrame, text_col: str, host: Column, separator: str = "\n", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None
) -> DataFrame:
    """The pages with the lines left out that stand on more than `ratio` of their host's pages.

    A line is compared without its outer spaces and counts once a page; it needs `min_pages` pages at least, so that small
    hosts lose nothing by chance. Blank lines are kept and never counted. What is kept is joined by the separator's first
    alternative, a line break. Null texts stay null; pages with a null host, and all pages of hosts without
    boilerplate, stay as they are; an empty table gives none. Rows, their order of lines, repeated rows and other columns are
    kept. counts names two columns to add: lines that aren't blank, and lines dropped; columns so named give way.

    The lines over the ratio are few: their shares of a host's pages add up to the mean number of lines a page, so a host
    has no more than (mean lines a page) / ratio of them. They travel as one array a host; no line is shuffled with its text.
    Up to SMALL in all they go to every executor, and pages don't move. Beyond that pages meet them by host; a large host's
    pages are dealt out by hash in shares of a thousandth of all pages, 20,000 at most, each with a copy of its array.
    """
    names = [c for c in pages.columns if c not in (counts or ())]
    pages = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], host.alias("__host"))
    text_col, host = f"c{names.index(text_col)}", F.col("__host")
    parts = lambda text: F.split(text, separator, -1)
    key = lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h1"), F.xxhash64(F.trim(x), F.lit(1)).alias("h2"))
    seen = pages.select(host.alias("host"), F.col(text_col).alias("text")).where(F.col("host").isNotNull())
    lines = seen.select("host", F.explode(F.array_distinct(F.transform(F.filter(parts(F.col("text")), lambda x: F.trim(x) != ""), key))).alias("k"))
    often = lines.groupBy("host", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = seen.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    boiler = (
        often.join(totals, "host")
        .where(F.col("n") > F.lit(ratio) * F.col("total"))
        .groupBy("host")
        .agg(F.collect_list(F.struct("h1", "h2")).alias("__boiler"), F.first("total").alias("__total"))
        .withColumnRenamed("host", "__host")
    )
    boiler = written(boiler, "boilerplate")
    kept = lambda text: F.filter(parts(text), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__boiler"), key(x)))
    full = lambda a: F.size(F.filter(a, lambda x: F.trim(x) != "")).cast("long")
    text = F.col(text_col)
    out = _with_boiler(pages, boiler)
    out = out.withColumn("__kept", F.when(F.col("__boiler").isNotNull() & text.isNotNull(), kept(text)))
    if counts:
        n = F.when(text.isNull(), F.lit(0)).otherwise(full(parts(text)))
        out = out.withColumn(counts[0], n).withColumn(counts[1], F.when(F.col("__kept").isNull(), F.lit(0).cast("long")).otherwise(F.col(counts[0]) - full(F.col("__kept"))))
    new = F.when(F.col("__kept").isNull() | (F.size("__kept") == F.size(parts(text))), text).otherwise(F.array_join("__kept", "\n"))
    return out.withColumn(text_col, new).drop("__boiler", "__host").select(*pages.columns[:-1], *(counts or ())).toDF(*names, *(counts or ()))


def share_of(total: int) -> int:
    """Pages of a host that one task gets, about."""
    return max(1, min(total // SHARES, PAGES), total // LARGEST)


def _with_boiler(pages: DataFrame, boiler: DataFrame) -> DataFrame:
    """pages (with __host) with __boiler, null where their host has none."""
    if boiler.agg(F.coalesce(F.sum(F.size("__boiler") + 1), F.lit(0)).alias("n")).first().n <= SMALL:
        return pages.join(F.broadcast(boiler.drop("__total")), "__host", "left")
    total = pages.count()
    share = share_of(total)
    large = boiler.where(F.col("__total") > share).select("__host", F.ceil(F.col("__total") / share).cast("int").alias("__salts"))
    kinds = [F.col(f"`{c}`") for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind]
    salts = F.when(F.col("__host").isNull(), max(1, -(-total // share))).otherwise(F.coalesce("__salts", F.lit(1)))  # pages without a host, too
    dealt = pages.join(F.broadcast(large), "__host", "left").withColumn("__salt", F.pmod(F.xxhash64(*kinds), salts).cast("int"))
    copies = boiler.join(F.broadcast(large), "__host", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    return dealt.join(copies.select("__host", "__salt", "__boiler"), ["__host", "__salt"], "left")
