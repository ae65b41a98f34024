"""Column functions: guarded statistics, transforms and label rules, all built-ins that stay in generated code."""

from __future__ import annotations

import builtins
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of feature names and their modality, first match wins.
MODALITIES = [
    ("GMP_world_", "movement"), ("GMP_norm_", "movement"), ("oc_audvol", "vocal_energy"), ("oc_audpit", "vocal_pitch"), ("lbrs_", "spectral"),
    ("osm_", "opensmile"), ("pf_AU", "facial_AU"), ("pf_emotion", "facial_emotion"), ("pf_facepose", "head_pose"), ("ee_", "emotieffnet"),
]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row: a lambda inside body would compute an expression anew for each of its elements."""
    return F.transform(F.array(value), body)[0]


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def fisher_z(r: Column) -> Column:
    return F.atanh(clip(r, -0.9999, 0.9999))


def varies(*xs: Column) -> Column:
    """Aggregate: each of the columns has two values at least, over the rows where all are present."""
    out = F.lit(True)
    for i, x in enumerate(xs):
        others = [y for j, y in enumerate(xs) if j != i]
        own = x
        for y in others:
            own = F.when(y.isNotNull(), own)
        out = out & (F.min(own) < F.max(own))
    return out


def safe_corr(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's r; null under three pairs or without variance on either side (bare corr would raise)."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
    return F.when((F.count(a) >= 3) & varies(a, b), r)


def safe_ccc(a: Column, b: Column) -> Column:
    """Aggregate: Lin's concordance; null under three pairs or without variance on either side."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    c = F.try_divide(2 * F.covar_pop(a, b), F.var_pop(a) + F.var_pop(b) + F.pow(F.avg(a) - F.avg(b), 2))
    return F.when((F.count(a) >= 3) & varies(a, b), c)


def leader(lag: Column) -> Column:
    """A leads where the peak lies at a positive lag."""
    return F.when(lag > 0, "A").when(lag < 0, "B").when(lag == 0, "sync")


def modality(feature: Column, rules: list[tuple[str, str]] = MODALITIES) -> Column:
    out = None
    for prefix, name in rules:
        out = F.when(feature.startswith(prefix), name) if out is None else out.when(feature.startswith(prefix), name)
    return out.otherwise("other")


def slugify(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, " ", "_"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mid_rank(value: Column, within: list[str]) -> Column:
    """Average rank of ties, from 1."""
    from pyspark.sql import Window

    return F.rank().over(Window.partitionBy(*within).orderBy(value)) + (F.count(value).over(Window.partitionBy(*within, value)) - 1) / F.lit(2.0)


def format_seconds(s: Column) -> Column:
    """12.3s under a minute, then 1m02s, from an hour on 1h02m."""
    whole = F.floor(s)
    minutes, hours = F.floor(whole / 60), F.floor(whole / 3600)
    short = F.format_string("%dm%02ds", minutes, whole - minutes * 60)
    return F.when(s < 60, F.format_string("%.1fs", s)).when(minutes < 60, short).otherwise(F.format_string("%dh%02dm", hours, minutes - hours * 60))


def normalized_entropy(probabilities: Column) -> Column:
    """Entropy of an array over its maximum, each probability at least 1e-6."""
    p = F.transform(probabilities, lambda x: F.greatest(x, F.lit(1e-6)))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.ln(x))
    return F.try_divide(total, F.ln(F.size(probabilities).cast("double")))


def lag_samples(lag_range: str, bin_size: float) -> tuple[int, int]:
    """'min:max' in seconds as whole bins, rounded half to even."""
    low, high = (builtins.round(float(x) / bin_size) for x in lag_range.split(":"))
    return int(low), int(high)
