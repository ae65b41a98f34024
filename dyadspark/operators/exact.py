"""Exact null distributions of rank statistics, counted by dynamic programming over arrays inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most values for which the signed-rank null is counted; most in the smaller and in the larger group of the two-sample test.
SIGNED, SMALLER, LARGER = 50, 8, 64


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int"))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _share(counts: Column, upto: Column) -> Column:
    """Twice the share of the counts at 0..upto, 1 at most."""
    low = F.aggregate(F.slice(counts, F.lit(1), F.greatest(upto.cast("int") + 1, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
    whole = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), 2 * low / whole)


def signed_rank_counts(n: Column) -> Column:
    """At s: how many subsets of 1..n have the sum s. Each number joins the sums so far, or doesn't."""
    one = F.array(F.lit(1.0))
    add = lambda c, k: _plus(F.concat(c, _zeros(k)), F.concat(_zeros(k), c))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), one, add)).otherwise(one)


def signed_rank_p(w: Column, n: Column) -> Column:
    """Two-sided p of the lesser rank sum of n values without ties or zeros; null beyond SIGNED values."""
    return F.when((n >= 1) & (n <= SIGNED), _share(signed_rank_counts(F.least(n, F.lit(SIGNED))), F.floor(w)))


def rank_sum_counts(m: Column, n: Column) -> Column:
    """At u: how many ways groups of m and n values have the statistic u.

    With n values a row of counts for 0, 1, ... m of the others; one value more in the group of n, and each count is that of one
    fewer of the others, moved by the size of the group, and that without the new value.
    """
    m, n = m.cast("int"), n.cast("int")
    start = F.array_repeat(F.array(F.lit(1.0)), m + 1)

    def more(rows: Column, k: Column) -> Column:
        def next_row(done: Column, i: Column) -> Column:
            moved = F.concat(_zeros(k), F.element_at(done, -1))
            same = F.element_at(rows, i + 1)
            return F.concat(done, F.array(_plus(moved, F.concat(same, _zeros(i)))))

        return F.aggregate(F.sequence(F.lit(1), m), F.array(F.array(F.lit(1.0))), next_row)

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), start, more), -1)


def rank_sum_p(u: Column, n_a: Column, n_b: Column) -> Column:
    """Two-sided p of U of two groups without ties; null where one is empty, the smaller exceeds SMALLER or the larger LARGER."""
    small, large = F.least(n_a, n_b), F.greatest(n_a, n_b)
    lesser = F.least(u, n_a * n_b - u)
    counts = rank_sum_counts(F.least(small, F.lit(SMALLER)), F.least(large, F.lit(LARGER)))
    return F.when((small >= 1) & (small <= SMALLER) & (large <= LARGER), _share(counts, F.floor(lesser)))
