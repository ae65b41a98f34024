"""Rows of two results as sorted lists that can be compared, columns by name."""

import math
from decimal import Decimal


def value(v):
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    a, b = rows(df.columns, df.collect()), rows(relation.columns, relation.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-4 * max(1.0, abs(p)), (x, y)
