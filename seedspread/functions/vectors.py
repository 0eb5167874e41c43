"""Vector expressions that stay inside the JVM (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double_array(c: str | Column) -> Column:
    return _c(c).cast("array<double>")


def scale(c: str | Column, divisor: float) -> Column:
    """Divide every feature by a constant (pixel / 255 style scaling)."""
    return F.transform(_c(c), lambda v: v / F.lit(float(divisor)))


def sq_dist(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance of two equally long arrays, summed left to right.

    Fine for small inputs and as an independent check; the blocked kernel in
    ``operators.knn`` is the fast path for big joins.
    """
    diffs = F.zip_with(_c(a), _c(b), lambda u, v: (u - v) * (u - v))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def edge_weight(d2: str | Column, bandwidth: float = 1.0) -> Column:
    """Heat-kernel weight ``exp(-d2 / bandwidth)``."""
    if bandwidth == 1.0:
        return F.exp(-_c(d2))
    return F.exp(-_c(d2) / F.lit(float(bandwidth)))
