"""Vector arithmetic on array<double> columns (higher-order built-ins, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelforge.schemas import NORM_EPS


def as_double_array(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def floored_norm(v: Column, eps: float = NORM_EPS) -> Column:
    """Euclidean norm, floored at ``eps`` so a zero vector divides safely."""
    return F.greatest(norm(v), F.lit(eps))


def cosine(a: Column, b: Column, eps: float = NORM_EPS,
           a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    na = a_norm if a_norm is not None else floored_norm(a, eps)
    nb = b_norm if b_norm is not None else floored_norm(b, eps)
    return dot(a, b) / (na * nb)


def round_array(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))
