"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(
        v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, a_norm: Column, b: Column, b_norm: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    scale = a_norm * b_norm
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(scale, F.lit(0.0)))


def literal_vector(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")
