"""Helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once: lambdas would evaluate an expression again at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def finite_or_zero(x: Column) -> Column:
    """x, or 0.0 where it is NaN."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(x)
