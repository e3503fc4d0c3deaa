"""Parsers of resource readings and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def memory_mb(text: Column) -> Column:
    """MB of the first part of ``used / limit`` readings: GiB, MiB or KiB; 0 for other units."""
    used = F.btrim(F.split(text, "/")[0])
    n = F.regexp_extract(used, r"^([0-9.]+)", 1).try_cast("double")
    return F.coalesce(F.when(used.contains("GiB"), n * 1024).when(used.contains("MiB"), n).when(used.contains("KiB"), n / 1024), F.lit(0.0))


def percent(text: Column) -> Column:
    return F.coalesce(F.btrim(F.replace(text, F.lit("%"), F.lit(""))).try_cast("double"), F.lit(0.0))


def preview(text: Column, n: int = 100) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1048576.0), 2)
