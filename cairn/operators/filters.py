"""Metadata filters: a dict becomes one Column, all of whose parts must hold."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

_SCALARS = ("source", "source_type")
_ALL = (*_SCALARS, "created_after", "created_before", "metadata", "source_contains", "path")


def _is(column: Column, value) -> Column:
    return column.isin(*value) if isinstance(value, list | tuple | set) else column == F.lit(value)


def _typed(metadata: Column, key: str, value) -> Column:
    """Equality with a value's JSON type: 1 isn't "1", and a missing key equals nothing."""
    got = F.try_variant_get(metadata, f"$['{key}']", "variant")
    kind = F.schema_of_variant(got)
    if value is None:
        return got.isNotNull() & (kind == "VOID")
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(metadata, f"$['{key}']", "boolean") == F.lit(value))
    if isinstance(value, int | float):
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return numeric & (F.try_variant_get(metadata, f"$['{key}']", "double") == F.lit(float(value)))
    return (kind == "STRING") & (F.try_variant_get(metadata, f"$['{key}']", "string") == F.lit(str(value)))


def build(filters: Mapping | None, strict: bool = False, metadata: str = "metadata") -> Column | None:
    """None for no condition.

    Keys: source, source_type (a value, or a list of which one must match), created_after and created_before (exclusive),
    metadata (a dict whose keys must all be there with equal typed values, or one of a list), ``metadata.x`` (column x if it is
    one of the above, else that metadata key), source_contains, path (SQL LIKE).  Unknown keys are ignored, or a ValueError if strict.
    """
    parts: list[Column] = []
    for key, value in (filters or {}).items():
        key = key.removeprefix("metadata.") if key.removeprefix("metadata.") in _SCALARS else key
        if key in _SCALARS:
            parts.append(_is(F.col(key), value))
        elif key == "created_after":
            parts.append(F.col("created_at") > F.lit(value))
        elif key == "created_before":
            parts.append(F.col("created_at") < F.lit(value))
        elif key == "source_contains":
            parts.append(F.col("source").contains(value))
        elif key == "path":
            parts.append(F.col("source").like(value))
        elif key == "metadata" or key.startswith("metadata."):
            for k, v in value.items() if key == "metadata" else [(key.removeprefix("metadata."), value)]:
                options = v if isinstance(v, list | tuple | set) else [v]
                parts.append(F.coalesce(reduce(Column.__or__, [_typed(F.col(metadata), k, x) for x in options], F.lit(False)), F.lit(False)))
        elif strict:
            raise ValueError(f"unknown filter key {key!r}; known: {', '.join(_ALL)}")
    return reduce(Column.__and__, parts) if parts else None


def apply(df, filters: Mapping | None, strict: bool = False):
    cond = build(filters, strict)
    return df if cond is None else df.where(cond)
