"""Vector arithmetic as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.columns import finite_or_zero

#: Query vectors up to this length become one sum that whole-stage code generation compiles; longer ones a higher-order function.
UNROLL = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0.0 for a null or zero vector, for different lengths and where components make no number."""
    na, nb = norm(a), norm(b)
    ok = (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return finite_or_zero(F.when(ok, dot(a, b) / (na * nb)).otherwise(F.lit(0.0)))


def cosine_to(v: Column, query: Sequence[float], v_norm: Column | None = None) -> Column:
    """Cosine of a column and a literal vector; ``v_norm`` is the stored norm of the column, if there is one."""
    size, length = len(query), math.sqrt(math.fsum(x * x for x in query))
    if size == 0 or length == 0:
        return F.lit(0.0)
    if size > UNROLL:
        return cosine(v, F.array(*[F.lit(float(x)) for x in query]))
    at = [F.get(v, F.lit(i)).cast("double") for i in range(size)]
    inner, own = F.lit(0.0), F.lit(0.0)
    for x, q in zip(at, query, strict=True):
        inner = inner + x * F.lit(float(q))
        own = own + x * x
    own = F.sqrt(own) if v_norm is None else v_norm
    return finite_or_zero(F.when((F.size(v) == size) & (own > 0), inner / (own * F.lit(length))).otherwise(F.lit(0.0)))


def l2_normalize(v: Column) -> Column:
    """v / |v|; null components for a zero vector."""
    n = norm(v)
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), n))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Masked mean of an array of vectors: sum(token * mask) / max(sum(mask), 1e-9)."""
    weights = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double"))
    masked = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m.cast("double")))
    zero = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    total = F.aggregate(masked, zero, lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(weights, F.lit(1e-9)))


def mean_pool_rows(rows: DataFrame, by: str, vec_col: str, mask_col: str) -> DataFrame:
    """``by, i, x``: the masked mean of each component over the rows of a group, by partial sums; no group is gathered."""
    parts = rows.select(by, F.col(mask_col).cast("double").alias("m"), F.posexplode(vec_col).alias("i", "v"))
    return parts.groupBy(by, "i").agg((F.sum(F.col("v").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("x"))


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """A reproducible stand-in for a model: component i is the first 32 bits of md5(text + ':' + i), scaled to [0, 1)."""
    word = lambda i: F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: word(i) / F.lit(4294967296.0))
