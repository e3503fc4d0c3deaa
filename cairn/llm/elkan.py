"""Centroid clustering of integer vectors with Elkan's bounds, exact in every assignment.

Vectors become integers floor(scale * x).  Each keeps an upper bound of the distance to its centroid and a lower bound to
each of the k centroids; a distance is computed only where a lower bound, and half the distance between the two centroids,
are not over the upper bound.  Distances are exact integers, as are sums and centroids.  Their roots are rounded outward
(upper bounds up, lower bounds down), and only strictly larger bounds prune, so an equal distance to a smaller centroid
number is always seen.

A round is one job over the table of states (vector, cluster, bounds), which the next round reads: nothing is recomputed
after a lost executor but its own tasks.  Sums are carried on: only vectors that changed their cluster are added up.  The
driver holds k centroids and their sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairn.llm._spark import Scratch

#: Components from -LIMIT to LIMIT: squared distances of up to 256 of them fit into a long.
LIMIT = 1 << 26
STATE = "vec_id long, q array<int>, cluster int, before int, distance long, upper double, lower array<float>, computed long"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0.0)


def _root_up(square: np.ndarray) -> np.ndarray:
    """At least the root of an integer."""
    return _up(np.sqrt(square.astype(np.float64)))


def _root_down(square: np.ndarray) -> np.ndarray:
    return _down(np.sqrt(square.astype(np.float64)))


def _single_down(x: np.ndarray) -> np.ndarray:
    """At most x, in single precision."""
    y = x.astype(np.float32)
    return np.where(y.astype(np.float64) > x, np.nextafter(y, np.float32(-np.inf)), y)


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of q to the vector, or rows, c."""
    d = q.astype(np.int64) - c.astype(np.int64)
    return np.einsum("ij,ij->i", d, d)


def all_squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of q to all rows of c; by floating-point products where each of their sums is an exact integer."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0)))
    if q.shape[1] * most * most < 1 << 51:
        x, y = q.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    return np.stack([squared(q, v) for v in c], axis=1)


def assign_first(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster, distance, upper, lower, computed for vectors without bounds."""
    d = all_squared(q, c)
    a = d.argmin(1)  # the first of equal ones
    best = d[np.arange(len(q)), a]
    return a.astype(np.int32), best, _root_up(best), _single_down(_root_down(d)), np.full(len(q), len(c), np.int64)


def assign_again(q: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, half: np.ndarray, c: np.ndarray):
    """The same after the centroids moved: ``moved`` is at least how far each did, ``half`` at most half the distance of two.

    A vector whose bounds decide costs one distance, that to its own centroid.
    """
    a, n, rows = a.copy(), len(q), np.arange(len(q))
    upper = np.where(moved[a] > 0, _up(upper + moved[a]), upper)
    lower = np.where(moved[None, :] > 0, _single_down(_down(lower.astype(np.float64) - moved[None, :])), lower)
    nearest = np.where(np.eye(len(c), dtype=bool), np.inf, half).min(1) if len(c) > 1 else np.full(1, np.inf)
    distance, computed, known = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    open_ = ~(upper < nearest[a])

    def tighten(at: np.ndarray) -> None:
        d = squared(q[at], c[a[at]])
        distance[at], upper[at], known[at] = d, _root_up(d), True
        lower[at, a[at]] = _single_down(_root_down(d))
        computed[at] += 1

    for j in range(len(c)):
        could = open_ & (a != j) & ~(lower[:, j] > upper) & ~(half[a, j] > upper)
        loose = np.flatnonzero(could & ~known)
        if len(loose):
            tighten(loose)
            could &= ~(lower[:, j] > upper) & ~(half[a, j] > upper)
        at = np.flatnonzero(could)
        if not len(at):
            continue
        d = squared(q[at], c[j])
        computed[at] += 1
        lower[at, j] = _single_down(_root_down(d))
        better = (d < distance[at]) | ((d == distance[at]) & (j < a[at]))
        won = at[better]
        a[won], distance[won], upper[won] = j, d[better], _root_up(d[better])
    rest = rows[~known]
    if len(rest):  # the bounds decided; their exact distances are what the result reports
        distance[rest] = squared(q[rest], c[a[rest]])
        computed[rest] += 1
        upper[rest] = _root_up(distance[rest])
    return a, distance, upper, lower, computed


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False) if len(column) else np.zeros((0, 0), kind)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))


def _step(c: np.ndarray, before: np.ndarray | None = None):
    """A task's work of one round: with the old centroids, bounds are moved on; without, made."""
    names = [x.split()[0] for x in STATE.split(", ")]

    def run(parts):
        if before is not None:
            moved = squared(c, before)
            moved = np.where(moved > 0, _root_up(moved), 0.0)
            half = _root_down(all_squared(c, c)) / 2
        for part in parts:
            if not part.num_rows:
                continue
            q = _matrix(part["q"], np.int64)
            if before is None:
                was = np.full(len(q), -1, np.int32)
                a, distance, upper, lower, computed = assign_first(q, c)
            else:
                was = part["cluster"].to_numpy(zero_copy_only=False).astype(np.int32)
                a, distance, upper, lower, computed = assign_again(q, was, part["upper"].to_numpy(), _matrix(part["lower"], np.float32), moved, half, c)
                computed = computed + part["computed"].to_numpy()
            yield pa.RecordBatch.from_arrays([part["vec_id"], part["q"], pa.array(a, pa.int32()), pa.array(was), pa.array(distance), pa.array(upper), _lists(lower, pa.float32()), pa.array(computed)], names=names)

    return run


def integers(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("int"))


def kept(vectors: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, q`` of the vectors with ``dim`` components, none null or non-finite; ArithmeticError for one beyond LIMIT / scale."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where((F.size("v") == dim) & ~F.exists("v", odd))
    most = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0]
    if most is not None and most * scale > LIMIT - 1:
        raise ArithmeticError(f"a component of {most} is beyond {LIMIT / scale}: its squared distances need not fit into a long")
    return rows.select("vec_id", integers(F.col("v"), scale).alias("q"))


def _sums(state: DataFrame, dim: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """What came to each cluster, less what went, in this round: counts and exact sums, at most 2 k rows."""
    changed = state.where("cluster <> before")
    each = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("before").alias("c"), F.lit(-1).alias("s"))))
    rows = changed.select("q", each.alias("e")).where("e.c >= 0").groupBy("e.c")
    count, total = {}, {}
    for r in rows.agg(F.sum(F.col("e.s").cast("long")), *[F.sum(F.get("q", F.lit(i)).cast("long") * F.col("e.s")) for i in range(dim)]).collect():
        count[r[0]], total[r[0]] = r[1], list(r[2:])
    return count, total


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed`` of each kept vector.

    The first centroids are the k kept vectors with the smallest SHA-256 of ``<seed>:<vec_id>``, in that order, equal ones
    by their components; a null id can't be one.  Each round assigns every vector to its nearest centroid (ties: the
    smaller number) and moves non-empty centroids to floor(sum / count) of their vectors; then all are assigned once more.
    With fewer than k kept vectors there are as many centroids; with none, or none that has an id, no rows.
    ``computed`` counts the vector's exact distances in all assignments, of which there are rounds + 1, of k each without
    bounds.  A sum beyond a long is null.  Repeated rows are vectors of their own; other columns are left out.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "elkan")
    rows = kept(vectors, dim, scale, id_col, vec_col)
    first = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed long")
    c = np.array([r["q"] for r in first], np.int64)
    count, total = [0] * len(c), [[0] * dim for _ in c]
    state = scratch.table(rows.mapInArrow(_step(c), STATE), "state")
    for _ in range(rounds):
        for j, n in (found := _sums(state, dim))[0].items():
            count[j] += n
            total[j] = [x + y for x, y in zip(total[j], found[1][j], strict=True)]
        before, c = c, np.array([[x // count[j] for x in total[j]] if count[j] else c[j].tolist() for j in range(len(c))], np.int64)
        after = scratch.table(state.mapInArrow(_step(c, before), STATE), "state")
        scratch.drop(state)
        state = after
    inertia = {r[0]: int(r[1]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    long = lambda x: x if x < 1 << 63 else None
    own = [(j, long(inertia[j]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in sorted(inertia)]
    about = spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")
