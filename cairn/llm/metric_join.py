"""Embedding near-dedup by an exact metric range join.

Vectors are scaled to length 1 and compared by their angle, a metric: cosine >= c is an angle of at most ``reach`` =
arccos(c).  Pivots partition the vectors: centres of dense places of a bounded sample first, then those farthest
from the ones chosen.  A vector's home is the cell of its nearest pivot.  It is copied to another cell only if both
bounds of the triangle inequality let a vector there be within reach: the plane between the two pivots
(``x.(p_i - p_j) <= sin(reach) |p_i - p_j|``) and the cell's radius (``angle(x, p_j) <= radius_j + reach``).  Of two
cells only one gets copies from the other (``receives``), so each pair meets in one cell, and cells join independently.

Inside a cell, homes within half the reach of the pivot all link with each other: they are counted, not compared.  All
others are compared by matrix products (single precision finds, double precision decides) in windows of the angle to
the pivot, which can differ by at most the reach.  Large cells are cut into blocks; a pair of blocks is one task's
group.  Equal vectors are one class throughout.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cairn.llm._spark import Scratch, connected_components, sized_join
from cairn.llm._text import pieces

#: Vectors of the sample that pivots come from; most pivots; vectors of a cell that are aimed at; bytes and rows of a block at most.
SAMPLE, PIVOTS, CELL, BLOCK_BYTES, BLOCK_ROWS = 2048, 1024, 4096, 32 << 20, 8192


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow in the squares; every row must be finite and not zero."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0


def unpack(v: list[bytes], dim: int) -> np.ndarray:
    """Unit rows from packed ones: single precision where that is exact, else double."""
    single = np.array([len(x) == 4 * dim for x in v], bool)
    out = np.empty((len(v), dim))
    for kind, own in ((np.float32, single), (np.float64, ~single)):
        at = np.flatnonzero(own)
        if len(at):
            out[at] = np.frombuffer(b"".join([v[i] for i in at]), kind).reshape(len(at), dim)
    return unit(out) if len(v) else out


def _units(parts):
    """id, v -> id, cls (digest of the unit vector; null if the vector can't link), dim, v (packed)."""
    for part in pieces(parts, 10_000):
        n = part.num_rows
        cls, dims, vecs = [None] * n, [None] * n, [None] * n
        size = pc.fill_null(pc.list_value_length(part["v"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = part["v"].flatten().to_numpy(zero_copy_only=False)
        begin = np.cumsum(size) - size
        for dim in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == dim)
            x = flat[begin[at][:, None] + np.arange(dim)].astype(np.float64)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            at, x = at[ok], x[ok]
            if not len(at):
                continue
            with np.errstate(over="ignore"):
                exact = (x.astype(np.float32) == x).all(1)
            for i, u, raw, e in zip(at.tolist(), unit(x), x, exact.tolist(), strict=True):
                cls[i], dims[i] = hashlib.blake2b(u.tobytes(), digest_size=16).digest(), dim
                vecs[i] = (raw.astype(np.float32) if e else raw).tobytes()
        yield pa.RecordBatch.from_arrays([part["id"], pa.array(cls, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["id", "cls", "dim", "v"])


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def receives(cell: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether ``cell`` gets the copies of ``other``'s vectors: of two cells exactly one does, and each does for about half of the others."""
    return np.where((cell + other) % 2 == 1, cell < other, cell > other)


def assign(x: np.ndarray, pivots: np.ndarray, reach: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(angles to all pivots, home of each vector, whether each is copied to each cell)."""
    c = x @ pivots.T
    home = c.argmax(1)
    rows = np.arange(len(x))
    between = np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0))
    turn = angles(c)
    goes = (c[rows, home][:, None] - c <= math.sin(reach) * between[home] + 1e-9) & (turn <= radius[None, :] + reach + 1e-9)
    goes &= receives(np.arange(len(pivots))[None, :], home[:, None])
    goes[rows, home] = False
    return turn, home, goes


def core_angle(reach: float) -> float:
    """Two vectors within this of one pivot link, with a margin for rounding."""
    return reach / 2 - 1e-6


def choose_pivots(sample: np.ndarray, reach: float, n: int) -> np.ndarray:
    """Pivots for n vectors: at least one for each CELL of them and at least two (fewer only if the sample has fewer places).

    More are taken where the sample says that fewer pairs and copies pay for them.
    """
    near = sample @ sample.T >= math.cos(core_angle(reach))
    order, left = [], np.ones(len(sample), bool)
    while len(order) < PIVOTS:
        count = near[:, left].sum(1)
        best = int(count.argmax())
        if count[best] < max(8, len(sample) // 256):
            break
        order.append(best)
        left &= ~near[best]
    dense = len(order)
    far = (sample @ sample[order].T).max(1) if order else np.full(len(sample), -1.0)
    while len(order) < PIVOTS:
        nxt = int(far.argmin())
        if order and far[nxt] >= 1 - 1e-9:
            break
        order.append(nxt)
        far = np.maximum(far, sample @ sample[nxt])
    least = min(len(order), max(2, dense, math.ceil(n / CELL), min(8, n // 64)))
    tried, best, cost = least, order[:least], math.inf
    while tried <= len(order) and (tried == least or n / tried >= 64):
        own = sample[order[:tried]]
        turn, home, _ = assign(sample, own, reach, np.full(tried, math.pi))
        mine = turn[np.arange(len(sample)), home]
        radius = np.array([mine[home == j].max(initial=0.0) for j in range(tried)])
        goes = assign(sample, own, reach, radius)[2]
        scale = n / len(sample)
        homes, copies = np.bincount(home, minlength=tried) * scale, goes.sum(0) * scale
        core = np.bincount(home, mine <= core_angle(reach), tried) * scale
        now = (homes * (homes / 2 + copies) - core * core / 2).sum() + 2e4 * (homes + copies).sum()  # a row that is shuffled costs as many as 20000 comparisons
        if now < 0.8 * cost:
            best, cost = order[:tried], now
        tried *= 2
    return sample[best]


def _homes(shared):
    """cls, size, dim, v -> the same and the home's number, the angle to its pivot."""

    def run(parts):
        for part in pieces(parts, 5000):
            dims = np.array(part["dim"].to_pylist(), np.int64)
            cell, turn = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                c = unpack(part["v"].take(pa.array(at)).to_pylist(), dim) @ shared.value[dim].T
                cell[at], turn[at] = c.argmax(1), angles(c.max(1))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(turn)], names=[*part.schema.names, "cell", "turn"])

    return run


def _copies(shared, reach: float, part: pa.RecordBatch):
    """For each dim of a batch: rows, their cells and, of those that are copied, (row, cell, angle to its pivot)."""
    pivots, radii = shared.value
    dims = np.array(part["dim"].to_pylist(), np.int64)
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        x = unpack(part["v"].take(pa.array(at)).to_pylist(), dim)
        turn, home, goes = assign(x, pivots[dim], reach, radii[dim])
        row, cell = np.nonzero(goes)
        yield dim, at, home, turn[np.arange(len(at)), home], at[row], cell, turn[row, cell]


def _count(shared, reach: float):
    def run(parts):
        for part in pieces(parts, 5000):
            for dim, _, _, _, _, cell, _ in _copies(shared, reach, part):
                n = np.bincount(cell)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dim, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64))], names=["dim", "cell", "n"])

    return run


def block_rows(dim: int) -> int:
    return max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))


def _deal(shared, blocks, reach: float):
    """Every row once for each group that it takes part in: cls, size, dim, v, turn, cell, lo, hi, mine.

    A cell's blocks are those of its core, of its other homes and of its copies, numbered in this order.  Groups are
    pairs of blocks lo <= hi, neither two of the core nor two of copies.
    """

    def run(parts):
        for part in pieces(parts, 2000):
            for dim, at, home, turn, row, cell, angle in _copies(shared, reach, part):
                src, cells = np.concatenate((at, row)), np.concatenate((home, cell))
                turns, copy = np.concatenate((turn, angle)), np.arange(len(src)) >= len(at)
                sizes = np.array([blocks.value.get((dim, int(c)), (0, 0, 0)) for c in range(int(cells.max()) + 1)])[cells]
                a, b, c = sizes.T
                core = ~copy & (turns <= core_angle(reach))
                own = np.where(copy, c, np.where(core, a, b))
                h = np.array([int.from_bytes(x[:7], "big") for x in part["cls"].take(pa.array(src)).to_pylist()], np.int64)
                mine = h % np.maximum(own, 1) + np.where(copy, a + b, np.where(core, 0, a))
                # partners: a core's are the blocks from a on, another home's all, a copy's the homes'
                first, last = np.where(core, a, 0), np.where(copy, a + b, a + b + c)
                n = np.maximum(last - first, 0)
                k = np.repeat(np.arange(len(src)), n)
                other = first[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                for s in range(0, len(k), 20_000):
                    e, o = k[s : s + 20_000], other[s : s + 20_000]
                    rows = part.take(pa.array(src[e]))
                    yield pa.RecordBatch.from_arrays(
                        [rows["cls"], rows["size"], rows["dim"], rows["v"], pa.array(turns[e]), *(pa.array(x.astype(np.int32)) for x in (cells[e], np.minimum(mine[e], o), np.maximum(mine[e], o), mine[e]))],
                        names=["cls", "size", "dim", "v", "turn", "cell", "lo", "hi", "mine"],
                    )

    return run


def links(a: np.ndarray, b: np.ndarray | None, cosine: float, ta: np.ndarray | None = None, tb: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs with a @ b >= cosine (b=None: pairs i < j within a), and how many pairs were compared.

    ta, tb: angles to one pivot; only pairs whose angles differ by at most the reach are compared.
    """
    ta = np.zeros(len(a)) if ta is None else ta
    oa = np.argsort(ta, kind="stable")
    ob, tb = (oa, ta) if b is None else (np.argsort(tb if tb is not None else np.zeros(len(b)), kind="stable"), tb if tb is not None else np.zeros(len(b)))
    a, b = a[oa], a[oa] if b is None else b[ob]
    same = ob is oa
    ta, tb, reach = ta[oa], tb[ob], math.acos(cosine) + 1e-9
    a32, b32 = a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    p, q, seen = [], [], 0
    for lo in range(0, len(a), 512):
        hi = min(lo + 512, len(a))
        first, last = np.searchsorted(tb, ta[lo] - reach), np.searchsorted(tb, ta[hi - 1] + reach, "right")
        first = max(first, lo) if same else first
        if first >= last:
            continue
        seen += (hi - lo) * int(last - first)
        i, j = np.nonzero(a32[lo:hi] @ b32[:, first:last] >= cosine - 1e-4)
        i, j = i + lo, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 16):
            x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            ok = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
            p.append(oa[x[ok]]), q.append(ob[y[ok]])
    return (np.concatenate(p), np.concatenate(q), seen) if p else (np.zeros(0, np.int64), np.zeros(0, np.int64), seen)


FOUND = "cls binary, root binary, links long, pairs long"


def _join(cosine: float):
    """A group's links: for each class its number and a local root; and one row without a class, with the pairs compared."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, _, lo, hi = (x.as_py() for x in key)
        mine, turn = table["mine"].to_numpy(), table["turn"].to_numpy()
        cls, size = table["cls"].to_pylist(), table["size"].to_numpy()
        x = unpack(table["v"].to_pylist(), dim)
        i, j = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        if lo == hi:
            p, q, seen = links(x[i], None, cosine, turn[i])
            p, q = i[p], i[q]
        else:
            p, q, seen = links(x[i], x[j], cosine, turn[i], turn[j])
            p, q = i[p], j[q]
        count = np.bincount(p, size[q], len(cls)) + np.bincount(q, size[p], len(cls)) if len(p) else np.zeros(len(cls))
        order = np.argsort(np.array(cls, object), kind="stable")
        root = np.empty(len(cls), np.int64)
        root[order] = np.arange(len(cls))
        while len(p):
            low, before = np.minimum(root[p], root[q]), root.copy()
            np.minimum.at(root, p, low), np.minimum.at(root, q, low)
            if (before == root).all():
                break
        got = np.flatnonzero(count > 0)
        return pa.table(
            {
                "cls": pa.array([*(cls[k] for k in got), None], pa.binary()), "root": pa.array([*(cls[order[root[k]]] for k in got), None], pa.binary()),
                "links": pa.array([*count[got].astype(np.int64).tolist(), 0], pa.int64()), "pairs": pa.array([*[0] * len(got), seen], pa.int64()),
            }
        )

    return run


def metric_join(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, stats: dict | None = None) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of
    different lengths.  Rows that repeat an id count as vectors of their own.  A row with a null id comes out with no
    links, a null component_id and kept false.  ``stats`` gets ``classes, pivots, copies`` and ``pairs`` (compared).
    """
    if not 0 < cosine < 1:
        raise ValueError("the cosine must lie between 0 and 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "metric")
    reach = math.acos(cosine)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    units = scratch.table(base.where("id is not null").mapInArrow(_units, "id long, cls binary, dim int, v binary"), "units")
    classes = scratch.table(units.where("cls is not null").groupBy("cls").agg(F.count("*").alias("size"), F.min("id").alias("rep"), F.first("dim").alias("dim"), F.first("v").alias("v")), "classes")
    pivots = {}
    for r in classes.groupBy("dim").count().collect():
        sample = [x.v for x in classes.where(F.col("dim") == r["dim"]).select("v", F.xxhash64("cls").alias("o")).orderBy("o").limit(SAMPLE).collect()]
        pivots[r["dim"]] = choose_pivots(unpack([bytes(v) for v in sample], r["dim"]), reach, r["count"])
    homes = scratch.table(classes.select("cls", "size", "dim", "v").mapInArrow(_homes(spark.sparkContext.broadcast(pivots)), "cls binary, size long, dim int, v binary, cell int, turn double"), "homes")
    core = F.col("turn") <= core_angle(reach)
    about = homes.groupBy("dim", "cell").agg(F.max("turn").alias("radius"), F.count(F.when(core, 1)).alias("core"), F.count(F.when(~core, 1)).alias("others")).collect()
    radii = {d: np.full(len(p), -math.inf) for d, p in pivots.items()}
    for r in about:
        radii[r.dim][r.cell] = r.radius
    shared = spark.sparkContext.broadcast((pivots, radii))
    copied = {(r.dim, r.cell): r.n for r in homes.mapInArrow(_count(shared, reach), "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()}
    cut = lambda n, dim: -(-n // block_rows(dim))
    blocks = spark.sparkContext.broadcast({(r.dim, r.cell): tuple(cut(n, r.dim) for n in (r.core, r.others, copied.get((r.dim, r.cell), 0))) for r in about})
    dealt = homes.mapInArrow(_deal(shared, blocks, reach), "cls binary, size long, dim int, v binary, turn double, cell int, lo int, hi int, mine int")
    cores = homes.where(core).groupBy("dim", "cell").agg(F.sum("size").alias("total"), F.min("cls").alias("root"))
    inner = sized_join(homes.where(core).select("cls", "size", "dim", "cell"), cores, ["dim", "cell"], "inner").where("total > size").select("cls", "root", (F.col("total") - F.col("size")).alias("links"), F.lit(0).cast("long").alias("pairs"))
    found = scratch.table(dealt.groupBy("dim", "cell", "lo", "hi").applyInArrow(_join(cosine), FOUND).unionAll(inner), "found")
    if stats is not None:
        stats |= {"classes": sum(r.core + r.others for r in about), "pivots": sum(map(len, pivots.values())), "copies": sum(copied.values()), "pairs": found.agg(F.sum("pairs")).first()[0] or 0}
    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch)
    reached = roots.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    linked = reached.join(reached.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select(F.col("node").alias("cls"), "component_id")
    info = scratch.table(
        classes.select("cls", "size", "rep").join(found.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left").join(linked, "cls", "left")
        .select("cls", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")),
        "info",
    )
    out = scratch.table(units.select("id", "cls").join(info, "cls", "left").select("id", "component_id", "n_links"), "result")
    scratch.drop(units, classes, homes, found, info)
    out = out.unionByName(base.where("id is null").select("id"), allowMissingColumns=True)
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
