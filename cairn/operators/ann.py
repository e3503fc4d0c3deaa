"""An inverted-file index with product-quantised codes, on Parquet: searched by pruned lists, re-ranked exactly.

Vectors of length 1 are dealt to the list of their nearest coarse centroid; what is left of them (the residual) becomes a
code of one byte for each of ``subspaces`` parts.  A list is a folder of its own, so a search opens only the lists that it
probes and of those first the codes alone; the full vectors are read for the candidates.  A change writes only the lists it
touches, under new names, and then a new manifest.

Centroids and codebooks are fitted on a sample of at most ``SAMPLE`` vectors, the bound of all that the driver holds;
every row is indexed.  The number of lists to probe and of codes to re-rank are calibrated at build: for sample queries, exact
neighbours tell how many of the nearest lists, and of the best codes in them, hold the wanted share.  The exact mode opens
every list that the triangle inequality (distance to the centroid less the list's radius) doesn't exclude.  A query's nearest
lists are scored first; of the others only rows pass on that can still be among its best, so their number doesn't grow with
the number of lists.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from cairn.operators.snapshots import Snapshots

#: Vectors that centroids and codebooks are fitted on, and queries that the number of probes is calibrated with.
SAMPLE, CALIBRATION = 16_384, 256
#: Vectors of a list, and queries, that one task scores at once.
BLOCK, QUERY_BLOCK = 16_384, 16_384
#: One in so many of the probed lists is scored first, to bound what the others pass on.
FIRST = 8
#: Pairs of a query and a list that are made at once.
PROBES = 20_000
#: The list of vectors that have no direction (null, zero, of another length or with components that are no numbers).
NOWHERE = -1
ROWS = "id long, vector array<float>, list int, code binary, far double, row long, version int"
_SLACK = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids of the rows of x; an empty one moves to the row that is farthest from its own."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]
        own = d.argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for j, i in zip(np.flatnonzero(n == 0), np.argsort(-d[np.arange(len(x)), own], kind="stable"), strict=False):
            c[j] = x[i]
    return c


def directions(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of length 1, and which rows have one."""
    n = len(column)
    out, ok = np.zeros((n, dim)), np.zeros(n, bool)
    lists = column.to_pylist() if n and column.null_count + sum(c.null_count for c in [column.flatten()]) else None
    if lists is None:
        sizes = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, int)
        at = np.flatnonzero(sizes == dim)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begin = np.cumsum(sizes) - sizes
        x = flat[begin[at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim))
    else:
        at = np.array([i for i, v in enumerate(lists) if v is not None and len(v) == dim and None not in v], int)
        x = np.array([lists[i] for i in at], np.float64).reshape(len(at), dim)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        length = np.linalg.norm(x, axis=1)
    good = np.isfinite(length) & (length > 0)
    out[at[good]] = x[good] / length[good][:, None]
    ok[at[good]] = True
    return out, ok


class VectorIndex:
    """``build`` makes one, ``VectorIndex(spark, path)`` opens one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.snap = spark, Snapshots(spark, path)
        m = self.snap.read()
        self.dim, self.probes, self.depth = m["dim"], m["probes"], m.get("depth", 100)
        r = spark.read.parquet(f"{self.snap.path}/{m['model']}").first()
        self.centroids = np.array(r["centroids"], np.float64).reshape(-1, self.dim)
        self.books = [np.array(b, np.float64).reshape(-1, e - s) for b, (s, e) in zip(r["books"], self.parts(self.dim, len(r["books"])), strict=True)]

    @staticmethod
    def parts(dim: int, n: int) -> list[tuple[int, int]]:
        cuts = np.linspace(0, dim, n + 1).astype(int).tolist()
        return list(zip(cuts, cuts[1:], strict=False))

    @classmethod
    def build(cls, spark: SparkSession, path: str, rows: DataFrame, lists: int | None = None, subspaces: int = 16, target: float = 0.98, k: int = 10, id_col: str = "id", vec_col: str = "vector", seed: int = 0) -> VectorIndex:
        """Indexes (id, vector): about sqrt(n) lists (at most 4096) if ``lists`` is None.  Without any direction there is one list."""
        base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vector"))
        sized = base.where(F.size("vector") > 0)
        dim = (sized.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first() or [1])[0]
        n = base.count()
        drawn = sized.where(F.size("vector") == dim).orderBy(F.xxhash64(F.lit(seed), "id", "vector")).limit(SAMPLE).select("vector").toArrow()
        x, ok = directions(drawn["vector"].combine_chunks() if drawn.num_rows else pa.array([], pa.list_(pa.float32())), dim)
        x, rng = x[ok], np.random.default_rng(seed)
        c = kmeans(x, lists or max(1, min(4096, round(math.sqrt(n)))), 12, rng) if len(x) else np.zeros((1, dim))
        rest = x - c[((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)] if len(x) else np.zeros((1, dim))
        books = [kmeans(rest[:, s:e], 256, 8, rng) for s, e in cls.parts(dim, min(subspaces, dim))]
        snap = Snapshots(spark, path)
        model = snap.new("model", 0)
        spark.createDataFrame([(c.ravel().tolist(), [b.ravel().tolist() for b in books])], "centroids array<double>, books array<array<double>>").coalesce(1).write.parquet(f"{snap.path}/{model}")
        snap.commit({"version": 0, "dim": dim, "model": model, "lists": {}, "probes": len(c)})
        out = cls(spark, path)
        out.add(base)
        out._calibrate(target, k, seed)
        return out

    # lists

    def _lists(self, only: set[int] | None = None) -> dict[int, dict]:
        """folder, rows and radius of each list that has rows."""
        return {int(j): x for j, x in self.snap.read()["lists"].items() if only is None or int(j) in only}

    def rows(self, only: set[int] | None = None) -> DataFrame:
        """The rows of some lists, of which only the folders are read; None: of all."""
        folders = [f"{self.snap.path}/{x['folder']}" for x in self._lists(only).values()]
        return self.spark.read.schema(ROWS).parquet(*folders) if folders else self.spark.createDataFrame([], ROWS)

    def _encoded(self, rows: DataFrame, version: int) -> DataFrame:
        c, books, parts, dim = self.centroids, self.books, self.parts(self.dim, len(self.books)), self.dim

        def run(batches):
            for b in batches:
                x, ok = directions(b["vector"], dim)
                own = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1) if len(x) else np.zeros(0, int)
                rest = x - c[own]
                code = np.stack([((k * k).sum(1)[None, :] - 2 * rest[:, s:e] @ k.T).argmin(1) for k, (s, e) in zip(books, parts, strict=True)], axis=1).astype(np.uint8)
                far = np.linalg.norm(rest, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b["id"], b["vector"], pa.array(np.where(ok, own, NOWHERE).astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(np.where(ok, far, 0.0)), b["row"], b["version"]],
                    names=["id", "vector", "list", "code", "far", "row", "version"],
                )

        numbered = rows.select("id", "vector", F.monotonically_increasing_id().alias("row"), F.lit(version).alias("version"))
        return numbered.mapInArrow(run, ROWS)

    def _write(self, rows: DataFrame, touched: set[int]) -> None:
        """Rows become the whole of the touched lists."""
        m = self.snap.read()
        version = m["version"] + 1
        folder = self.snap.new("lists", version)
        # several tasks a list, by row, so that a large list isn't one task's
        rows.withColumn("part", F.col("list")).repartition("part", F.pmod(F.xxhash64("row"), F.lit(4))).sortWithinPartitions("part").write.partitionBy("part").parquet(f"{self.snap.path}/{folder}")
        made = self.spark.read.schema(ROWS).parquet(f"{self.snap.path}/{folder}").groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
        lists = {j: x for j, x in m["lists"].items() if int(j) not in touched}
        lists |= {str(r["list"]): {"folder": f"{folder}/part={r['list']}", "rows": r["n"], "radius": r["far"]} for r in made}
        self.snap.commit({**m, "version": version, "lists": lists})

    def _change(self, new: DataFrame | None, gone: DataFrame | None) -> int:
        """Rows whose ids are ``gone`` go, then ``new`` come, by rewriting the lists that hold either; how many lists that were."""
        version = self.snap.version + 1
        staged, touched = None, set()
        if new is not None:
            name = self.snap.new("staged", version)
            self._encoded(new, version).write.parquet(f"{self.snap.path}/{name}")  # encoded once
            staged = self.spark.read.schema(ROWS).parquet(f"{self.snap.path}/{name}")
            touched |= {r[0] for r in staged.select("list").distinct().collect()}
        if gone is not None:
            gone = gone.select(F.col("id").cast("long").alias("id")).distinct()
            touched |= {r[0] for r in self.rows().select("id", "list").join(gone, "id", "left_semi").select("list").distinct().collect()}
        if touched:
            kept = self.rows(touched)
            kept = kept if gone is None else kept.join(gone, "id", "left_anti").select(kept.columns)
            self._write(kept if staged is None else kept.unionByName(staged), touched)
        for name in self.snap.names("staged"):
            self.snap.fs.delete(self.snap.at(f"staged/{name}"), True)
        return len(touched)

    def add(self, rows: DataFrame) -> int:
        """Appends rows (id, vector)."""
        return self._change(rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")), None)

    def remove(self, ids: DataFrame) -> int:
        """Deletes the rows of these ids."""
        return self._change(None, ids)

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace all those with their ids, in whatever list these are."""
        return self._change(rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")), rows.select("id"))

    def vacuum(self) -> None:
        """Deletes what only older states used."""
        live = {x["folder"].rpartition("/")[0] for m in self.snap.forget() for x in m["lists"].values()}
        self.snap.sweep(["lists"], live)

    # search

    def _probes(self, queries: DataFrame, limit: int | None, bound: bool = False, skip: int = 0) -> DataFrame:
        """(query_id, query_vector[, least]) -> (query_id, q, list, place, least) for the nearest ``limit`` lists but the first ``skip``; with ``bound`` those that can hold a score of ``least``."""
        c, dim, lists = self.centroids, self.dim, sorted(j for j in self._lists() if j != NOWHERE)
        known = self._lists()
        radius = np.array([known[j]["radius"] for j in lists])
        take = len(lists) if limit is None else min(limit, len(lists))
        numbers = np.array(lists, np.int32)
        out_type = "query_id long, q array<double>, list int, place int, least double"

        def run(batches):
            for b in batches:
                x, ok = directions(b["query_vector"], dim)
                ids, ok = b["query_id"], np.flatnonzero(ok)
                least = b["least"].to_numpy(zero_copy_only=False)
                worst = np.sqrt(np.maximum(2 - 2 * least, 0))
                step = max(1, PROBES // max(1, take))
                for lo in range(0, len(ok) if lists else 0, step):
                    own = ok[lo : lo + step]
                    d = np.sqrt(np.maximum((x[own] ** 2).sum(1)[:, None] - 2 * x[own] @ c[lists].T + (c[lists] ** 2).sum(1)[None, :], 0))
                    order = np.argsort(d, axis=1, kind="stable")[:, skip:take]
                    left = np.take_along_axis(d, order, 1) - radius[order] <= worst[own][:, None] + _SLACK if bound else np.ones(order.shape, bool)
                    at, place = np.nonzero(left)
                    q = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), pa.array(x[own[at]].ravel()))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[at])), q, pa.array(numbers[order[at, place]]), pa.array((place + skip).astype(np.int32)), pa.array(least[own[at]])], names=["query_id", "q", "list", "place", "least"])

        cols = [F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<float>").alias("query_vector")]
        least = F.col("least") if "least" in queries.columns else F.lit(float("-inf"))
        return queries.select(*cols, least.cast("double").alias("least")).mapInArrow(run, out_type)

    def _score(self, probes: DataFrame, best: int | None, codes: bool, n_queries: int) -> DataFrame:
        """The ``best`` rows of each query and block of a list that score at least the query's ``least``: query_id, id, score, list, version, row; by codes alone, or exactly."""
        c, books, parts, dim = self.centroids, self.books, self.parts(self.dim, len(self.books)), self.dim
        wanted = {r[0] for r in probes.select("list").distinct().collect()}  # at most as many as there are lists
        blocks = [(j, -(-x["rows"] // BLOCK)) for j, x in self._lists(wanted).items()]
        out = "query_id long, id long, score double, list int, version int, row long"
        if not blocks:
            return self.spark.createDataFrame([], out)
        per_list = F.broadcast(self.spark.createDataFrame(blocks, "list int, blocks int"))  # bounded by the number of lists
        q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
        left = self.rows(wanted).select("id", "list", "version", "row", *(["code"] if codes else ["vector"])).join(per_list, "list")
        left = left.withColumn("block", F.pmod(F.xxhash64("version", "row"), F.col("blocks")).cast("int")).drop("blocks")
        left = left.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(q_blocks)])))
        right = probes.join(per_list, "list").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
        right = right.select("query_id", "q", "least", "list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        keys = ["list", "block", "part"]

        def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
            got = []
            if rows.num_rows and asked.num_rows:
                ids = np.array(rows["id"].to_pylist(), object)
                order = np.array([-(1 << 63) if i is None else i for i in ids.tolist()], np.int64)
                q = asked["q"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
                if codes:
                    code = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
                    at = q @ c[rows["list"][0].as_py()]
                    tables = [q[:, s:e] @ k.T for k, (s, e) in zip(books, parts, strict=True)]
                else:
                    x, _ = directions(rows["vector"].combine_chunks(), dim)
                least = asked["least"].to_numpy() - _SLACK
                for i, qid in enumerate(asked["query_id"].to_pylist()):
                    s = at[i] + sum(t[i][code[:, m]] for m, t in enumerate(tables)) if codes else x @ q[i]
                    keep = np.flatnonzero(s >= least[i])
                    if best is not None and len(keep) > best:
                        keep = keep[s[keep] >= np.partition(s[keep], len(keep) - best)[len(keep) - best]]
                        keep = keep[np.lexsort((order[keep], -s[keep]))][:best]
                    got.append((np.full(len(keep), qid), keep, s[keep]))
            at = np.concatenate([g[1] for g in got]) if got else np.zeros(0, int)
            cols = {k: rows[k].take(pa.array(at)) for k in ("id", "list", "version", "row")} if len(at) else {k: pa.array([], t) for k, t in (("id", pa.int64()), ("list", pa.int32()), ("version", pa.int32()), ("row", pa.int64()))}
            ask = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
            score = np.concatenate([g[2] for g in got]) if got else np.zeros(0)
            return pa.table({"query_id": pa.array(ask.astype(np.int64)), "id": cols["id"], "score": pa.array(score), "list": cols["list"], "version": cols["version"], "row": cols["row"]})

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, out)

    @staticmethod
    def _top(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    @staticmethod
    def _each(queries: DataFrame, rows: list) -> DataFrame:
        """Each query with these k rows (id, list) at 0.0."""
        own = F.array(*[F.struct(F.lit(r["id"]).cast("long").alias("id"), F.lit(r["list"]).alias("list")) for r in rows]) if rows else F.expr("CAST(array() AS array<struct<id:bigint,list:int>>)")
        return queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(own).alias("e")).select("query_id", "e.id", F.lit(0.0).alias("score"), "e.list")

    def _nowhere(self, queries: DataFrame, k: int) -> DataFrame:
        """Rows without a direction score 0.0 with everything, as in the plain search: the k smallest ids stand for them."""
        return self._each(queries, self.rows({NOWHERE}).select("id", "list").orderBy("id").limit(k).collect())

    @staticmethod
    def _bounded(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """Queries with ``least``, the k-th score found; none if fewer were."""
        own = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("query_id", F.col("s").alias("least"))
        return queries.join(own, "query_id", "left").select("query_id", "query_vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))

    def candidates(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """Approximate top k by exact scores of the best codes: query_id, id, score, list."""
        n, limit, depth = queries.count(), probes or self.probes, rerank or max(self.depth, 10 * k)
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<float>").alias("query_vector"))
        head = max(1, limit // FIRST)
        rough = self._top(self._score(self._probes(asked, head), depth, True, n), depth).select("query_id", "id", "score", "list", "version", "row")
        if head < limit:
            tail = self._probes(self._bounded(asked, rough, depth), limit, skip=head)
            rough = self._top(rough.unionByName(self._score(tail, depth, True, n)), depth)
        rough = rough.select("query_id", "list", "version", "row")
        rows = self.rows().select("id", "vector", "list", "version", "row")
        both = rough.join(rows, ["list", "version", "row"]).join(asked, "query_id")
        from cairn.functions.vectors import cosine

        return both.select("query_id", "id", cosine(F.col("vector"), F.col("query_vector")).alias("score"), "list")

    def search(self, queries: DataFrame, k: int = 10, exact: bool = False, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """``query_id, id, score, rank, list`` for queries (query_id, query_vector), of distinct ids.

        exact: the same rows as a search over all vectors.  A query without a direction finds the smallest ids with 0.0
        in the exact mode, and of the approximate one only rows without a direction.
        """
        rough = self._top(self.candidates(queries, k, probes, rerank), k)
        if not exact:
            return self._top(rough.select("query_id", "id", "score", "list").unionByName(self._nowhere(queries, k)), k)
        # a list may be left out if all its rows are farther than the k-th one found, and so may its rows that are
        asked = self._bounded(queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vector"), rough, k)
        found = self._score(self._probes(asked, None, True), k, False, queries.count()).select("query_id", "id", "score", "list")
        return self._top(found.unionByName(self._nowhere(queries, k)).unionByName(self._aimless(queries, k)), k)

    def _aimless(self, queries: DataFrame, k: int) -> DataFrame:
        """What queries without a direction find among rows that have one."""
        v = F.col("query_vector").cast("array<double>")
        length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
        aimless = queries.where(v.isNull() | (F.size(v) != self.dim) | length.isNull() | F.isnan(length) | (length == 0) | (length == float("inf"))).select(F.col("query_id").cast("long").alias("query_id"))
        return self._each(aimless, self.rows().where(F.col("list") != NOWHERE).select("id", "list").orderBy("id").limit(k).collect())

    def _code_scores(self, q: np.ndarray, lists: np.ndarray, codes: list[bytes]) -> np.ndarray:
        """What the codes of some rows score, each with its own query."""
        own = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        return (q * self.centroids[lists]).sum(1) + sum((q[:, s:e] * k[own[:, m]]).sum(1) for m, (k, (s, e)) in enumerate(zip(self.books, self.parts(self.dim, len(self.books)), strict=True)))

    def _calibrate(self, target: float, k: int, seed: int) -> None:
        """Sets the numbers of probes and of codes to re-rank so that these hold the target share of the exact neighbours of sample queries; the lists alone hold half of what is left to all."""
        drawn = self.rows().where(F.col("list") != NOWHERE).orderBy(F.xxhash64(F.lit(seed + 1), "id", "vector")).limit(CALIBRATION)
        vectors = [r["vector"] for r in drawn.select("vector").collect()]
        sample = self.spark.createDataFrame(list(enumerate(vectors)), "query_id long, query_vector array<float>")
        true = self._top(self._score(self._probes(sample, None), k, False, CALIBRATION), k)
        true = true.join(self._probes(sample, None).select("query_id", "list", "place"), ["query_id", "list"]).select("query_id", "list", "version", "row", "place")
        hits = self.rows().select("list", "version", "row", "code").join(F.broadcast(true), ["list", "version", "row"]).collect()  # at most k rows a sample query
        share = lambda sorted_, part: sorted_[min(len(sorted_), max(1, math.ceil(part * len(hits)))) - 1]
        probes, depth = 1, 1
        if hits:
            probes = share(sorted(r["place"] for r in hits), (1 + target) / 2) + 1
            inside = [r for r in hits if r["place"] < probes]
            x, _ = directions(pa.array([vectors[r["query_id"]] for r in inside], pa.list_(pa.float32())), self.dim)
            least: dict[int, float] = {}
            for r, s in zip(inside, self._code_scores(x, np.array([r["list"] for r in inside]), [bytes(r["code"]) for r in inside]).tolist(), strict=True):
                least[r["query_id"]] = min(least.get(r["query_id"], s), s)
            bounds = self.spark.createDataFrame([(i, vectors[i], s) for i, s in least.items()], "query_id long, query_vector array<float>, least double")
            ranked = self._score(self._probes(bounds, probes), None, True, CALIBRATION).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
            keys = ["query_id", "list", "version", "row"]
            wanted = self.spark.createDataFrame([tuple(r[c] for c in keys) for r in inside], "query_id long, list int, version int, row long")
            depth = share(sorted(r["rank"] for r in ranked.join(F.broadcast(wanted), keys).select("rank").collect()), target)
        self.probes, self.depth = probes, max(100, depth)
        m = self.snap.read()
        self.snap.commit({**m, "version": m["version"] + 1, "probes": self.probes, "depth": self.depth})
