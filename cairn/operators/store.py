"""The store on Parquet: base and delta files, deletion vectors and file statistics, named by a manifest.

A change appends what is new as delta files and marks what goes by file and position, so that it writes in proportion to
itself and not to the store; reads leave marked rows out.  ``compact`` folds deltas and marks into new base files, along a
Z-order curve of some columns.  Every file has a row of statistics (least and largest values, hashes of its sources, its
source types), by which filtered reads and changes choose the files that they open.  The registry of files is a log of
which the newest row of a path counts.

Readers see the old or the new manifest; a failed change leaves the old one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.functions.paths import shard_of
from cairn.functions.vectors import norm
from cairn.operators import sync
from cairn.operators.snapshots import Snapshots
from cairn.schema import REGISTRY, STORE, conform

#: Files that compaction makes of a shard; distinct sources and types that a file's statistics hold; values that choose files one by one.
SPLITS, SOURCES, TYPES, FEW = 8, 64, 16, 200
#: Rows of a base file, about.
FILE_ROWS = 500_000
#: Marked rows that are broadcast to readers one by one, at about 330 bytes each; more are broadcast as maps of BLOCK bits (4 KB, a file and
#: BLOCK of its positions each), if there are at most MAPS of them, and joined by a shuffle if not.
MARKS, BLOCK, MAPS = 100_000, 32768, 8000
#: Values that the bounds of a Z-order column are drawn from, and the bits of its part of the curve.
Z_SAMPLE, Z_BITS = 4096, 8
STATS = "file string, shard int, rows long, created_at_min long, created_at_max long, id_min long, id_max long, source_min string, source_max string, sources array<long>, types array<string>"
MARK = "file string, position long"
#: Slots of a shard: sources fall into slots by their md5, and rebalancing moves whole slots.
SLOTS = 64
LOG = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REGISTRY.fields) + ", seq long, gone boolean"


class ParquetStore:
    def __init__(self, spark: SparkSession, path: str, shards: int = 4, dimension: int | None = None, strict_dimension: bool = False):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        self.dimension, self.strict = dimension, strict_dimension
        self.snap = Snapshots(spark, self.path)
        if not self.snap.versions():
            self.snap.commit({"version": 0, "n": shards, "dimension": dimension, "shards": {}, "stats": [], "marks": [], "marked": 0, "registry": []})
        else:
            self.shards = self.snap.read()["n"]

    @property
    def version(self) -> int:
        return self.snap.version

    def _in(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    # reads

    def files(self, shards: Iterable[int] | None = None, filters: Mapping | None = None) -> DataFrame:
        """Statistics of the files that can have matching rows."""
        m = self.snap.read()
        live = {f for s, folders in m["shards"].items() if shards is None or int(s) in set(shards) for f in folders}
        every = self._in(m["stats"], STATS).where(F.regexp_extract("file", r"^(.*)/", 1).isin(sorted(live)))
        cond = _may_match(filters)
        return every if cond is None else every.where(cond)

    def df(self, shard: int | None = None, filters: Mapping | None = None) -> DataFrame:
        """The current rows, or those of one shard.  With filters only files that can have matching rows are opened; their rows aren't filtered yet."""
        return self._live(None if shard is None else [shard], filters).select(*STORE.names)

    def _live(self, shards: Iterable[int] | None, filters: Mapping | None = None, chosen: DataFrame | None = None) -> DataFrame:
        """Rows that aren't marked, with their ``__file`` and ``__position``."""
        m = self.snap.read()
        if chosen is None and _may_match(filters) is not None:
            chosen = self.files(shards, filters)
        if chosen is not None:
            own = [r[0] for r in chosen.select("file").collect()]
        else:
            own = [f for s, folders in m["shards"].items() if shards is None or int(s) in set(shards) for f in folders]
        rows = _placed(self._in(own, STORE)) if own else self.spark.createDataFrame([], STORE).withColumns({"__file": F.lit(""), "__position": F.lit(0).cast("long")})
        if not m["marks"] or not own:
            return rows
        marks = self._in(m["marks"], MARK).select(F.col("file").alias("__file"), F.col("position").alias("__position"))
        if m["marked"] > MARKS and m.get("maps", m["marked"]) <= MAPS:
            left = rows.withColumn("__block", _block("__position")).join(F.broadcast(_bit_maps(marks)), ["__file", "__block"], "left").where(~_in_map("__bits", "__position"))
        else:
            left = rows.join(F.broadcast(marks) if m["marked"] <= MARKS else marks, ["__file", "__position"], "left_anti")
        return left.select(*STORE.names, "__file", "__position")

    def registry(self) -> DataFrame:
        folders = self.snap.read()["registry"]
        log = self._in(folders, LOG)
        if len(folders) > 1:
            log = log.groupBy("file_path").agg(F.max_by(F.struct(*log.columns), "seq").alias("r")).select("r.*")
        return log.where(~F.col("gone")).select(*REGISTRY.names)

    def route(self, source: Column) -> Column:
        """The shard of a source: its md5 modulo their number, unless its slot was moved by ``rebalance``."""
        moved = self.snap.read().get("routes", {})
        source = F.coalesce(source, F.lit(""))
        if not moved:
            return shard_of(source, self.shards)
        slot = shard_of(source, self.shards * SLOTS)
        table = F.create_map(*[F.lit(x) for pair in sorted((int(s), n) for s, n in moved.items()) for x in pair])
        return F.coalesce(F.try_element_at(table, slot), F.pmod(slot, F.lit(self.shards))).cast("int")

    def _shard(self, source: str) -> int:
        import hashlib

        digest = int(hashlib.md5(source.encode()).hexdigest(), 16)
        return self.snap.read().get("routes", {}).get(str(digest % (self.shards * SLOTS)), digest % self.shards)

    def source_rows(self, source: str) -> DataFrame:
        """Rows of a source: only files of its shard that can have it are read."""
        return self.df(self._shard(source), {"source": source}).where(F.col("source") == source)

    def file_exists(self, source: str) -> bool:
        return bool(self.source_rows(source).select("id").limit(1).collect())

    def scroll(self, n: int, filters: dict | None = None, columns: Iterable[str] = ("id", "source"), after: tuple | None = None, by: str = "created_at") -> DataFrame:
        """A page of rows by (``by``, id), after the pair ``after``: n of them, and any more that share the last one's pair.

        by: created_at or id.  Files that end before the page, and without filters those that begin after it, aren't opened.
        """
        from cairn.operators.filters import apply

        rows = apply(self._live(None, filters, self._page_files(n, filters, after, by)), filters)
        if after is not None:
            rows = rows.where(_after(by, after))
        own = rows.select(by, "id").orderBy(by, "id").limit(n).collect()  # one page
        if not own:
            return rows.select(*columns).limit(0)
        return rows.where(~_after(by, tuple(own[-1]))).orderBy(by, "id").select(*columns)

    def _page_files(self, n: int, filters: dict | None, after: tuple | None, by: str) -> DataFrame:
        low, high = f"{by}_min", f"{by}_max"
        own = self.files(None, filters)
        if after is not None and after[0] is not None:
            own = own.where(F.col(high) >= F.lit(after[0]))
        if filters:
            return own
        # files that lie wholly after the cursor, in order of their ends, until they have a page of unmarked rows
        marked = self._in(self.snap.read()["marks"], MARK).groupBy("file").agg(F.count("*").alias("marked"))
        left = own.join(marked, "file", "left").select(low, high, (F.col("rows") - F.coalesce("marked", F.lit(0))).alias("rows"))
        if after is not None and after[0] is not None:
            left = left.where(F.col(low) > F.lit(after[0]))
        have, end = 0, None
        for r in left.where(F.col(high).isNotNull()).orderBy(high).collect():  # one row a file
            have += r["rows"]
            if have >= n:
                end = r[high]
                break
        return own if end is None else own.where(F.col(low).isNull() | (F.col(low) <= F.lit(end)))

    def pages(self, n: int, filters: dict | None = None, columns: Iterable[str] = ("id", "source"), by: str = "created_at") -> Iterator[DataFrame]:
        """All pages of ``scroll``, of the store as it is when each is made."""
        after, columns = None, list(columns)
        while True:
            page = self.scroll(n, filters, dict.fromkeys([*columns, by, "id"]), after, by)
            last = page.select(by, "id").orderBy(F.desc(by), F.desc_nulls_last("id")).limit(1).collect()
            if not last:
                return
            yield page.select(*columns)
            after = tuple(last[0])

    def cached(self) -> DataFrame:
        """The current rows, kept by the executors for repeated searches; ``unpersist`` gives them back."""
        return self.df().persist()

    def file_needs_update(self, path: str) -> bool:
        """False if the file is missing; true if it isn't registered, its hash differs or it is newer."""
        from cairn.sources.files import registry_rows

        where = self.snap._path(path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return False
        raw = self.spark.read.format("binaryFile").load(path).select(F.lit(path).alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
        known = self.registry().where(F.col("file_path") == path)
        return sync.classify(registry_rows(raw), known).first()["action"] != "unchanged"

    # changes

    def prepare(self, rows: DataFrame, now: int | None = None) -> DataFrame:
        """Store rows: defaults for an absent source_type, ids from source, index and content, norm, shard, one time for all unless created_at is given."""
        have = rows.columns
        out = rows.withColumns(
            {
                "source_type": F.col("source_type") if "source_type" in have else F.lit("unknown"),
                "created_at": F.lit(now).cast("long") if now is not None else F.col("created_at") if "created_at" in have else F.unix_timestamp(),
                "vector_norm": norm(F.col("vector")),
                "shard": self.route(F.col("source")),
                "id": F.col("id") if "id" in have else F.xxhash64("source", F.col("chunk_index") if "chunk_index" in have else F.lit(0), "content"),
            }
        )
        return conform(out)

    def _stage(self, rows: DataFrame, null_vectors: bool = True) -> tuple[str, DataFrame]:
        """Writes prepared rows as delta files, the only time that they are evaluated; a ValueError takes the files back."""
        folder = self.snap.new("data", self.version + 1)
        rows.withColumn("bucket", F.col("shard")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        staged = self._in([folder], STORE)
        wrong = None
        if not null_vectors and staged.where(F.col("vector").isNull()).limit(1).count():
            wrong = "each row needs a vector"
        elif self.strict and self.dimension and staged.where(F.size("vector") != self.dimension).limit(1).count():
            wrong = f"a vector's length isn't {self.dimension}"
        if wrong:
            self.snap.fs.delete(self.snap.at(folder), True)
            raise ValueError(wrong)
        return folder, staged

    def _made(self, folder: str) -> list[str]:
        return [f"{folder}/{name}" for name in self.snap.names(folder) if name.startswith("bucket=")]

    def _stats_of(self, folder: str) -> str:
        """Writes the statistics of a folder's files."""
        own = _placed(self._in(self._made(folder), STORE)).groupBy(F.col("__file").alias("file"), "shard").agg(
            F.count("*").alias("rows"), *[f(c).alias(f"{c}_{n}") for c in ("created_at", "id", "source") for f, n in ((F.min, "min"), (F.max, "max"))],
            F.collect_set(F.xxhash64("source")).alias("sources"), F.collect_set("source_type").alias("types"), F.max(F.col("source_type").isNull()).alias("untyped"),
        )
        few = lambda c, n: F.when(F.size(c) <= n, F.col(c))
        own = own.withColumns({"sources": few("sources", SOURCES), "types": F.when(~F.col("untyped"), few("types", TYPES))}).drop("untyped")
        name = folder.replace("data/", "stats/", 1)
        own.select(*[x.split()[0] for x in STATS.split(", ")]).write.parquet(f"{self.path}/{name}")
        return name

    def _mark(self, gone: DataFrame) -> tuple[str, int, int]:
        """Writes the places of rows that go; also how many they and their bit maps are."""
        name = self.snap.new("marks", self.version + 1)
        gone.select(F.col("__file").alias("file"), F.col("__position").alias("position")).write.parquet(f"{self.path}/{name}")
        return name, *self._marked(name)

    def _marked(self, name: str) -> tuple[int, int]:
        return tuple(self._in([name], MARK).agg(F.count("*"), F.count_distinct("file", _block("position"))).first())

    def _log(self, rows: DataFrame | None, gone: DataFrame | None, version: int) -> str:
        """Writes registry rows and the paths (file_path) that leave it; rows that a path also leaves by count more."""
        parts = []
        if gone is not None:
            left = gone.select("file_path").distinct()
            left = left if rows is None else left.join(rows.select("file_path"), "file_path", "left_anti")
            parts.append(conform(left, REGISTRY).withColumn("gone", F.lit(True)))
        if rows is not None:
            parts.append(conform(rows, REGISTRY).withColumn("gone", F.lit(False)))
        name = self.snap.new("registry", version)
        reduce(DataFrame.unionByName, parts).withColumn("seq", F.lit(version).cast("long")).select(*REGISTRY.names, "seq", "gone").write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, folder: str | None = None, gone: DataFrame | None = None, registry: DataFrame | None = None, unregistered: DataFrame | None = None, routes: dict[str, int] | None = None) -> int:
        """One change: a staged folder comes, the placed rows ``gone`` go, registry rows come and go, slots get other shards; how many rows went."""
        m = self.snap.read()
        version, n = m["version"] + 1, 0
        if gone is not None:
            name, n, maps = self._mark(gone)
            if n:
                m["marks"], m["marked"], m["maps"] = [*m["marks"], name], m["marked"] + n, m.get("maps", m["marked"]) + maps
        made = self._made(folder) if folder else []
        for f in made:
            m["shards"].setdefault(f.rpartition("=")[2], []).append(f)
        if made:
            m["stats"] = [*m["stats"], self._stats_of(folder)]
        if registry is not None or unregistered is not None:
            m["registry"] = [*m["registry"], self._log(registry, unregistered, version)]
        if routes:
            m["routes"] = {**m.get("routes", {}), **routes}
        if n or made or registry is not None or unregistered is not None or routes:
            self.snap.commit({**m, "version": version})
        return n

    def _touched(self, rows: DataFrame, column: str = "source") -> list[int]:
        """At most as many values as there are shards."""
        return [r[0] for r in rows.select(self.route(F.col(column))).distinct().collect()]

    def _of_sources(self, sources: DataFrame) -> DataFrame:
        """Placed rows of (source): few sources choose the files by their statistics, many only by their shards and hashes."""
        sources = sources.select("source").distinct()
        few = [r[0] for r in sources.limit(FEW + 1).collect()]
        touched = self._touched(sources)
        if len(few) <= FEW:
            chosen = self.files(touched, {"source": [s for s in few if s is not None]})
        else:
            files = self.files(touched)
            hit = files.select("file", F.explode("sources").alias("h")).join(sources.select(F.xxhash64("source").alias("h")), "h", "left_semi").select("file").distinct()
            chosen = files.where("sources is null").select("file").unionAll(hit)
        return self._live(None, chosen=chosen).join(sources, "source", "left_semi")

    def add(self, rows: DataFrame, now: int | None = None) -> None:
        """Appends rows (content, source, vector and any other column of the schema); a null vector is a ValueError, no rows a no-op."""
        self._commit(self._stage(self.prepare(rows, now), null_vectors=False)[0])

    def upsert(self, rows: DataFrame, now: int | None = None) -> None:
        """Rows replace those with their ids; ids must stay with their source's shard."""
        folder, staged = self._stage(self.prepare(rows, now))
        old = self._live(self._touched(staged)).join(staged.select("id").distinct(), "id", "left_semi")
        self._commit(folder, old)

    def replace(self, rows: DataFrame, now: int | None = None, registry: DataFrame | Callable[[DataFrame], DataFrame] | None = None, gone: DataFrame | None = None) -> int:
        """All rows of the new rows' sources, and of ``gone`` (source), go and the new ones come, in one change; returns how many went.

        Registry rows replace those of their paths, and may be made from the rows as they were written; those of gone sources
        that aren't among them go too.  ``rows`` are evaluated once.
        """
        folder, staged = self._stage(self.prepare(rows, now))
        sources = staged.select("source").distinct()
        sources = sources if gone is None else sources.union(gone.select("source")).distinct()
        reg = registry(staged) if callable(registry) else registry
        return self._commit(folder, self._of_sources(sources), reg, None if gone is None else gone.select(F.col("source").alias("file_path")))

    def update_registry(self, rows: DataFrame) -> None:
        """Registry rows, of any status, replace those of their paths."""
        self._commit(registry=rows)

    def delete(self, sources: DataFrame) -> int:
        """Deletes the rows, and registry rows, of (source) and returns how many store rows went."""
        paths = sources.select(F.col("source").alias("file_path")).distinct()
        known = self.registry().select("file_path").join(paths, "file_path", "left_semi")
        return self._commit(gone=self._of_sources(sources), unregistered=known if known.limit(1).count() else None)

    def delete_file(self, source: str) -> int:
        return self.delete(self.spark.createDataFrame([(source,)], "source string"))

    def remove_ids(self, ids: DataFrame) -> None:
        """Deletes rows by (id)."""
        self._commit(gone=self._live(None).join(ids.select("id").distinct(), "id", "left_semi"))

    # upkeep

    def z_order(self, rows: DataFrame, columns: Iterable[str]) -> Column:
        """The place on a Z-order curve of the columns, the first one's bits first, each by its rank among at most Z_SAMPLE drawn values; nulls come first."""
        columns, z = list(columns), F.lit(0).cast("long")
        for j, c in enumerate(columns):
            drawn = [r[0] for r in rows.where(F.col(c).isNotNull()).select(c).orderBy(F.xxhash64(c, "id")).limit(Z_SAMPLE).collect()]
            drawn.sort()
            n = 1 << Z_BITS
            bounds = sorted({drawn[i * len(drawn) // n] for i in range(1, n)}) if drawn else []
            rank = _rank(F.col(c), bounds)
            for bit in range(Z_BITS):
                z = z.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(columns) + len(columns) - 1 - j))
        return z

    def compact(self, keep: int = 1, cluster_by: Iterable[str] = ("created_at", "source"), only: Iterable[int] | None = None, files: int = SPLITS) -> None:
        """Folds deltas, marks and the registry's log into new base files of all shards, or some, in order of a Z-order curve.

        A shard gets ``files`` files, and more where they would have over FILE_ROWS rows on average.

        All but the newest ``keep`` states go with the files that only they name: readers of older ones need a larger number.
        """
        m = self.snap.read()
        own = [s for s in m["shards"] if only is None or int(s) in set(only)]
        version = m["version"] + 1
        if own:
            rows = self._live([int(s) for s in own]).select(*STORE.names)
            folder = self.snap.new("data", version)
            # the order is computed once a row, by the column that the ranges are made of
            placed = rows.withColumns({"__z": self.z_order(rows, cluster_by), "bucket": F.col("shard")})
            parts = max(files * len(own), -(-(self.files([int(s) for s in own]).agg(F.sum("rows")).first()[0] or 0) // FILE_ROWS))
            placed.repartitionByRange(parts, "bucket", "__z", "id").sortWithinPartitions("bucket", "__z", "id").drop("__z").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            made = self._made(folder)
            rest = {s: f for s, f in m["shards"].items() if s not in own}
            m["shards"] = rest | {f.rpartition("=")[2]: [f] for f in made}
            kept = self._in(m["stats"], STATS).where(F.regexp_extract("file", r"^(.*)/", 1).isin([f for x in rest.values() for f in x]))
            fresh = [self._stats_of(folder)] if made else []
            m["stats"] = fresh
            if rest:
                name = self.snap.new("stats", version)
                kept.write.parquet(f"{self.path}/{name}")
                m["stats"] = [*fresh, name]
            marks = self._in(m["marks"], MARK).where(~F.regexp_extract("file", r"bucket=(\d+)/", 1).isin(own))
            m["marks"], m["marked"], m["maps"] = [], 0, 0
            if rest:
                name = self.snap.new("marks", version)
                marks.write.parquet(f"{self.path}/{name}")
                n, maps = self._marked(name)
                if n:
                    m["marks"], m["marked"], m["maps"] = [name], n, maps
        if len(m["registry"]) > 1:
            name = self.snap.new("registry", version)
            self.registry().withColumns({"seq": F.lit(version).cast("long"), "gone": F.lit(False)}).write.parquet(f"{self.path}/{name}")
            m["registry"] = [name]
        self.snap.commit({**m, "version": version})
        live: set[str] = set()
        for x in self.snap.forget(keep):
            live |= {f.rpartition("/")[0] for folders in x["shards"].values() for f in folders} | {*x["stats"], *x["marks"], *x["registry"]}
        self.snap.sweep(["data", "stats", "marks", "registry"], live)

    def rebalance(self, threshold: float = 0.3) -> dict:
        """Moves slots from shards that hold too much to those that hold too little until (most - least) / mean is at most the threshold.

        Rows of a source stay together, so a source with more rows than a balanced shard sets the least imbalance; the status
        is then ``partial``. Only rows of moved slots are written, as deltas, and their old places marked, in one change. A
        store without rows or within the threshold is ``skipped``. What reaches the driver is a count for each slot.
        """
        slot = shard_of(F.coalesce(F.col("source"), F.lit("")), self.shards * SLOTS)
        sizes = {(r["slot"], r["shard"]): r["n"] for r in self.df().groupBy(slot.alias("slot"), "shard").agg(F.count("*").alias("n")).collect()}
        moves, before, after = plan_moves(sizes, self.shards, threshold)
        out = {"status": "skipped", "imbalance": before, "after": after, "moved_slots": len(moves), "moved_rows": 0}
        if moves:
            table = F.create_map(*[F.lit(x) for pair in sorted(moves.items()) for x in pair])
            given = {shard for (s, shard) in sizes if s in moves}
            placed = self._live(given).where(slot.isin(sorted(moves)))
            folder, _ = self._stage(placed.withColumn("shard", F.element_at(table, slot).cast("int")).select(*STORE.names))
            out["moved_rows"] = self._commit(folder, placed, routes={str(s): n for s, n in moves.items()})
        if before > threshold:
            out["status"] = "done" if after <= threshold else "partial"
        return out

    def size_bytes(self) -> int:
        return int(self.snap.fs.getContentSummary(self.snap.at("")).getLength())


def plan_moves(sizes: Mapping[tuple[int, int], int], shards: int, threshold: float) -> tuple[dict[int, int], float, float]:
    """({slot: shard}, imbalance before, after) from rows by (slot, shard): the fullest shard gives the emptiest one the largest slot that makes them more alike."""
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    for (slot, shard), n in sizes.items():
        held[shard][slot] = held[shard].get(slot, 0) + n
    total = [sum(h.values()) for h in held]
    ratio = lambda: (max(total) - min(total)) * shards / sum(total) if sum(total) else 0.0
    before, moves = ratio(), {}
    while ratio() > threshold:
        low = min(range(shards), key=lambda i: (total[i], i))
        for high in sorted(range(shards), key=lambda i: (-total[i], i)):
            gap = total[high] - total[low]
            fit = [(n if 2 * n <= gap else gap - n, -slot, slot, n) for slot, n in held[high].items() if 0 < n < gap]
            if fit:
                break
        else:
            break
        _, _, slot, n = max(fit)
        held[low][slot] = held[low].get(slot, 0) + held[high].pop(slot)
        total[high], total[low], moves[slot] = total[high] - n, total[low] + n, low
    return moves, before, ratio()


def _placed(rows: DataFrame) -> DataFrame:
    """Adds the row's file, by its name in the store, and its position there."""
    name = F.regexp_extract("_metadata.file_path", r"(data/[^/]+/bucket=[^/]+/[^/]+)$", 1)
    return rows.select("*", name.alias("__file"), F.col("_metadata.row_index").alias("__position"))


def _block(position: str) -> Column:
    return F.floor(F.col(position) / BLOCK)


def _bit_maps(marks: DataFrame) -> DataFrame:
    """``__file, __block, __bits`` of (__file, __position)."""
    return marks.groupBy("__file", _block("__position").alias("__block")).agg(F.bitmap_construct_agg(F.pmod("__position", F.lit(BLOCK))).alias("__bits"))


def _in_map(bits: str, position: str) -> Column:
    """Whether the position's bit is set; false without a map."""
    at = F.pmod(F.col(position), F.lit(BLOCK)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def _rank(c: Column, bounds: list) -> Column:
    """How many bounds a value reaches; 0 for null."""
    return F.when(c.isNotNull(), F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= c))).otherwise(F.lit(0)) if bounds else F.lit(0)


def _after(by: str, pair: tuple) -> Column:
    """(by, id) > pair, nulls first."""

    def more(c: str, x) -> Column:
        return F.col(c).isNotNull() if x is None else F.coalesce(F.col(c) > F.lit(x), F.lit(False))

    return more(by, pair[0]) | (F.col(by).eqNullSafe(F.lit(pair[0])) & more("id", pair[1]))


def _may_match(filters: Mapping | None) -> Column | None:
    """Whether a file can have rows that match, by its statistics; None if no filter tells."""
    parts: list[Column] = []
    for key, value in (filters or {}).items():
        key = key.removeprefix("metadata.") if key.removeprefix("metadata.") in ("source", "source_type") else key
        values = list(value) if isinstance(value, list | tuple | set) else [value]
        if key == "source":
            ranged = [(F.col("source_min") <= F.lit(v)) & (F.col("source_max") >= F.lit(v)) for v in values]
            hashed = F.arrays_overlap("sources", F.array(*[F.xxhash64(F.lit(v)) for v in values])) if values else F.lit(False)
            parts.append(F.coalesce(reduce(Column.__or__, ranged, F.lit(False)), F.lit(False)) & F.coalesce(hashed, F.lit(True)))
        elif key == "source_type":
            parts.append(F.coalesce(F.arrays_overlap("types", F.array(*[F.lit(v) for v in values])) if values else F.lit(False), F.lit(True)))
        elif key == "created_after":
            parts.append(F.coalesce(F.col("created_at_max") > F.lit(value), F.lit(False)))
        elif key == "created_before":
            parts.append(F.coalesce(F.col("created_at_min") < F.lit(value), F.lit(False)))
    return reduce(Column.__and__, parts) if parts else None
