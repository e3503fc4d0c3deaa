"""Files whose schema has drifted, rewritten to the evolved schema: one task a file, columns matched by Parquet field id.

``ranked`` gives every row its global rank without any single task: a range-partitioned sort is written with each row's
place (partition and position), the partitions are counted, and the counts' prefix sums turn places into ranks.  The
driver gets one count for each partition, whose number is the session's ``spark.sql.shuffle.partitions``.

Each of ``write_files``, ``rewrite`` and ``retire`` is one job whose tasks own one file each and stream it by row groups.
A file appears whole under its name (written to a staging folder, then moved), and a rewritten one has another name than
its original, which goes only when all replacements are there: a task that runs again finds its input unchanged.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.llm._files import _open, exists, move_stream, remove
from cairn.llm._spark import Scratch, shared_dir

#: A row group is written when so many rows or bytes are held.
GROUP_ROWS, GROUP_BYTES = 50_000, 32 << 20
#: Bits of a place that number the rows of a partition.
_POSITION = 33

#: The evolved schema's columns in order of their field ids, from 1, and what stands for missing columns.
EVOLVED = {
    "client_id": "long", "master_id": "long", "source": "string", "updated_at": "timestamp_ntz", "name": "string", "email": "string", "city": "string",
    "nation_id": "long", "segment": "string", "balance": "double",
}
DEFAULTS = {"nation_id": -1, "segment": "none"}
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "double": pa.float64(), "float": pa.float32()}
FILES = "file_no long, version int, n_rows long, start_columns string, path string"


def _field(number: int, name: str, kind: pa.DataType) -> pa.Field:
    return pa.field(name, kind, metadata={b"PARQUET:field_id": str(number).encode()})


def evolved_schema() -> pa.Schema:
    return pa.schema([_field(i, name, ARROW[kind]) for i, (name, kind) in enumerate(EVOLVED.items(), 1)])


def drifted_schema(version: int) -> pa.Schema:
    """The evolved schema as files of a version have it: same field ids, drifted by the version's bits.

    1: name and email have each other's name; 2: columns after the first are reversed; 4: nation_id and segment are
    missing; 8: balance is float and nation_id int.
    """
    kinds = EVOLVED | ({"balance": "float", "nation_id": "int"} if version & 8 else {})
    names = {"name": "email", "email": "name"} if version & 1 else {}
    fields = [_field(i, names.get(name, name), ARROW[kind]) for i, (name, kind) in enumerate(kinds.items(), 1) if not (version & 4 and name in DEFAULTS)]
    return pa.schema(fields[:1] + fields[:0:-1] if version & 2 else fields)


def version_of(file_no: int, seed: int = 19) -> int:
    v = zlib.crc32(f"{seed}:{file_no}".encode()) % 24
    return 0 if v > 15 else v


def by_id(schema: pa.Schema) -> dict[int, str]:
    """Column positions by Parquet field id; a column without one is a ValueError."""
    out = {}
    for i, f in enumerate(schema):
        if b"PARQUET:field_id" not in (f.metadata or {}):
            raise ValueError(f"column {f.name!r} has no field id")
        out[int(f.metadata[b"PARQUET:field_id"])] = i
    return out


def rebuilt(batch: pa.RecordBatch, source: pa.Schema, target: pa.Schema, defaults: Mapping[str, object]) -> pa.RecordBatch:
    """The batch's columns under the target's names, types and order, found by field id; a missing one gets its default, or nulls."""
    at, columns = by_id(source), []
    for number, i in by_id(target).items():
        f = target.field(i)
        if number in at:
            columns.append(batch.column(at[number]).cast(f.type))
        else:
            value = defaults.get(f.name)
            columns.append(pa.nulls(batch.num_rows, f.type) if value is None else pa.repeat(pa.scalar(value, f.type), batch.num_rows))
    return pa.RecordBatch.from_arrays(columns, schema=target)


def _same(a: pa.Schema, b: pa.Schema) -> bool:
    return [(f.name, f.type) for f in a] == [(f.name, f.type) for f in b] and by_id(a) == by_id(b)


# ranks


def ranked(rows: DataFrame, keys: Sequence[str | Column], scratch: Scratch, rank: str = "rank") -> tuple[DataFrame, int]:
    """Adds each row's rank (from 0, nulls first) by the keys, and tells how many rows there are.

    Rows with equal keys are ranked in the order of the input's files, so that hot keys spread over partitions too.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"__key{i}" for i in range(len(keys))]
    keyed = rows.withColumns({**{k: F.col(e) if isinstance(e, str) else e for k, e in zip(names, keys, strict=True)}, "__tie": F.monotonically_increasing_id()})
    order = [*names, "__tie"]
    placed = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop(*order).withColumn("__place", F.monotonically_increasing_id())
    table = scratch.table(placed, "sorted")
    part = F.shiftright("__place", _POSITION).cast("int")
    counts = {r[0]: r[1] for r in table.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    start = F.element_at(F.split(F.lit(",".join(map(str, before or [0]))), ","), part + 1).cast("long")
    return table.withColumn(rank, start + F.col("__place").bitwiseAND(F.lit((1 << _POSITION) - 1))).drop("__place"), total


# files


class _Writer:
    """Streams batches into one Parquet file in row groups; it appears under its name at ``close``."""

    def __init__(self, path: str, staging: str, schema: pa.Schema):
        self.schema, self.held, self.rows = schema, [], 0
        self._end = move_stream(f"{staging}/{uuid.uuid4().hex}", path)
        self._file = pq.ParquetWriter(next(self._end), schema)

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        if sum(b.num_rows for b in self.held) >= GROUP_ROWS or sum(b.nbytes for b in self.held) >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self._file.write_table(pa.Table.from_batches(self.held, self.schema))
            self.held = []

    def close(self) -> None:
        self._flush()
        self._file.close()
        next(self._end, None)


def _names(schema: pa.Schema) -> str:
    return ",".join(schema.names)


def _batches(path: str) -> tuple[pa.Schema, Iterator[pa.RecordBatch]]:
    system, p = _open(path)
    file = pq.ParquetFile(system.open_input_file(p))
    return file.schema_arrow, file.iter_batches(batch_size=GROUP_ROWS)


def write_files(rows: DataFrame, per_file: int, total: int, path: str, scratch: Scratch, seed: int = 19) -> DataFrame:
    """Writes rows of ``rank`` r, in order, to file floor(r / per_file) under ``path``, drifted by the file's version; the table of files."""
    files = -(-total // per_file)
    dealt = rows.withColumn("file_no", F.floor(F.col("rank") / F.lit(per_file)).cast("int"))
    dealt = dealt.repartitionById(max(1, files), F.col("file_no")).sortWithinPartitions("file_no", "rank")
    columns, evolved = list(EVOLVED), evolved_schema()

    def run(parts):
        own, writer, version, target = None, None, 0, None

        def closed():
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([version], pa.int32()), pa.array([writer.rows], pa.int64()), pa.array([_names(target)]), pa.array([f"{path}/files/clients-{own:05d}.parquet"])], names=["file_no", "version", "n_rows", "start_columns", "path"])

        for part in parts:
            numbers = part["file_no"].to_pylist()
            data = pa.RecordBatch.from_arrays([part[c].cast(evolved.field(c).type) for c in columns], schema=evolved)
            cuts = [0, *[i for i in range(1, len(numbers)) if numbers[i] != numbers[i - 1]], len(numbers)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if numbers[lo] != own:
                    if writer:
                        yield closed()
                    own, version = numbers[lo], version_of(numbers[lo], seed)
                    target = drifted_schema(version)
                    writer = _Writer(f"{path}/files/clients-{own:05d}.parquet", f"{path}/staging", target)
                piece = data.slice(lo, hi - lo)
                writer.add(pa.RecordBatch.from_arrays([piece.column(i - 1).cast(target.field(at).type, safe=False) for i, at in by_id(target).items()], schema=target))
        if writer:
            yield closed()

    return scratch.table(dealt.select(*columns, "file_no").mapInArrow(run, FILES), "files")


def _by_file(files: DataFrame) -> DataFrame:
    """One task for each row of a table of files."""
    n = files.agg(F.max("file_no")).first()[0]
    return files.repartitionById((n or 0) + 1, F.col("file_no").cast("int"))


def rewrite(files: DataFrame, path: str, scratch: Scratch, target: pa.Schema | None = None, defaults: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """Writes a replacement, of another name, for each file whose schema isn't the target; ``files`` with ``final`` and ``rewritten``."""
    target = target or evolved_schema()

    def run(parts):
        for part in parts:
            for row in part.to_pylist():
                schema, batches = _batches(row["path"])
                changed = not _same(schema, target)
                final = f"{path}/files/clients-{row['file_no']:05d}-evolved.parquet" if changed else row["path"]
                if changed:
                    writer = _Writer(final, f"{path}/staging", target)
                    for batch in batches:
                        writer.add(rebuilt(batch, schema, target, defaults))
                    writer.close()
                yield pa.RecordBatch.from_pylist([row | {"start_columns": _names(schema), "final": final, "rewritten": changed}], pa.schema([("file_no", pa.int64()), ("version", pa.int32()), ("n_rows", pa.int64()), ("start_columns", pa.string()), ("path", pa.string()), ("final", pa.string()), ("rewritten", pa.bool_())]))

    return scratch.table(_by_file(files).mapInArrow(run, FILES + ", final string, rewritten boolean"), "rewritten")


def _number(x: float | None) -> str:
    """floor(2^20 x), exactly; numbers that aren't finite by name."""
    if x is None:
        return "?"
    if not math.isfinite(x):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    return str(math.floor(x * 1048576.0)) if abs(x) < 1e300 else str(math.floor(x) << 20)


def _texts(batch: pa.RecordBatch) -> list[list[str]]:
    out = []
    for f, column in zip(batch.schema, batch.columns, strict=True):
        if pa.types.is_floating(f.type):
            out.append([_number(x) for x in column.to_pylist()])
        else:
            out.append(["?" if x is None else str(x) for x in (column.cast(pa.int64()) if pa.types.is_timestamp(f.type) else column).to_pylist()])
    return out


def digest(path: str) -> dict:
    """Of one file, read by row groups: rows, nulls, columns, and the digests of its ids and of all its rows."""
    schema, batches = _batches(path)
    ids, rows, n, nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
    for batch in batches:
        nulls += sum(c.null_count for c in batch.columns)
        texts = _texts(batch)
        if batch.num_rows:
            ids.update((("," if n else "") + ",".join(texts[0])).encode("utf-8", "surrogatepass"))
            rows.update((("\n" if n else "") + "\n".join(map("|".join, zip(*texts, strict=True)))).encode("utf-8", "surrogatepass"))
        n += batch.num_rows
    return {"n_rows": n, "n_nulls": nulls, "ids_sha256": ids.hexdigest(), "rows_sha256": rows.hexdigest(), "columns": _names(schema)}


def retire(files: DataFrame, scratch: Scratch) -> DataFrame:
    """Deletes the originals of rewritten files and reads every final file back: the report of ``schema_rewrite``."""
    report = "file_no long, version int, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    out = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in report.split(", "))])

    def run(parts):
        for part in parts:
            for row in part.to_pylist():
                if row["rewritten"] and exists(row["final"]):
                    remove(row["path"])
                yield pa.RecordBatch.from_pylist([row | digest(row["final"]) | {"path": row["final"]}], out)

    return scratch.table(_by_file(files).mapInArrow(run, report), "report")


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which stays."""
    return f"{shared_dir(spark)}/cairn-rewrite-{uuid.uuid4().hex}"


def schema_rewrite(clients: DataFrame, path: str | None = None, files: int = 250, seed: int = 19) -> DataFrame:
    """Sorts the rows by crc32 of the id, then the id, into drifted files under ``path``, rewrites those and reports every final file.

    A null id has no crc32 and comes first, as ``?``; rows of equal ids keep the order of the input's files; columns other
    than the evolved schema's are left out, under whatever name; nulls stay nulls; no rows make no files.  A balance that
    isn't finite is NaN, Infinity or -Infinity in the rows' digest.
    """
    scratch = Scratch(clients.sparkSession, "rewrite")
    path = (path or new_folder(clients.sparkSession)).rstrip("/")
    rows = clients.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in EVOLVED.items()])
    crc = F.crc32(F.col("client_id").cast("string"))
    rows, total = ranked(rows, [crc, "client_id"], scratch)
    written = write_files(rows, 1 + total // files, total, path, scratch, seed)
    return retire(rewrite(written, path, scratch), scratch)
