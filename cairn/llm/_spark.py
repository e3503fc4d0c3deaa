"""Shared plumbing of the corpus operators: scratch tables, size-checked joins, connected components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Counted bytes of a table that may be broadcast (see ``width``).
BROADCAST_BYTES = 32 << 20

_local_base: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one where that is unset, in local mode only."""
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, _local_base, ignore_errors=True)
    return f"file://{_local_base}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in the session's Arrow batches: texts are long, and each task holds a batch on both sides.

    Lazy plans are made when they run, so the setting has to outlive the call.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def hadoop_delete(spark: SparkSession, path: str):
    """A function without arguments that deletes the path, also after the session has ended; it ignores what fails."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def run() -> None:
        with contextlib.suppress(Exception):
            fs.delete(p, True)

    return run


class Scratch:
    """Tables of one operator run, written to the shared folder so that a lost executor costs only a reread.

    Tables that only the run itself reads go with ``drop``; those that its lazy result reads stay until the driver's
    process ends, and then the whole folder goes.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        if not self._n:
            atexit.register(hadoop_delete(self.spark, self.base))
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cairn_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            hadoop_delete(self.spark, t._cairn_path)()


def width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value: 16 for a plain one, the length more of texts and bytes, all elements of arrays."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType):
            return 16 + F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + width(x, kind.elementType)), F.lit(0))
        return 16 + F.greatest(F.size(c), F.lit(0)).cast("long") * (16 * len(getattr(kind.elementType, "fields", [0])))
    return F.lit(16).cast("long")


def is_small(df: DataFrame) -> bool:
    """Whether all bytes of a table are at most BROADCAST_BYTES, counted."""
    total = F.sum(reduce(Column.__add__, [width(F.col(f.name), f.dataType) for f in df.schema.fields]))
    return (df.agg(total).first()[0] or 0) <= BROADCAST_BYTES


def sized_join(big: DataFrame, small: DataFrame, on, how: str) -> DataFrame:
    """Broadcasts ``small`` only if its counted bytes are few; a shuffled join otherwise."""
    return big.join(F.broadcast(small) if is_small(small) else small, on, how)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) edges of any orderable type -> (node, root), root the smallest node that is reachable.

    Alternating large-star and small-star rounds: each keeps at most as many edges as there were, needs no
    node's neighbours in one task, and stops when a round changes nothing.  Nodes without edges don't occur.
    """
    cur = scratch.table(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        sym = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, sym["a"] == low["u"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low2, large["a"] == low2["u"])
        small = small.select(F.col("a"), F.col("m").alias("b")).unionAll(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        nxt = scratch.table(small, "edges")
        stat = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(cur)
        cur = nxt
        if stat == mark:
            break
        mark = stat
    roots = cur.select(F.col("b").alias("node")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
