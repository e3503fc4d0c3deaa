"""Mergeable sketches kept by time bucket: distinct counts (HLL) and quantiles (KLL) of any span without its rows.

A row of the table has a bucket and key with exact counts, sums and extremes beside the two sketches.  Late rows are merged
into their buckets' sketches; only the folders of those buckets are written.  Bounds: a distinct count is within 5 % (three
standard errors at 2^12 registers), a quantile's rank within 2.5 % of n (99 % at k = 200).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.operators.snapshots import Snapshots

REGISTERS, K = 12, 200
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.025


class SketchTable:
    """Sketches of (ts, value, who) by a bucket's width and key columns; a new table takes those, an old one has its own."""

    def __init__(self, spark: SparkSession, path: str, seconds: int = 3600, by: Sequence[str] = ()):
        self.spark, self.snap = spark, Snapshots(spark, path)
        if not self.snap.versions():
            self.snap.commit({"version": 0, "seconds": seconds, "by": list(by), "schema": None, "buckets": {}})
        m = self.snap.read()
        self.seconds, self.by = m["seconds"], m["by"]

    def table(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The sketches of some buckets, of which only the folders are read; None if there are none."""
        m = self.snap.read()
        own = [f for b, f in m["buckets"].items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(m["schema"]).parquet(*[f"{self.snap.path}/{f}" for f in own]) if own else None

    def _sketched(self, rows: DataFrame, ts: str, value: str, who: str) -> DataFrame:
        bucket = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(self.seconds * 1_000_000)) * self.seconds).cast("long")
        v = F.col(value).cast("double")
        return rows.where(F.col(ts).isNotNull()).groupBy(bucket.alias("bucket"), *self.by).agg(
            F.count("*").alias("n"), F.count(v).alias("values"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"),
            F.hll_sketch_agg(F.col(who).cast("string"), REGISTERS).alias("distinct"), F.kll_sketch_agg_double(v, K).alias("quantiles"),
        )

    def _merged(self, parts: DataFrame, *keys: str) -> DataFrame:
        return parts.groupBy(*keys).agg(
            F.sum("n").alias("n"), F.sum("values").alias("values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
            F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles", K).alias("quantiles"),
        )

    def add(self, rows: DataFrame, ts: str = "ts", value: str = "value", who: str = "who") -> int:
        """Merges rows into their buckets and returns how many buckets that changed; rows without a time are left out."""
        m = self.snap.read()
        version = m["version"] + 1
        staged = self.snap.new("staged", version)
        self._sketched(rows, ts, value, who).write.parquet(f"{self.snap.path}/{staged}")
        new = self.spark.read.parquet(f"{self.snap.path}/{staged}")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        old = self.table(touched)
        whole = new if old is None else self._merged(new.unionByName(old), "bucket", *self.by)
        if touched:
            folder = self.snap.new("data", version)
            whole.withColumn("part", F.col("bucket")).repartition("part").write.partitionBy("part").parquet(f"{self.snap.path}/{folder}")
            schema = ", ".join(f"`{n}` {t}" for n, t in new.dtypes)
            self.snap.commit({**m, "version": version, "schema": schema, "buckets": m["buckets"] | {str(b): f"{folder}/part={b}" for b in touched}})
        self.snap.fs.delete(self.snap.at(staged), True)
        return len(touched)

    def summary(self, begin: int | None = None, end: int | None = None, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
        """Of the buckets from begin to before end: for each key n, mean, least, most, distinct and q<percent>; null quantiles where no value is."""
        own = [int(b) for b in self.snap.read()["buckets"] if (begin is None or int(b) >= begin) and (end is None or int(b) < end)]
        part = self.table(own)
        if part is None:
            raise ValueError("no bucket lies in the span")
        x = self._merged(part, *self.by)
        q = [F.when(F.col("values") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))).alias(f"q{p * 100:g}".replace(".", "_")) for p in quantiles]
        return x.select(*self.by, "n", F.try_divide("total", "values").alias("mean"), "least", "most", F.hll_sketch_estimate("distinct").alias("distinct"), *q)
