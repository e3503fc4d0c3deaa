"""Statistics of stores, shards, requests and resources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

#: Upper bounds of the request latency histogram, in seconds.
LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def store_stats(store: DataFrame, dimension: int | None = None, approximate: bool = False) -> DataFrame:
    """Documents, distinct sources (nulls don't count) and the dimension; both names of the document count."""
    files = F.approx_count_distinct("source") if approximate else F.countDistinct("source")
    return store.agg(F.count("*").alias("total_documents"), F.count("*").alias("document_count"), files.alias("total_files"), (F.lit(dimension) if dimension else F.max(F.size("vector"))).cast("int").alias("vector_dimension"))


def documents_by_type(store: DataFrame) -> DataFrame:
    return store.groupBy("source_type").agg(F.count("*").alias("documents"))


def shard_stats(store: DataFrame, shards: int) -> DataFrame:
    """A row for each shard, empty ones too."""
    have = store.groupBy("shard").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("files"))
    every = store.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(F.broadcast(have), "shard", "left").select("shard", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("files", F.lit(0)).cast("long").alias("files"))


def merged_stats(per_shard: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Sums over shards; with (n, total_s) query times also the mean in ms."""
    out = per_shard.agg(F.sum("documents").alias("total_documents"), F.sum("files").alias("total_files"), F.count("*").alias("shards"))
    if times is None:
        return out
    mean = times.agg(F.round(F.sum("total_s") * 1000 / F.greatest(F.sum("n"), F.lit(1)), 2).alias("avg_query_ms"))
    return out.crossJoin(F.broadcast(mean))


def imbalance(per_shard: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(max - min) / mean of the shards' documents; skipped if empty or not over the threshold, else pending."""
    x = per_shard.agg(F.max("documents").alias("largest"), F.min("documents").alias("smallest"), F.avg("documents").alias("mean"))
    ratio = F.when(F.col("mean") > 0, (F.col("largest") - F.col("smallest")) / F.col("mean")).otherwise(F.lit(0.0))
    return x.select("largest", "smallest", "mean", ratio.alias("imbalance"), F.when(ratio <= threshold, F.lit("skipped")).otherwise(F.lit("pending")).alias("status"))


#: Bins that the rank of a percentile is first located in.
BINS = 4096


def latency_summary(requests: DataFrame, value: str = "seconds", ok: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Requests, success %, mean, least, most, and p95: the value at index int(0.95 n) of the sorted ones if n > 20, else the most.

    The index is located in equal-width bins by their counts, then among the distinct values of its bin: neither all values nor
    all distinct ones of a key meet in a task.
    """
    success = F.avg(F.when(F.col(ok), 100.0).otherwise(0.0)) if ok else F.lit(100.0)
    keys = list(by)
    stats = requests.groupBy(*keys).agg(F.count("*").alias("requests"), F.count(value).alias("__n"), success.alias("success_pct"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    part = keys or [F.lit(0)]

    def with_stats(df: DataFrame) -> DataFrame:
        own = stats.select(*keys, "__n", "least", "most")
        if not keys:
            return df.crossJoin(F.broadcast(own))  # one row
        for k in keys:
            own = own.withColumnRenamed(k, f"__{k}")
        match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return df.join(own, match).drop(*[f"__{k}" for k in keys])

    spread = F.col("most") - F.col("least")
    place = F.when(spread > 0, F.least(F.floor((F.col("v") - F.col("least")) / spread * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    freq = with_stats(requests.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))).withColumn("bin", place.cast("int"))
    bins = freq.groupBy(*keys, "bin").agg(F.sum("n").alias("held"), F.first("__n").alias("total"))
    rank = F.floor(F.col("total") * 0.95)
    upto = F.sum("held").over(Window.partitionBy(*part).orderBy("bin"))
    chosen = bins.withColumn("upto", upto).where((F.col("upto") > rank) & (F.col("upto") - F.col("held") <= rank)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("bin").alias("__bin"), (rank - (F.col("upto") - F.col("held"))).alias("inside"))
    inner = freq.join(chosen, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("bin") == F.col("__bin")])
    seen = F.sum("n").over(Window.partitionBy(*part).orderBy("v"))
    at = inner.withColumn("seen", seen).where(F.col("seen") > F.col("inside")).groupBy(*keys).agg(F.min("v").alias("ranked"))
    if keys:
        for k in keys:
            at = at.withColumnRenamed(k, f"__{k}")
        both = stats.join(at, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])
    else:
        both = stats.join(at, F.lit(True), "left")
    return both.withColumn("p95", F.when(F.col("requests") > 20, F.col("ranked")).otherwise(F.col("most"))).drop("ranked", "__n")


def latency_histogram(requests: DataFrame, by: Sequence[str], value: str = "seconds", buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts: ``le, requests`` for each bound and +Inf."""
    counts = requests.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(value).alias("total"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("requests")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("requests")))
    return counts.select(*by, F.inline(F.array(*pairs)))


def counters(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("total"))


def summary(events: DataFrame, by: Sequence[str], value: str = "seconds") -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("count"), F.sum(value).alias("sum"))


def last_samples(samples: DataFrame, n: int, key: Sequence[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The newest n rows of each key."""
    order = [F.col(ts).desc(), *([F.col(tie).desc()] if tie else [])]
    return samples.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def resource_stats(samples: DataFrame, key: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    """Mean, most, current (newest) value and seconds between the first and last sample."""
    return samples.groupBy(*key).agg(
        F.avg(value).alias("mean"), F.max(value).alias("most"), F.max_by(value, ts).alias("current"), (F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).alias("uptime_s")
    )


def embedding_bench(runs: DataFrame) -> DataFrame:
    """runs (mode single|batch, texts, seconds) -> mean times and the speed-up (0 if nothing to divide by)."""
    mean = lambda mode: F.avg(F.when(F.col("mode") == mode, F.col("seconds")))
    per_text = F.coalesce(F.try_divide(F.sum(F.when(F.col("mode") == "batch", F.col("seconds"))), F.sum(F.when(F.col("mode") == "batch", F.col("texts")))), F.lit(0.0))
    x = runs.agg(mean("single").alias("single_s"), mean("batch").alias("batch_s"), per_text.alias("batch_per_text_s"))
    return x.withColumn("speed_up", F.coalesce(F.try_divide(F.col("single_s"), F.col("batch_per_text_s")), F.lit(0.0)))


def ingestion_totals(results: DataFrame) -> DataFrame:
    """results (status): processed (unchanged files count as processed), skipped, deleted."""
    s = F.col("status")
    return results.agg(F.count_if(s.isin("processed", "unchanged")).alias("processed"), F.count_if(s.isin("unsupported", "error")).alias("skipped"), F.count_if(s == "deleted").alias("deleted"))
