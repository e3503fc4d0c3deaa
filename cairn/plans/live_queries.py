"""Registered queries of the stream of file changes and of the stateful dispatch; they write files, so tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.plans.registry import _move, _raw_events, _work_dir, _write_files, query, table
from cairn.streaming import events as ev
from cairn.streaming.dispatch import OUT, dispatch, state_store
from cairn.streaming.listing import file_changes as changes

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _to_end(frame: DataFrame, out: str, checkpoint: str) -> None:
    """One run of a query over what there is now."""
    with state_store(frame.sparkSession):
        frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query()
def dispatch_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """``debounce_sessions`` as a stream: events in three parts that overlap by 50 minutes, each a run of its own from the state of the last one."""
    base, jitter = _work_dir(spark, keep=True), 3_000_000_000
    us = F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, ts)")  # wall-clock times, whatever the session's zone
    mapped = ev.map_events(_raw_events(spark, sf)).withColumn("us", us)
    lo, hi = mapped.agg(F.min("us"), F.max("us")).first()
    lo, hi = lo or 0, hi or 0
    late = F.col("us") - lo + F.pmod(F.xxhash64("file_path", "us", "event_type"), F.lit(jitter))
    parts = mapped.select("file_path", "event_type", F.timestamp_micros("us").alias("ts"), F.floor(late * 3 / (hi - lo + jitter)).alias("part"))
    closing = spark.range(1).select(F.lit("").alias("file_path"), F.lit("modified").alias("event_type"), F.timestamp_micros(F.lit(hi + 86_400_000_000)).alias("ts"))
    for k in range(4):
        (closing if k == 3 else parts.where(F.col("part") == k).drop("part")).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("file_path string, event_type string, ts timestamp").parquet(f"{base}/in")
        _to_end(dispatch(stream, 7200, "2 hours"), f"{base}/out", f"{base}/checkpoint")
    wall = lambda c: F.expr(f"{_EPOCH} + make_dt_interval(0, 0, 0, cast(cast(unix_micros({c}) as decimal(20, 0)) / 1000000 as decimal(18, 6)))").alias(c)
    return spark.read.schema(OUT).parquet(f"{base}/out").select("file_path", "event_type", wall("ts"), wall("session_start"), "events")


@query()
def file_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a folder with a file for each 20 documents, seen by two runs of a query between which a fifth each is changed, deleted and moved."""
    base = _work_dir(spark, keep=True)
    d = table(spark, sf, "documents").select(F.coalesce(F.floor(F.col("doc_id") / 20), F.abs(F.xxhash64("text")), F.lit(-1)).alias("g"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = d.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    name, kind, whole = F.concat(F.col("g").cast("string"), F.lit(".md")), F.pmod("g", F.lit(5)), files.select("g", "text")
    _write_files(whole.select(name.alias("name"), "text"), f"{base}/docs")

    def run() -> None:
        _to_end(changes(spark, [f"{base}/docs"], f"{base}/listings"), f"{base}/out", f"{base}/checkpoint")

    run()
    _write_files(whole.where(kind == 1).select(name.alias("name"), F.concat("text", F.lit("\nchanged")).alias("text")), f"{base}/docs")
    groups = d.select("g").distinct()
    _move(groups.where(kind.isin(2, 3)).select(name.alias("name"), F.when(kind == 3, F.concat(F.lit("moved-"), name)).alias("target")), f"{base}/docs")
    run()
    found = spark.read.schema(ev.EVENTS).parquet(f"{base}/out")
    first = found.agg(F.min("ts")).first()[0]
    return found.select(F.concat(F.lit("/"), F.substring_index("src_path", "/", -1)).alias("name"), "event_type", F.when(F.col("ts") == F.lit(first), 1).otherwise(2).alias("run"))
