"""Files against the registry: what is new, changed, unchanged or gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, key: str, order: str, tie: str | None = None) -> DataFrame:
    """The row of each key with the largest order value (then tie)."""
    by = [F.col(order).desc_nulls_last(), *([F.col(tie).desc_nulls_last()] if tie else [])]
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("__rank = 1").drop("__rank")


def needs_update(on_disk: Column, registered: Column, hash_now: Column, hash_then: Column, mtime_now: Column, mtime_then: Column) -> Column:
    """False if missing on disk; true if not registered, its hash differs or its mtime is newer."""
    changed = ~registered | ~hash_now.eqNullSafe(hash_then) | F.coalesce(mtime_now > mtime_then, F.lit(False))
    return F.when(~on_disk, F.lit(False)).otherwise(changed)


def classify(current: DataFrame, registry: DataFrame) -> DataFrame:
    """One full outer join on the path: ``file_path, action`` (add, update, unchanged, missing)."""
    c = current.select("file_path", F.col("file_hash").alias("h1"), F.col("last_modified").alias("m1"), F.lit(True).alias("here"))
    r = registry.select("file_path", F.col("file_hash").alias("h2"), F.col("last_modified").alias("m2"), F.lit(True).alias("known"))
    both = c.join(r, "file_path", "full_outer")
    here, known = F.coalesce("here", F.lit(False)), F.coalesce("known", F.lit(False))
    stale = needs_update(here, known, F.col("h1"), F.col("h2"), F.col("m1"), F.col("m2"))
    action = F.when(~known, F.lit("add")).when(~here, F.lit("missing")).when(stale, F.lit("update")).otherwise(F.lit("unchanged"))
    return both.select("file_path", action.alias("action"))


def by_listing(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """What a listing alone tells: ``file_path, state``, which is same (registered with this time and size), missing, or candidate.

    listing: file_path, last_modified, file_size.  A registered row without a size counts by its time.
    """
    here = listing.select("file_path", F.col("last_modified").alias("m1"), F.col("file_size").alias("s1"), F.lit(True).alias("here"))
    known = registry.select("file_path", F.col("last_modified").alias("m2"), F.col("file_size").alias("s2"), F.lit(True).alias("known"))
    both = here.join(known, "file_path", "full_outer")
    same = F.col("known").isNotNull() & F.col("m1").eqNullSafe(F.col("m2")) & F.coalesce(F.col("s1") == F.col("s2"), F.lit(True))
    return both.select("file_path", F.when(F.col("here").isNull(), F.lit("missing")).when(same, F.lit("same")).otherwise(F.lit("candidate")).alias("state"))


def new_paths(current: DataFrame, registry: DataFrame) -> DataFrame:
    return current.join(registry, "file_path", "left_anti")


def missing_paths(current: DataFrame, registry: DataFrame) -> DataFrame:
    return registry.join(current, "file_path", "left_anti")


def common_paths(current: DataFrame, registry: DataFrame) -> DataFrame:
    return current.select("file_path").intersect(registry.select("file_path"))


def replace_rows(store: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """The store without any row of the new rows' sources, and the new rows, as one plan."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_rows(store: DataFrame, gone: DataFrame, key: str = "source") -> DataFrame:
    return store.join(gone.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those with the same key."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def sync_plan(store: DataFrame, actions: DataFrame, new_rows: DataFrame, delete_missing: bool = True) -> DataFrame:
    """The store after a sync: rows of updated (and missing) paths go, those of added and updated paths come."""
    drop = ["update", "add"] + ["missing"] * delete_missing
    gone = actions.where(F.col("action").isin(drop)).select(F.col("file_path").alias("source"))
    fresh = new_rows.join(actions.where(F.col("action").isin("add", "update")).select(F.col("file_path").alias("source")), "source", "left_semi")
    return delete_rows(store, gone).unionByName(fresh, allowMissingColumns=True)


def sync_stats(actions: DataFrame, old_rows: DataFrame, new_rows: DataFrame, delete_missing: bool = True) -> DataFrame:
    """One row of counters: files added, updated, deleted and unchanged, documents added and deleted."""
    old = old_rows.groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("old"))
    new = new_rows.groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("new"))
    a = actions.join(old, "file_path", "left").join(new, "file_path", "left")
    is_ = lambda *x: F.col("action").isin(*x)
    gone = is_("update", "missing") if delete_missing else is_("update")
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("long")
    return a.agg(
        F.count_if(is_("add")).alias("added_files"), F.count_if(is_("update")).alias("updated_files"), F.count_if(is_("missing") & F.lit(delete_missing)).alias("deleted_files"), F.count_if(is_("unchanged")).alias("unchanged_files"),
        total(is_("add", "update"), F.col("new")).alias("added_docs"), total(gone, F.col("old")).alias("deleted_docs"),
    )
