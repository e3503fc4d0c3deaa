"""Registered queries of the store's deltas, deletion vectors, statistics and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cairn.functions import chunking
from cairn.operators.embed_table import EmbeddingTable
from cairn.operators.embedders import HashEmbedder
from cairn.operators.filters import apply as filtered
from cairn.operators.sketches import DISTINCT_ERROR, RANK_ERROR, SketchTable
from cairn.operators.store import ParquetStore
from cairn.plans.registry import STORE_SQL, _work_dir, query, store, table, windows_sql


def _sources(rows: DataFrame) -> DataFrame:
    """One source for all documents of a source, as ``store_changes`` has it."""
    return rows.withColumn("source", F.concat(F.regexp_replace("source", r"/[^/]*$", ""), F.lit(".md")))


_NOW = """f AS (SELECT doc_id, '/' || source || '.md' AS source, text AS content, lang AS source_type FROM documents JOIN embeddings ON doc_id = vec_id),
now AS (SELECT doc_id AS id, source, content, source_type FROM f WHERE source NOT IN ('/src1.md', '/src2.md') AND doc_id % 11 <> 0
  UNION ALL SELECT doc_id + 1000000, source, 'new ' || doc_id, source_type FROM f WHERE source = '/src2.md' AND doc_id % 3 = 0
  UNION ALL SELECT doc_id, source, 'newer', coalesce(source_type, 'unknown') FROM f WHERE source NOT IN ('/src1.md', '/src2.md') AND doc_id % 11 = 0)"""


@query(f"WITH {_NOW} SELECT compacted, now.* FROM now, (VALUES (FALSE), (TRUE)) t(compacted)")
def store_deltas(spark, sf):
    """Additions, deletions, replacements and upserts as deltas and marks, read before and after they are folded in."""
    own = ParquetStore(spark, _work_dir(spark), shards=4)
    rows = _sources(store(spark, sf))
    own.add(rows, now=0)
    own.delete_file("/src1.md")
    own.replace(rows.where("source = '/src2.md' and id % 3 = 0").withColumns({"content": F.concat(F.lit("new "), F.col("id").cast("string")), "id": F.col("id") + 1000000}), now=0)
    own.upsert(rows.where("source not in ('/src1.md', '/src2.md') and id % 11 = 0").withColumns({"content": F.lit("newer"), "source_type": F.coalesce("source_type", F.lit("unknown"))}), now=0)
    read = lambda mark: own.df().select(F.lit(mark).alias("compacted"), "id", "source", "content", "source_type")
    before = read(False)
    own.compact(keep=2)  # the state before stays, for its reader
    return before.unionAll(read(True))


@query(f"WITH {STORE_SQL}, n AS (SELECT count(*) AS n, min(created_at) AS lo, max(created_at) AS hi FROM store), r AS (SELECT lo + (hi - lo) // 10 AS a, lo + (hi - lo) // 5 AS b FROM n), one AS (SELECT max(source) AS s FROM store) SELECT 'created' AS filter, id, source, TRUE AS fewer FROM store, r WHERE created_at > a AND created_at < b UNION ALL SELECT 'source', id, source, TRUE FROM store, one WHERE source = s")
def store_skipping(spark, sf):
    """Filtered rows of a store in Z-order, and whether fewer than half of its files were opened for them."""
    own = ParquetStore(spark, _work_dir(spark), shards=1)
    own.add(store(spark, sf))
    own.compact(files=64)
    every = own.files().count()
    r = own.df().agg(F.min("created_at"), F.max("created_at"), F.max("source")).first()
    kinds = {"created": {"created_after": r[0] + (r[1] - r[0]) // 10, "created_before": r[0] + (r[1] - r[0]) // 5}, "source": {"source": r[2]}}
    parts = []
    for name, f in kinds.items():
        opened = own.files(filters=f).count()
        parts.append(filtered(own.df(filters=f), f).select(F.lit(name).alias("filter"), "id", "source", F.lit(opened * 2 < every).alias("fewer")))
    return reduce(DataFrame.unionAll, parts)


@query(f"WITH {STORE_SQL}, s AS (SELECT id, source, row_number() OVER (ORDER BY created_at, id) - 1 AS r, count(*) OVER () AS n FROM store WHERE id % 5 <> 0) SELECT (r // (n // 6 + 1))::INTEGER AS page, id, source FROM s")
def store_scroll(spark, sf):
    """All rows, after deletions, by pages of (created_at, id)."""
    own = ParquetStore(spark, _work_dir(spark), shards=2)
    rows = store(spark, sf)
    own.add(rows)
    own.compact()
    own.remove_ids(rows.where("id % 5 = 0").select("id"))
    n = own.df().count() // 6 + 1
    return reduce(DataFrame.unionAll, [p.select(F.lit(i).alias("page"), "id", "source") for i, p in enumerate(own.pages(n))])


@query(f"WITH c AS ({windows_sql('documents', 500, 0)}), n AS (SELECT count(DISTINCT content) AS embedded FROM c) SELECT doc_id, count(*) AS chunks, round(sum((('0x' || substr(md5(content || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)::FLOAT::DOUBLE), 6) AS total, any_value(embedded) AS embedded FROM c, n GROUP BY doc_id")
def embedding_by_content(spark, sf):
    """Chunks of half the documents, then of all, with their vectors; each distinct chunk is embedded once."""
    vectors = EmbeddingTable(spark, _work_dir(spark), HashEmbedder(4), "hash-4")
    d = table(spark, sf, "documents").select("doc_id", "text")
    cut = lambda df: chunking.explode_chunks(df, chunking.fixed_windows(F.col("text"), 500, 0)).drop("text")
    vectors.learn(cut(d.where("doc_id % 2 = 0")), "content")
    rows = vectors.embed(cut(d), "content")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.round(F.sum(F.get("vector", F.lit(0)).cast("double")), 6).alias("total")).withColumn("embedded", F.lit(vectors.rows).cast("long"))


@query("SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, TRUE AS distinct_within, TRUE AS p50_within, TRUE AS p95_within FROM events GROUP BY event_type")
def sketch_spans(spark, sf):
    """Distinct users and quantiles from hourly sketches, the last day's rows merged later: counts are exact, sketches within their bounds."""
    e = table(spark, sf, "events").select("event_type", F.col("value"), F.col("user_id").alias("who"), "ts")
    own = SketchTable(spark, _work_dir(spark), 86_400, ["event_type"])
    late = F.col("ts") >= F.lit(e.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 DAY")
    own.add(e.where(~late))
    own.add(e.where(late))
    got = own.summary(quantiles=(0.5, 0.95)).select("event_type", "n", "least", "most", F.col("distinct").alias("estimate"), "q50", "q95")
    exact = e.groupBy("event_type").agg(F.count_distinct("who").alias("users"))
    both = e.select("event_type", "value").join(F.broadcast(got), "event_type")  # a row for each event type
    # an estimate's rank lies between the shares of smaller values and of those up to it
    shares = [F.avg(F.when(test, 1.0).otherwise(0.0)).alias(n) for n, test in (("b50", F.col("value") < F.col("q50")), ("u50", F.col("value") <= F.col("q50")), ("b95", F.col("value") < F.col("q95")), ("u95", F.col("value") <= F.col("q95")))]
    x = both.groupBy("event_type").agg(F.any_value("n").alias("n"), F.any_value("least").alias("least"), F.any_value("most").alias("most"), F.any_value("estimate").alias("estimate"), *shares).join(exact, "event_type")
    near = lambda p: (F.col(f"b{p}") <= p / 100 + RANK_ERROR) & (F.col(f"u{p}") >= p / 100 - RANK_ERROR)
    return x.select("event_type", "n", "least", "most", (F.abs(F.col("estimate") - F.col("users")) <= DISTINCT_ERROR * F.col("users")).alias("distinct_within"), near(50).alias("p50_within"), near(95).alias("p95_within"))


@query()
def store_rebalance(spark, sf):
    """All rows that a deletion leaves in four shards, by the shards that rebalancing gives them, with what it did; no SQL, as it writes files."""
    own = ParquetStore(spark, _work_dir(spark, keep=True), shards=4)
    own.add(store(spark, sf), now=0)
    own.remove_ids(own.df().where("shard in (1, 2) and id % 4 <> 0").select("id"))
    done = own.rebalance(0.2)
    marks = [F.lit(done["status"]).alias("status"), F.lit(done["moved_rows"]).cast("long").alias("moved_rows"), F.lit(done["after"] <= 0.2).alias("balanced")]
    return own.df().select("id", "source", "shard", *marks)
