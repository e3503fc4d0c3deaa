"""Registered queries of the indexes: the vector index and the text index give what searches over all rows give."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators.ann import VectorIndex
from cairn.operators.search import batch_search
from cairn.operators.text_index import TextIndex
from cairn.plans.registry import _work_dir, embedding, hybrid_sql, keyword_sql, query, scored, store, table


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asked(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("SELECT count(*) AS queries, (count(*) * least(10, (SELECT count(*) FROM embeddings)))::BIGINT AS neighbours, TRUE AS reached FROM embeddings WHERE vec_id % 20 = 0")
def ivf_recall(spark, sf):
    """Whether the approximate top 10 of all queries hold at least 95 % of the exact ones, over all rows."""
    index = VectorIndex.build(spark, _work_dir(spark), _vectors(spark, sf))
    asked = _asked(spark, sf)
    exact = batch_search(_vectors(spark, sf), asked, 10).select("query_id", "id", F.lit(1).alias("true"))
    found = index.search(asked, 10).select("query_id", "id", F.lit(1).alias("found"))
    both = exact.join(found, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.sum(F.coalesce("found", F.lit(0))).alias("n"))
    return both.select("queries", "neighbours", (F.col("n") >= 0.95 * F.col("neighbours")).alias("reached"))


@query("""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 15 = 1 THEN list_transform(embedding, lambda x: -x) ELSE embedding END::DOUBLE[] AS v FROM embeddings WHERE vec_id % 7 <> 0)
SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, v.id, list_cosine_similarity(v.v, q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.v, q.embedding::DOUBLE[]) DESC, v.id)::INTEGER AS rank
  FROM embeddings q, v WHERE q.vec_id % 20 = 0) WHERE rank <= 5""")
def ivf_changes(spark, sf):
    """The exact mode after rows were indexed, replaced, added and removed by list."""
    rows = _vectors(spark, sf)
    index = VectorIndex.build(spark, _work_dir(spark), rows.where("id % 3 <> 0"))
    index.upsert(rows.where("id % 15 = 1").withColumn("vector", F.transform("vector", lambda x: -x)).unionAll(rows.where("id % 3 = 0")))
    index.remove(rows.where("id % 7 = 0").select("id"))
    index.vacuum()
    return index.search(_asked(spark, sf), 5, exact=True).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_SEARCHES = [
    ("contains", "That", ["that"], "contains(c, 'that')"), ("and", "that license", ["that", "license"], "contains(c, 'that') AND contains(c, 'license')"), ("starts_with", "Th", ["th"], "starts_with(c, 'th')"),
    ("ends_with", "of.", ["of."], "ends_with(c, 'of.')"),
]


@query(" UNION ALL ".join(f"SELECT '{name}' AS search, id, score FROM ({keyword_sql(words, where, 10)})" for name, _, words, where in _SEARCHES))
def text_index_keyword(spark, sf):
    """The keyword searches from postings."""
    index = TextIndex(spark, _work_dir(spark))
    index.add(table(spark, sf, "documents"), "doc_id", "text")
    out = None
    for name, keyword, _, _ in _SEARCHES:
        one = index.keyword_search(keyword, 10, name if name.endswith("with") else "contains").select(F.lit(name).alias("search"), "id", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionAll(one)
    return out


@query(hybrid_sql("that license", 0, 10, 0.7, 0.3))
def text_index_hybrid(spark, sf):
    index = TextIndex(spark, _work_dir(spark))
    rows = store(spark, sf)
    index.add(rows)
    out = index.hybrid_search(rows, "that license", embedding(spark, sf, 0), 10)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("score", "text_match", "vector_match")])


_NEW = "(SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'that new ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"


@query(" UNION ALL ".join(f"SELECT {merged} AS merged, id, score FROM ({keyword_sql(['that'], "contains(c, 'that')", 20, src=_NEW)})" for merged in ("FALSE", "TRUE")))
def text_index_changes(spark, sf):
    """Segments added, replaced and removed, searched before and after they are merged."""
    index = TextIndex(spark, _work_dir(spark))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    index.add(d.where("id % 2 = 0"))
    index.add(d.where("id % 2 = 1"))
    index.add(d.where("id % 10 = 0").withColumn("content", F.concat(F.lit("that new "), "content")))
    index.remove(d.where("id % 7 = 0").select("id"))
    before = index.keyword_search("that", 20).collect()  # 20 rows: merging deletes the segments that they are read from
    index.merge()
    kept = spark.createDataFrame([(False, r["id"], r["score"]) for r in before], "merged boolean, id long, score double")
    return scored(kept.unionAll(index.keyword_search("that", 20).select(F.lit(True).alias("merged"), "id", "score")), "merged", "id")
