"""Registered queries of the engine's operators, each with DuckDB SQL for the same result where SQL can express it.

The store of these queries is ``documents`` joined with ``embeddings`` on doc_id = vec_id: source_type is the language,
created_at 1700000000 + doc_id, and a query vector is the embedding of a fixed vec_id.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import chunking, measures, paths, vectors
from cairn.operators import aggregates, search, sync, tables
from cairn.operators.embedders import HashEmbedder
from cairn.operators.filters import apply as filtered
from cairn.operators.store import ParquetStore
from cairn.streaming import events as ev
from cairn.streaming.worker import Ingestor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STORE_SQL = "store AS (SELECT doc_id AS id, text AS content, '/' || source || '/' || doc_id || '.md' AS source, lang AS source_type, 1700000000 + doc_id AS created_at, embedding AS vector FROM documents JOIN embeddings ON doc_id = vec_id)"
COS_SQL = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def store(spark: SparkSession, sf: str) -> DataFrame:
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    return d.join(e, d["doc_id"] == e["vec_id"]).select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"),
        F.col("lang").alias("source_type"), (F.col("doc_id") + 1700000000).alias("created_at"), F.col("embedding").alias("vector"),
    )


def embedding(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    return list(table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def scored(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.round("score", 6).alias("score"))


# vector search


@query("SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 5")
def vector_topk(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return scored(search.vector_search(rows, embedding(spark, sf, 0), 5), "id", "label")


@query(f"WITH {STORE_SQL} SELECT id, source_type, round(list_cosine_similarity(vector::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS score FROM store WHERE source_type IN ('de', 'fr') ORDER BY score DESC, id LIMIT 10")
def vector_topk_filtered(spark, sf):
    return scored(search.vector_search(store(spark, sf), embedding(spark, sf, 1), 10, {"metadata.source_type": ["de", "fr"]}), "id", "source_type")


# zero, short, opposite and null vectors, such with a component that is no number, and plain ones
_ODD = "CASE vec_id % 6 WHEN 0 THEN transform(embedding, x -> CAST(0 AS FLOAT)) WHEN 1 THEN slice(embedding, 1, 10) WHEN 2 THEN transform(embedding, x -> -x) WHEN 3 THEN NULL WHEN 4 THEN concat(slice(embedding, 2, 1000), array(CAST('NaN' AS FLOAT))) ELSE embedding END"
_ODD_SQL = "SELECT vec_id AS id, CASE vec_id % 6 WHEN 2 THEN -s WHEN 5 THEN s ELSE 0.0::DOUBLE END AS score FROM (SELECT vec_id, {s} AS s FROM embeddings)"


@query(_ODD_SQL.format(s="round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"))
def cosine_edges(spark, sf):
    """Edge cases of every vector against one query."""
    score = vectors.cosine_to(F.col("v"), embedding(spark, sf, 0))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.expr(_ODD).alias("v")).select("id", (F.round(score, 6) + 0.0).alias("score"))


@query(_ODD_SQL.format(s="1.0::DOUBLE"))
def cosine_columns(spark, sf):
    """The same of every vector against itself, by the column-to-column form."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.expr(_ODD).alias("v"), F.col("embedding").alias("q"))
    return rows.select("id", (F.round(vectors.cosine(F.col("v"), F.col("q")), 6) + 0.0).alias("score"))


@query(
    """
SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INTEGER AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 5"""
)
def batch_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    qs = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.batch_search(rows, qs, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_WORD = "('0x' || substr(md5({p}), {i}, 8))::BIGINT"
_FOLD = "0"
for _i in (1, 9, 17, 25):
    _FOLD = f"((({_FOLD}) * (4294967296 % {{n}}) + {_WORD.format(p='{p}', i=_i)}) % {{n}})"


def shard_sql(path: str, n: int) -> str:
    return f"({_FOLD.format(p=path, n=n)})::INTEGER"


@query(f"WITH {STORE_SQL} SELECT id, {shard_sql('source', 4)} AS shard, round(list_cosine_similarity(vector::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 2)), 6) AS score FROM store ORDER BY score DESC, id LIMIT 5")
def sharded_topk(spark, sf):
    rows = store(spark, sf).withColumn("shard", paths.shard_of(F.col("source"), 4))
    return scored(search.sharded_search(rows, embedding(spark, sf, 2), 5), "id", "shard")


@query(f"SELECT doc_id, {shard_sql("('/' || source || '/' || doc_id || '.md')", 7)} AS shard FROM documents")
def shard_assign(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", paths.shard_of(F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")), 7).alias("shard"))


def _by_source(spark, sf, n: int = 4):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), "source", paths.shard_of(F.col("source"), n).alias("shard"))


_SHARDS_SQL = f"s AS (SELECT source, {shard_sql('source', 4)} AS shard FROM documents), st AS (SELECT i::INTEGER AS shard, count(source)::BIGINT AS documents, count(DISTINCT source)::BIGINT AS files FROM range(4) r(i) LEFT JOIN s ON s.shard = i GROUP BY i)"


@query(f"WITH {_SHARDS_SQL} SELECT * FROM st")
def shard_stats(spark, sf):
    return aggregates.shard_stats(_by_source(spark, sf), 4)


@query(f"WITH {_SHARDS_SQL} SELECT sum(documents)::BIGINT AS total_documents, sum(files)::BIGINT AS total_files, count(*) AS shards FROM st")
def shard_stats_merged(spark, sf):
    return aggregates.merged_stats(aggregates.shard_stats(_by_source(spark, sf), 4))


@query(f"WITH {_SHARDS_SQL}, x AS (SELECT max(documents) AS largest, min(documents) AS smallest, avg(documents) AS mean FROM st) SELECT *, round((largest - smallest) / mean, 9) AS imbalance, CASE WHEN (largest - smallest) / mean <= 0.3 THEN 'skipped' ELSE 'pending' END AS status FROM x")
def shard_imbalance(spark, sf):
    return aggregates.imbalance(aggregates.shard_stats(_by_source(spark, sf), 4)).withColumn("imbalance", F.round("imbalance", 9))


# keyword and hybrid search


def keyword_sql(words: list[str], where: str, k: int, src: str = "documents", text: str = "text", id_: str = "doc_id") -> str:
    parts = [f"(least(0.2::DOUBLE * ((length(c) - length(replace(c, '{w}', ''))) / {len(w)}), 0.5::DOUBLE) + 0.5::DOUBLE * (1 - least((strpos(c, '{w}') - 1) / greatest(length({text}), 1), 0.8::DOUBLE)))" for w in words]
    return f"SELECT {id_} AS id, round(least(({' + '.join(parts)}) / {len(words)}, 1.0::DOUBLE), 6) AS score FROM (SELECT *, lower({text}) AS c FROM {src}) WHERE {where} ORDER BY score DESC, id LIMIT {k}"


def _keyword(spark, sf, keyword, match_type="contains", k=10, **more):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("source_type"))
    return scored(search.keyword_search(rows, keyword, k, match_type=match_type, keep=["id"], **more), "id")


@query(keyword_sql(["that"], "contains(c, 'that')", 10))
def keyword_contains(spark, sf):
    return _keyword(spark, sf, "That")


@query(keyword_sql(["that", "license"], "contains(c, 'that') AND contains(c, 'license')", 5))
def keyword_multi_and(spark, sf):
    return _keyword(spark, sf, "that license", k=5)


@query(keyword_sql(["th"], "starts_with(c, 'th')", 10))
def keyword_starts_with(spark, sf):
    return _keyword(spark, sf, "Th", "starts_with")


@query(keyword_sql(["of."], "ends_with(c, 'of.')", 10))
def keyword_ends_with(spark, sf):
    return _keyword(spark, sf, "of.", "ends_with")


@query("WITH k AS (SELECT lower(text) AS w FROM documents WHERE doc_id = 12) SELECT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE lower(text) = (SELECT w FROM k) ORDER BY id LIMIT 10")
def keyword_exact(spark, sf):
    """The whole text of a document as the keyword, with constant scores."""
    text = table(spark, sf, "documents").where("doc_id = 12").first()["text"]
    return _keyword(spark, sf, text, "exact", scoring="constant")


@query("SELECT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'license') ORDER BY id LIMIT 10")
def keyword_constant(spark, sf):
    return _keyword(spark, sf, "license", scoring="constant")


@query(keyword_sql(["that"], "TRUE", 5, src="(SELECT * FROM documents WHERE contains(lower(text), 'that') ORDER BY doc_id LIMIT 10)"))
def keyword_candidate_limit(spark, sf):
    return _keyword(spark, sf, "that", k=5, candidate_limit=10)


def hybrid_sql(text: str, vec: int, k: int, vw: float, tw: float, where: str = "TRUE") -> str:
    words = text.split()
    one = lambda w: f"CASE WHEN contains(c, '{w}') THEN least(0.3::DOUBLE * ((length(c) - length(replace(c, '{w}', ''))) / {len(w)}), 0.8::DOUBLE) + 0.2::DOUBLE * (1 - least((strpos(c, '{w}') - 1) / greatest(length(c), 1), 0.7::DOUBLE)) ELSE 0 END"
    total = " + ".join(one(w) for w in words if len(w) >= 3) or "0"
    return f"""WITH {STORE_SQL}, s AS (
  SELECT id, CASE WHEN contains(c, '{text}') THEN 0.9::DOUBLE ELSE ({total}) / {len(words)} END AS text_match,
    least(greatest(list_cosine_similarity(vector::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec})), 0), 1) AS vector_match
  FROM (SELECT *, lower(content) AS c FROM store) WHERE {where})
SELECT id, round(vector_match * {vw}::DOUBLE + text_match * {tw}::DOUBLE, 6) AS score, round(text_match, 6) AS text_match, round(vector_match, 6) AS vector_match FROM s ORDER BY score DESC, id LIMIT {k}"""


def _hybrid(spark, sf, text, vec, k, **more):
    out = search.hybrid_search(store(spark, sf), text, embedding(spark, sf, vec), k, keep=["id"], **more)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("score", "text_match", "vector_match")])


@query(hybrid_sql("that license", 0, 10, 0.7, 0.3))
def hybrid_search(spark, sf):
    return _hybrid(spark, sf, "that license", 0, 10)


@query(hybrid_sql("of the license", 3, 8, 0.2, 1.0, "source_type = 'en'"))
def hybrid_weights(spark, sf):
    return _hybrid(spark, sf, "Of the license", 3, 8, vector_weight=0.2, text_weight=1.0, filters={"source_type": "en"})


# filters


@query(f"WITH {STORE_SQL} SELECT id, source FROM store WHERE source_type IN ('es', 'de')")
def filter_in_list(spark, sf):
    return filtered(store(spark, sf), {"source_type": ["es", "de"]}).select("id", "source")


@query(f"WITH {STORE_SQL} SELECT id, created_at FROM store WHERE created_at > 1700000010 AND created_at < 1700000100")
def filter_created_range(spark, sf):
    return filtered(store(spark, sf), {"created_after": 1700000010, "created_before": 1700000100, "unknown": 1}).select("id", "created_at")


@query("SELECT event_id AS id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_extract(props, '$.k')::DOUBLE IN (3, 7)")
def filter_metadata_json(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.try_parse_json("props").alias("metadata"))
    return filtered(rows, {"metadata": {"k": [3, 7, "5"]}}).select("id")


@query("SELECT doc_id AS id, source FROM documents WHERE contains(source, '1') AND source LIKE 'src1_'")
def filter_source_patterns(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return filtered(rows, {"source_contains": "1", "path": "src1_"})


@query(f"WITH {STORE_SQL} SELECT id, source FROM store WHERE source = (SELECT min(source) FROM store)")
def filter_source(spark, sf):
    rows = store(spark, sf)
    return filtered(rows, {"source": rows.agg(F.min("source")).first()[0]}).select("id", "source")


@query(f"WITH {STORE_SQL} SELECT id, source FROM store WHERE source IN ((SELECT min(source) FROM store), (SELECT max(source) FROM store))")
def filter_source_list(spark, sf):
    rows = store(spark, sf)
    return filtered(rows, {"metadata.source": list(rows.agg(F.min("source"), F.max("source")).first())}).select("id", "source")


@query("SELECT event_id AS id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_extract(props, '$.k')::DOUBLE = 5")
def filter_metadata_scalar(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.try_parse_json("props").alias("metadata"))
    return filtered(rows, {"metadata.k": 5}).select("id")


# chunking

_N = "CASE WHEN length({t}) <= {s} THEN 1 ELSE ceil((length({t}) - {s}) / {p}::DOUBLE)::BIGINT + 1 END"


def windows_sql(src: str, size: int, overlap: int, cols: str = "doc_id", text: str = "text") -> str:
    step = size - overlap
    n = _N.format(t=text, s=size, p=step)
    return f"SELECT {cols}, i::INTEGER AS chunk_index, n::INTEGER AS chunk_total, substring({text}, i * {step} + 1, {size}) AS content FROM (SELECT *, {n} AS n, unnest(range({n})) AS i FROM {src} WHERE length({text}) > 0)"


@query(windows_sql("documents", 200, 50))
def chunk_fixed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.explode_chunks(d, chunking.fixed_windows(F.col("text"), 200, 50)).drop("text")


@query(windows_sql("documents", 300, 0))
def chunk_fixed_no_overlap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.explode_chunks(d, chunking.fixed_windows(F.col("text"), 300, 0)).drop("text")


_MD = "'# Doc ' || doc_id || chr(10) || substr(text, 1, 300) || chr(10) || '## Part' || chr(10) || text"
_CODE = "'def f' || doc_id || '():' || chr(10) || text"


def _markdown(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(f"concat('/m/', doc_id, '.md')").alias("source"), F.expr(_MD.replace("chr(10)", "'\\n'")).alias("text"))


def _code(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr("concat('/c/', doc_id, '.py')").alias("source"), F.expr(_CODE.replace("chr(10)", "'\\n'")).alias("text"))


def sections_sql(text: str, mark: str, size: int, overlap: int) -> str:
    """Pieces at the marks, longer ones cut to windows, numbered in order."""
    n = _N.format(t="piece", s=size, p=size - overlap)
    return f"""WITH d AS (SELECT doc_id, {text} AS t FROM documents),
p AS (SELECT doc_id, k, piece FROM (SELECT doc_id, unnest(string_split(regexp_replace(t, '{mark}', chr(1) || '\\1', 'g'), chr(1))) AS piece, generate_subscripts(string_split(regexp_replace(t, '{mark}', chr(1) || '\\1', 'g'), chr(1)), 1) AS k FROM d) WHERE piece <> ''),
c AS (SELECT doc_id, k, i, substring(piece, i * {size - overlap} + 1, {size}) AS content FROM (SELECT *, unnest(range({n})) AS i FROM p)),
o AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1)::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS chunk_total, content FROM c)"""


_MD_SQL = sections_sql(_MD, r"(?m)^(#{1,3} .+)$", 400, 50)
_CODE_SQL = sections_sql(_CODE, r"(?m)^(class \w+[\(\w\)]*:|def \w+\([^\)]*\):)", 500, 50)


@query(_MD_SQL + " SELECT doc_id, chunk_index, chunk_total, content FROM o")
def chunk_markdown(spark, sf):
    return chunking.chunk_markdown_files(_markdown(spark, sf)).select("doc_id", "chunk_index", "chunk_total", "content")


@query("SELECT doc_id, 'Doc ' || doc_id AS title FROM documents")
def markdown_title(spark, sf):
    return _markdown(spark, sf).select("doc_id", chunking.markdown_title(F.col("text")).alias("title"))


@query(_MD_SQL + " SELECT doc_id, chunk_index, nullif(length(regexp_extract(content, '(?m)^(#+) (.+)$', 1)), 0)::INTEGER AS heading_level, nullif(trim(regexp_extract(content, '(?m)^(#+) (.+)$', 2)), '') AS section_title FROM o")
def markdown_sections(spark, sf):
    return chunking.chunk_markdown_files(_markdown(spark, sf)).select("doc_id", "chunk_index", "heading_level", "section_title")


@query(_CODE_SQL + " SELECT doc_id, chunk_index, chunk_total, content FROM o")
def chunk_code(spark, sf):
    return chunking.chunk_code_files(_code(spark, sf)).select("doc_id", "chunk_index", "chunk_total", "content")


@query(_CODE_SQL + r" SELECT doc_id, chunk_index, doc_id::VARCHAR AS module_name, CASE WHEN regexp_matches(content, '(?m)^def \w+\([^\)]*\):') THEN 'function' END AS symbol_type, nullif(regexp_extract(content, '(?m)^def (\w+)\([^\)]*\):', 1), '') AS symbol_name FROM o")
def code_symbols(spark, sf):
    return chunking.chunk_code_files(_code(spark, sf)).select("doc_id", "chunk_index", "module_name", "symbol_type", "symbol_name")


_JS = "'class C' || doc_id || ' {' || chr(10) || '}' || chr(10) || 'async function go' || doc_id || '(a, b) {' || chr(10) || text || chr(10) || '}' || chr(10) || 'run = () => {' || chr(10) || '}'"
_JS_SQL = sections_sql(_JS, r"(?m)(^class \w+ \{|^(?:async )?function \w+\([^\)]*\) \{|\b\w+ = (?:\(\) =>|function\([^\)]*\)) \{)", 500, 50)


def _javascript(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr("concat('/j/', doc_id, '.ts')").alias("source"), F.expr(_JS.replace("chr(10)", "'\\n'")).alias("text"))


@query(_JS_SQL + " SELECT doc_id, chunk_index, chunk_total, content FROM o")
def chunk_javascript(spark, sf):
    return chunking.chunk_code_files(_javascript(spark, sf)).select("doc_id", "chunk_index", "chunk_total", "content")


@query(_JS_SQL + r""" SELECT doc_id, chunk_index, CASE WHEN content LIKE 'class C%' THEN 'class' WHEN content LIKE 'async function go%' OR content LIKE 'run = %' THEN 'function' END AS symbol_type,
  CASE WHEN content LIKE 'class C%' THEN 'C' || doc_id WHEN content LIKE 'async function go%' THEN 'go' || doc_id WHEN content LIKE 'run = %' THEN 'run' END AS symbol_name FROM o""")
def javascript_symbols(spark, sf):
    return chunking.chunk_code_files(_javascript(spark, sf)).select("doc_id", "chunk_index", "symbol_type", "symbol_name")


_NAMES = [("a.TSX", ".TSX", "javascript", "code", "a"), ("b.rs", ".rs", "rust", "code", "b"), ("c.txt", ".txt", None, None, "c"), ("y.py", ".py", "python", "code", "y"), (".bashrc", "", None, None, ".bashrc"), ("f", "", None, None, "f"), ("m.MD", ".MD", None, "markdown", "m"), ("n.markdown", ".markdown", None, "markdown", "n"), ("k.kt", ".kt", "kotlin", "code", "k"), ("q.cpp", ".cpp", "cpp", "code", "q")]


def cases_sql(values: list, by: str) -> str:
    """One of the values by a number."""
    return "[" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" for v in values) + f"][{by} % {len(values)} + 1]"


@query(f"SELECT doc_id, '/d.e/' || source || '/' || {cases_sql([n[0] for n in _NAMES], 'doc_id')} AS path, " + ", ".join(f"{cases_sql([n[i] for n in _NAMES], 'doc_id')} AS {c}" for i, c in ((1, "extension"), (2, "language"), (3, "kind"), (4, "stem"))) + " FROM documents")
def detect_language(spark, sf):
    p, names = F.col("path"), F.array(*[F.lit(n[0]) for n in _NAMES])
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/d.e/"), "source", F.lit("/"), F.get(names, (F.col("doc_id") % len(_NAMES)).cast("int"))).alias("path"))
    return rows.select("doc_id", "path", paths.extension(p).alias("extension"), paths.code_language(p).alias("language"), paths.file_kind(p).alias("kind"), paths.stem(p).alias("stem"))


# statistics


@query(f"WITH {STORE_SQL} SELECT count(*) AS total_documents, count(*) AS document_count, count(DISTINCT source) AS total_files, max(len(vector))::INTEGER AS vector_dimension FROM store")
def store_stats(spark, sf):
    return aggregates.store_stats(store(spark, sf))


@query("SELECT lang AS source_type, count(*) AS documents FROM documents GROUP BY lang")
def docs_by_type(spark, sf):
    return aggregates.documents_by_type(table(spark, sf, "documents").withColumnRenamed("lang", "source_type"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_sources(spark, sf):
    return table(spark, sf, "documents").select("source").where("source is not null").distinct()


# incremental sync: two snapshots derived from documents


def _snapshots(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("n"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), "text")
    now = d.where("n % 7 <> 0").select("file_path", F.md5("text").alias("file_hash"), F.when(F.col("n") % 11 == 0, 200.0).otherwise(100.0).alias("last_modified"))
    then = d.where("n % 5 <> 0").select("file_path", F.when(F.col("n") % 13 == 0, F.lit("old")).otherwise(F.md5("text")).alias("file_hash"), F.lit(100.0).alias("last_modified"))
    return now, then


_SYNC = """now AS (SELECT '/d/' || doc_id || '.md' AS file_path, md5(text) AS h, CASE WHEN doc_id % 11 = 0 THEN 200.0 ELSE 100.0 END AS m FROM documents WHERE doc_id % 7 <> 0),
reg AS (SELECT '/d/' || doc_id || '.md' AS file_path, CASE WHEN doc_id % 13 = 0 THEN 'old' ELSE md5(text) END AS h, 100.0 AS m FROM documents WHERE doc_id % 5 <> 0),
act AS (SELECT coalesce(now.file_path, reg.file_path) AS file_path, CASE WHEN reg.file_path IS NULL THEN 'add' WHEN now.file_path IS NULL THEN 'missing' WHEN now.h <> reg.h OR now.m > reg.m THEN 'update' ELSE 'unchanged' END AS action
  FROM now FULL JOIN reg ON now.file_path = reg.file_path)"""


@query(f"WITH {_SYNC} SELECT * FROM act")
def sync_classify(spark, sf):
    return sync.classify(*_snapshots(spark, sf))


@query(f"WITH {_SYNC} SELECT count(*) FILTER (action = 'add') AS added_files, count(*) FILTER (action = 'update') AS updated_files, count(*) FILTER (action = 'missing') AS deleted_files, count(*) FILTER (action = 'unchanged') AS unchanged_files, count(*) FILTER (action IN ('add', 'update')) AS added_docs, count(*) FILTER (action IN ('update', 'missing')) AS deleted_docs FROM act")
def sync_stats(spark, sf):
    now, then = _snapshots(spark, sf)
    rows = lambda x: x.select(F.col("file_path").alias("source"))
    return sync.sync_stats(sync.classify(now, then), rows(then), rows(now))


@query(f"WITH {_SYNC} SELECT coalesce(now.file_path, reg.file_path) AS file_path, CASE WHEN now.file_path IS NULL THEN FALSE WHEN reg.file_path IS NULL THEN TRUE ELSE now.h <> reg.h OR now.m > reg.m END AS needs_update FROM now FULL JOIN reg ON now.file_path = reg.file_path")
def needs_update(spark, sf):
    now, then = _snapshots(spark, sf)
    a, b = now.withColumn("here", F.lit(True)), then.select("file_path", F.col("file_hash").alias("h2"), F.col("last_modified").alias("m2"), F.lit(True).alias("known"))
    x = a.join(b, "file_path", "full_outer")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return x.select("file_path", sync.needs_update(flag(F.col("here")), flag(F.col("known")), F.col("file_hash"), F.col("h2"), F.col("last_modified"), F.col("m2")).alias("needs_update"))


@query(f"WITH {_SYNC} SELECT file_path FROM now WHERE file_path IN (SELECT file_path FROM reg)")
def file_exists(spark, sf):
    return sync.common_paths(*_snapshots(spark, sf))


@query(f"WITH {_SYNC} SELECT file_path FROM now WHERE file_path NOT IN (SELECT file_path FROM reg)")
def new_files(spark, sf):
    return sync.new_paths(*_snapshots(spark, sf)).select("file_path")


@query(f"WITH {_SYNC} SELECT file_path FROM reg WHERE file_path NOT IN (SELECT file_path FROM now)")
def missing_files(spark, sf):
    return sync.missing_paths(*_snapshots(spark, sf)).select("file_path")


# mutations, as plans over the store


@query("SELECT doc_id AS id, source, text AS content FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id + 1000000 AS id, source, 'new ' || doc_id AS content FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 10 = 1")
def replace_file(spark, sf):
    d = table(spark, sf, "documents")
    old = d.select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"))
    new = d.where("source in ('src1', 'src2') and doc_id % 10 = 1").select((F.col("doc_id") + 1000000).alias("id"), "source", F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("content"))
    hit = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return sync.delete_rows(old, hit).unionByName(new)


@query("SELECT doc_id AS id, source FROM documents WHERE source IS DISTINCT FROM 'src3'")
def delete_file(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return sync.delete_rows(rows, spark.createDataFrame([("src3",)], "source string"))


@query("SELECT vec_id AS id, i::INTEGER AS i, embedding[i + 1]::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN -2 ELSE 1 END AS x FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)")
def update_vector(spark, sf):
    """New vectors for a third of the ids, by an upsert."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    new = e.where("id % 3 = 0").select("id", F.transform("vector", lambda x: x * -2.0).alias("vector"))
    return sync.upsert(e, new, "id").select("id", F.posexplode("vector").alias("i", "x"))


@query("SELECT 'f' || (doc_id % 50) AS file_path, max(doc_id)::DOUBLE AS last_vectorized, arg_max(md5(text), doc_id) AS file_hash FROM documents GROUP BY doc_id % 50")
def upsert_registry(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("file_path"), F.col("doc_id").cast("double").alias("last_vectorized"), F.md5("text").alias("file_hash"))
    return sync.latest(d, "file_path", "last_vectorized")


@query(f"WITH {_SYNC}, old AS (SELECT file_path, h FROM reg), n AS (SELECT file_path, h FROM now) SELECT file_path AS source, h AS content FROM old WHERE file_path IN (SELECT file_path FROM act WHERE action = 'unchanged') UNION ALL SELECT file_path, h FROM n WHERE file_path IN (SELECT file_path FROM act WHERE action IN ('add', 'update'))")
def sync_apply(spark, sf):
    now, then = _snapshots(spark, sf)
    rows = lambda x: x.select(F.col("file_path").alias("source"), F.col("file_hash").alias("content"))
    return sync.sync_plan(rows(then), sync.classify(now, then), rows(now)).select("source", "content")


@query(f"WITH {STORE_SQL} SELECT id, source, coalesce(source_type, 'unknown') AS source_type, 77::BIGINT AS created_at, {shard_sql('source', 5)} AS shard, round(sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS vector_norm FROM store")
def store_prepare(spark, sf):
    """What the store adds to rows before it writes them."""
    rows = ParquetStore(spark, _work_dir(spark), shards=5).prepare(store(spark, sf), now=77)
    return rows.select("id", "source", "source_type", "created_at", "shard", F.round("vector_norm", 6).alias("vector_norm"))


# the store on Parquet: written, changed and read back


def _work_dir(spark, keep: bool = False) -> str:
    """A new folder that all executors share, deleted when the process ends unless it is to be kept; in local mode a temporary one where ``spark.checkpoint.dir`` is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/cairn-store-{uuid.uuid4().hex}"
    if keep:
        return path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def clear() -> None:
        with contextlib.suppress(Exception):
            system.delete(where, True)

    atexit.register(clear)
    return path


_FILES_SQL = "f AS (SELECT doc_id, '/' || source || '.md' AS source, text AS content, lang AS source_type FROM documents JOIN embeddings ON doc_id = vec_id)"


@query(f"""WITH {_FILES_SQL} SELECT doc_id AS id, source, content, source_type FROM f WHERE source NOT IN ('/src1.md', '/src2.md', '/src3.md') UNION ALL
SELECT doc_id + 1000000, source, 'new ' || doc_id, source_type FROM f WHERE source IN ('/src2.md', '/src9.md') AND doc_id % 3 = 0""".replace("'/src1.md', '/src2.md', '/src3.md'", "'/src1.md', '/src2.md', '/src3.md', '/src9.md'"))
def store_changes(spark, sf):
    """Add, delete, delete of nothing, replace and compact through the store; then all of its rows."""
    own = ParquetStore(spark, _work_dir(spark), shards=4)
    rows = store(spark, sf).withColumn("source", F.concat(F.regexp_replace("source", r"/[^/]*$", ""), F.lit(".md")))
    own.add(rows, now=0)
    own.delete(spark.createDataFrame([("/src1.md",), ("/src3.md",), ("/nowhere.md",)], "source string"))
    own.delete_file("/nowhere.md")
    new = rows.where("source in ('/src2.md', '/src9.md') and id % 3 = 0").withColumns({"content": F.concat(F.lit("new "), F.col("id").cast("string")), "id": F.col("id") + 1000000})
    own.replace(new, now=0, gone=spark.createDataFrame([("/src2.md",), ("/src9.md",)], "source string"))
    own.compact()
    return own.df().select("id", "source", "content", "source_type")


@query(f"WITH {_FILES_SQL} SELECT source, count(*) AS rows, sum(length(content))::BIGINT AS chars FROM f GROUP BY source")
def store_add(spark, sf):
    own = ParquetStore(spark, _work_dir(spark), shards=4)
    rows = store(spark, sf).withColumn("source", F.concat(F.regexp_replace("source", r"/[^/]*$", ""), F.lit(".md")))
    own.add(rows.where("id % 2 = 0"), now=0)
    own.add(rows.where("id % 2 = 1"), now=0)
    return own.df().groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.char_length("content")).alias("chars"))


# events


def _raw_events(spark, sf):
    kinds = F.create_map(*[F.lit(x) for pair in (("signup", "created"), ("view", "modified"), ("click", "modified"), ("error", "deleted"), ("purchase", "moved")) for x in pair])
    u = F.col("user_id").cast("string")
    return table(spark, sf, "events").select(
        F.concat(F.when(F.col("user_id") % 9 == 0, F.lit("/a/.git/")).otherwise(F.lit("/a/")), F.lit("u"), u, F.when(F.col("user_id") % 10 == 3, F.lit(".tmp")).otherwise(F.lit(".md"))).alias("src_path"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("/b/u"), u, F.lit(".md"))).alias("dest_path"), kinds[F.col("event_type")].alias("event_type"), F.lit(False).alias("is_directory"), "ts",
    )


_EVENTS = """raw AS (SELECT (CASE WHEN user_id % 9 = 0 THEN '/a/.git/' ELSE '/a/' END) || 'u' || user_id || (CASE WHEN user_id % 10 = 3 THEN '.tmp' ELSE '.md' END) AS src, CASE WHEN event_type = 'purchase' THEN '/b/u' || user_id || '.md' END AS dest, event_type AS e, user_id, ts FROM events),
ok AS (SELECT *, user_id % 9 <> 0 AND user_id % 10 <> 3 AS src_ok FROM raw),
m AS (SELECT src AS file_path, 'modified' AS event_type, ts FROM ok WHERE src_ok AND e IN ('signup', 'view', 'click') UNION ALL SELECT src, 'deleted', ts FROM ok WHERE src_ok AND e IN ('error', 'purchase') UNION ALL SELECT dest, 'modified', ts FROM ok WHERE e = 'purchase')"""


@query(f"WITH {_EVENTS} SELECT file_path, event_type, ts FROM m")
def event_map(spark, sf):
    return ev.map_events(_raw_events(spark, sf))


_IGN = {"/a/.git/x.md": True, "/a/.h.md": True, "/a/b.txt": True, "/a/b.MD": False, "/a/venv/x.py": True, "/a/x.py": False, "/a/tmp/x.py": True, "/a/env": True}


@query(f"SELECT event_id, '/u' || user_id || {cases_sql(list(_IGN), 'event_id')} AS path, {cases_sql(list(_IGN.values()), 'event_id')} AS ignored FROM events")
def event_ignore(spark, sf):
    path = F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.get(F.array(*[F.lit(p) for p in _IGN]), (F.col("event_id") % len(_IGN)).cast("int")))
    return table(spark, sf, "events").select("event_id", path.alias("path")).withColumn("ignored", paths.event_ignored(F.col("path"), ["/tmp/"]))


@query(
    f"""WITH {_EVENTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY file_path ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT file_path, max((ts, event_type))[2] AS event_type, max(ts) AS ts, min(ts) AS session_start, count(*) AS events FROM s GROUP BY file_path, session"""
)
def debounce_sessions(spark, sf):
    return ev.debounce(ev.map_events(_raw_events(spark, sf)), "2 hours")


@query(f"WITH {_EVENTS} SELECT file_path, max((ts, event_type))[2] AS event_type, max(ts) AS ts FROM m GROUP BY file_path")
def latest_events(spark, sf):
    return ev.latest_events(ev.map_events(_raw_events(spark, sf)))


# files on disk, through the worker's scan into the store


def _write_files(rows: DataFrame, directory: str) -> None:
    """rows (name, text): one file each, written by the executors."""

    def run(parts):
        system, base = fs.FileSystem.from_uri(directory if "://" in directory else f"file://{directory}")
        system.create_dir(base, recursive=True)
        for part in parts:
            for name, text in zip(part["name"].to_pylist(), part["text"].to_pylist(), strict=True):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([part["name"]], names=["name"])

    rows.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def _move(names: DataFrame, directory: str) -> None:
    """rows (name, target): renames files, or deletes those without a target; by the executors, and again without harm."""

    def run(parts):
        system, base = fs.FileSystem.from_uri(directory if "://" in directory else f"file://{directory}")
        for part in parts:
            for name, target in zip(part["name"].to_pylist(), part["target"].to_pylist(), strict=True):
                if system.get_file_info(f"{base}/{name}").type != fs.FileType.File:
                    continue
                system.move(f"{base}/{name}", f"{base}/{target}") if target else system.delete_file(f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([part["name"]], names=["name"])

    names.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def _file_rows(spark, sf, markdown: str, code: str):
    kind = lambda r: F.when(F.col("doc_id") % 3 == r[0], F.lit(r[1]))
    name = F.concat(F.coalesce(kind((1, ".hidden")), F.lit("d")), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 6 == 0, F.lit(".md")).when(F.col("doc_id") % 6 == 3, F.lit(".txt")).when(F.col("doc_id") % 3 == 2, F.lit(".py")).otherwise(F.lit(".md")))
    text = F.when(F.col("doc_id") % 3 == 2, F.expr(code.replace("chr(10)", "'\\n'"))).otherwise(F.expr(markdown.replace("chr(10)", "'\\n'")))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", name.alias("name"), text.alias("text"))


_INGEST = """SELECT file_name, source_type, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM (
  SELECT 'd' || doc_id || '.md' AS file_name, 'markdown' AS source_type, content FROM m WHERE doc_id % 6 = 0 UNION ALL SELECT 'd' || doc_id || '.py', 'code', content FROM c WHERE doc_id % 3 = 2) WHERE NOT regexp_full_match(content, '\\s*')"""


def _scan_sql(md: str, code: str) -> str:
    return f"WITH m AS ({md} SELECT doc_id, content FROM o), c AS ({code} SELECT doc_id, content FROM o) " + _INGEST


@query(_scan_sql(_MD_SQL, _CODE_SQL) + " GROUP BY ALL")
def scan_files(spark, sf):
    """Files of all kinds, hidden and unsupported ones among them, scanned into the store."""
    own, files = ParquetStore(spark, _work_dir(spark)), _work_dir(spark) + "/files"
    _write_files(_file_rows(spark, sf, _MD, _CODE).select("name", "text"), files)
    Ingestor(spark, own, HashEmbedder(8)).run_once([files])
    return own.df().groupBy("file_name", "source_type").agg(F.count("*").alias("chunks"), F.sum(F.char_length("content")).alias("chars"))


_MD2 = _MD.replace("'# Doc '", "'# New '")


@query(_scan_sql(sections_sql(f"CASE WHEN doc_id % 5 = 0 THEN {_MD2} ELSE {_MD} END", r"(?m)^(#{1,3} .+)$", 400, 50), _CODE_SQL) + " AND file_name NOT LIKE '%7.py' GROUP BY ALL")
def rescan_files(spark, sf):
    """The same, after a second scan that finds changed files and doesn't find others."""
    own, base = ParquetStore(spark, _work_dir(spark)), _work_dir(spark)
    worker, rows = Ingestor(spark, own, HashEmbedder(8), base_dir=f"{base}/files"), _file_rows(spark, sf, _MD, _CODE)
    _write_files(rows.select("name", "text"), f"{base}/files")
    worker.run_once([f"{base}/files"])
    _write_files(_file_rows(spark, sf, _MD2, _CODE).where("doc_id % 5 = 0 and doc_id % 6 = 0").select("name", "text"), f"{base}/files")
    gone = rows.where("name like 'd%7.py'").select("name").distinct()
    _move(gone.withColumn("target", F.lit(None).cast("string")), f"{base}/files")
    worker.run_once([f"{base}/files"])
    return own.df().groupBy("file_name", "source_type").agg(F.count("*").alias("chunks"), F.sum(F.char_length("content")).alias("chars"))


# requests and resources


def _requests(spark, sf):
    return table(spark, sf, "events").select("event_type", F.col("value").alias("seconds"), (F.col("event_type") != "error").alias("ok"), "ts", "user_id", "event_id")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS requests, CASE WHEN event_type <> 'error' THEN 100.0 ELSE 0.0 END::DOUBLE AS success_pct, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, CASE WHEN count(*) > 20 THEN max(value) FILTER (i = floor(n * 0.95)) ELSE max(value) END AS p95 FROM r GROUP BY event_type")
def latency_summary(spark, sf):
    return aggregates.latency_summary(_requests(spark, sf), ok="ok", by=["event_type"]).withColumn("mean", F.round("mean", 6))


_LE = ", ".join(f"({b}::DOUBLE)" for b in aggregates.LATENCY_BUCKETS) + ", ('inf'::DOUBLE)"


@query(f"SELECT event_type, le, count(*) FILTER (value <= le) AS requests FROM events, (VALUES {_LE}) b(le) GROUP BY event_type, le")
def latency_histogram(spark, sf):
    return aggregates.latency_histogram(_requests(spark, sf), ["event_type"])


@query("SELECT event_type AS type, user_id % 2 = 0 AS cached, count(*) AS total FROM events GROUP BY ALL")
def query_counters(spark, sf):
    return aggregates.counters(table(spark, sf, "events").select(F.col("event_type").alias("type"), (F.col("user_id") % 2 == 0).alias("cached")), ["type", "cached"])


@query("SELECT event_type AS type, count(*) AS count, round(sum(value), 4) AS sum FROM events GROUP BY ALL")
def query_summary(spark, sf):
    return aggregates.summary(_requests(spark, sf).withColumnRenamed("event_type", "type"), ["type"]).withColumn("sum", F.round("sum", 4))


@query("SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def resource_last_n(spark, sf):
    return aggregates.last_samples(_requests(spark, sf), 20, ["event_type"], tie="event_id").select("event_type", "event_id", "ts")


@query("SELECT event_type, round(avg(value), 6) AS mean, max(value) AS most, arg_max(value, ts) AS current, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS uptime_s FROM events GROUP BY event_type")
def resource_stats(spark, sf):
    return aggregates.resource_stats(table(spark, sf, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN n + 0.5 WHEN 1 THEN n WHEN 2 THEN n / 1024.0::DOUBLE ELSE 0.0 END::DOUBLE AS mb FROM (SELECT event_id, (user_id % 900)::DOUBLE AS n FROM events)".replace("n + 0.5", "(n + 0.5) * 1024"))
def parse_memory(spark, sf):
    n = (F.col("user_id") % 900).cast("string")
    forms = [F.concat(n, F.lit(".5GiB / 8GiB")), F.concat(n, F.lit("MiB / 1GiB")), F.concat(n, F.lit("KiB / 1GiB")), F.concat(n, F.lit("B / 1GiB")), F.lit("x")]
    rows = table(spark, sf, "events").select("event_id", F.get(F.array(*forms), (F.col("event_id") % 5).cast("int")).alias("reading"))
    return rows.select("event_id", measures.memory_mb(F.col("reading")).alias("mb"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id % 100 + 0.5 WHEN 1 THEN user_id % 100 ELSE 0 END::DOUBLE AS pct FROM events")
def parse_percent(spark, sf):
    n = (F.col("user_id") % 100).cast("string")
    rows = table(spark, sf, "events").select("event_id", F.get(F.array(F.concat(n, F.lit(".5%")), F.concat(n, F.lit("%")), F.lit("--")), (F.col("event_id") % 3).cast("int")).alias("reading"))
    return rows.select("event_id", measures.percent(F.col("reading")).alias("pct"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview, round(n_chars / 1048576.0::DOUBLE, 2) AS mb FROM documents")
def text_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", measures.preview(F.col("text")).alias("preview"), measures.megabytes(F.col("n_chars")).alias("mb"))


@query("SELECT round(avg(value) FILTER (user_id % 2 = 0), 6) AS single_s, round(avg(value) FILTER (user_id % 2 = 1), 6) AS batch_s, round(sum(value) FILTER (user_id % 2 = 1) / (8 * count(*) FILTER (user_id % 2 = 1)), 6) AS batch_per_text_s, round(avg(value) FILTER (user_id % 2 = 0) / (sum(value) FILTER (user_id % 2 = 1) / (8 * count(*) FILTER (user_id % 2 = 1))), 6) AS speed_up FROM events")
def embedding_bench(spark, sf):
    runs = table(spark, sf, "events").select(F.when(F.col("user_id") % 2 == 0, "single").otherwise("batch").alias("mode"), F.lit(8).alias("texts"), F.col("value").alias("seconds"))
    out = aggregates.embedding_bench(runs)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT count(*) FILTER (event_type IN ('view', 'click')) AS processed, count(*) FILTER (event_type = 'error') AS skipped, count(*) FILTER (event_type = 'purchase') AS deleted FROM events")
def ingestion_totals(spark, sf):
    kinds = F.create_map(*[F.lit(x) for pair in (("view", "processed"), ("click", "unchanged"), ("error", "error"), ("purchase", "deleted"), ("signup", "other")) for x in pair])
    return aggregates.ingestion_totals(table(spark, sf, "events").select(kinds[F.col("event_type")].alias("status")))


# text tables

_SEP = "(" + " OR ".join(f"contains(line, '{s}')" for s in tables.SEPARATORS) + ")"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_CELLS = "CASE WHEN own = '' THEN []::VARCHAR[] " + " ".join(f"WHEN contains(own, '{s}') THEN string_split(own, '{s}')" for s in tables.SEPARATORS) + r" ELSE string_split_regex(own, '\s{2,}') END"
_LINES = f"""l AS (SELECT doc_id, i::INTEGER - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
o AS (SELECT *, {_STRIP.format(x='line')} AS own FROM l),
c AS (SELECT *, list_filter(list_transform({_CELLS}, lambda x: {_STRIP.format(x='x')}), lambda x: x <> '') AS cells FROM o),
s AS (SELECT *, CASE WHEN own = '' THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + (CASE WHEN {_SEP} THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(line, '\\s{{2,}}') THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN len(cells) >= 2 THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(line, '[0-9]') THEN 0.1::DOUBLE ELSE 0 END) END AS score FROM c)"""


def _lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, round(score, 6) AS score FROM s")
def table_line_scores(spark, sf):
    x = _lines(spark, sf).select("doc_id", F.posexplode(F.transform("lines", tables.line_score)).alias("line_no", "score"))
    return x.withColumn("score", F.round("score", 6))


@query(f"WITH {_LINES} SELECT doc_id, line_no, cells FROM s WHERE len(cells) > 1")
def table_cells(spark, sf):
    x = _lines(spark, sf).select("doc_id", F.posexplode(F.transform("lines", tables.split_line)).alias("line_no", "cells"))
    return x.where(F.size("cells") > 1)


@query(
    f"""WITH {_LINES}, w AS (SELECT doc_id, line_no, (score + lead(score, 1) OVER p + lead(score, 2) OVER p) / 3 > 0.3 AS above, lead(score, 2) OVER p IS NOT NULL AS whole, count(*) OVER (PARTITION BY doc_id) AS n FROM s WINDOW p AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT doc_id, min(line_no) FILTER (above) AS start_line, max(n) AS n FROM w WHERE whole GROUP BY doc_id HAVING min(line_no) FILTER (above) IS NOT NULL)
SELECT b.doc_id, start_line, coalesce(min(w.line_no) FILTER (NOT above AND w.line_no > start_line), b.n)::INTEGER AS end_line FROM b JOIN w ON w.doc_id = b.doc_id AND w.whole GROUP BY b.doc_id, start_line, b.n"""
)
def table_boundary(spark, sf):
    x = _lines(spark, sf).withColumn("b", tables.boundary(F.col("lines"))).where("b is not null")
    return x.select("doc_id", F.col("b.start").alias("start_line"), F.col("b.end").alias("end_line"))


_TABLE = "array(concat('表 ', lang), '', 'name | qty | when | code', concat('d', doc_id, ' | ', n_chars, ' | 2024-01-0', doc_id % 9 + 1, ' | ', lang), 'second  row | １２ | 2024-02-03 | x_1', 'third | -3.5 | 2024/2/4 | y.z', '', 'the end')"


def _tables(spark, sf):
    """A table of each document's columns, with a title, a full-width number and text after it."""
    return tables.analyse(table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("n_chars", F.lit(0)).alias("n_chars")).select("doc_id", F.expr(_TABLE).alias("lines")))


_TABLE_SQL = "r AS (SELECT doc_id, a, q, w, lang, greatest(10, length(a))::INTEGER AS wa, greatest(3, length(q))::INTEGER AS wq, greatest(4, length(lang))::INTEGER AS wl FROM (SELECT doc_id, 'd' || doc_id AS a, coalesce(n_chars, 0)::VARCHAR AS q, '2024-01-0' || (doc_id % 9 + 1) AS w, coalesce(lang, 'xx') AS lang FROM documents))"


@query(f"WITH {_TABLE_SQL} SELECT doc_id, col, alignment, content_type FROM r, (VALUES (0, 'left', 'code'), (1, 'right', 'numeric'), (2, 'right', 'date'), (3, 'left', 'code')) t(col, alignment, content_type)")
def table_column_types(spark, sf):
    x = _tables(spark, sf).select("doc_id", F.posexplode(F.arrays_zip("alignments", "content_types")).alias("col", "c"))
    return x.select("doc_id", "col", F.col("c.alignments").alias("alignment"), F.col("c.content_types").alias("content_type"))


@query(f"WITH {_TABLE_SQL} SELECT doc_id, 4 AS columns, 3 AS rows, 1.0::DOUBLE AS data_density, 0.0::DOUBLE AS japanese_ratio, round(10 / 12.0::DOUBLE, 6) AS layout_score, round((3 + 2 / 3.0::DOUBLE + 2 / 3.0::DOUBLE + 2 / 3.0::DOUBLE + 1) / 7, 6) AS structure_confidence, CASE WHEN length(q) < 2 THEN round(11.8 / 12::DOUBLE, 6) ELSE 1.0::DOUBLE END AS content_quality, '表 ' || lang AS title FROM r")
def table_metrics(spark, sf):
    x = _tables(spark, sf)
    return x.select("doc_id", F.col("metrics.column_count").alias("columns"), F.col("metrics.row_count").alias("rows"), *[F.round(f"metrics.{c}", 6).alias(c) for c in ("data_density", "japanese_ratio", "layout_score", "structure_confidence", "content_quality")], "title")


@query(f"""WITH {_TABLE_SQL} SELECT doc_id, chr(10) || '**表 ' || lang || '**' || chr(10) || chr(10) || '| ' || rpad('name', wa, ' ') || ' | ' || rpad('qty', wq, ' ') || ' | when       | ' || rpad('code', wl, ' ') || ' |' || chr(10)
  || '| ' || repeat('-', wa) || ' | ' || repeat('-', wq - 1) || ': | ---------: | ' || repeat('-', wl) || ' |' || chr(10) || '| ' || rpad(a, wa, ' ') || ' | ' || rpad(q, wq, ' ') || ' | ' || w || ' | ' || rpad(lang, wl, ' ') || ' |' || chr(10)
  || '| ' || rpad('second row', wa, ' ') || ' | ' || rpad('12', wq, ' ') || ' | 2024-02-03 | ' || rpad('x_1', wl, ' ') || ' |' AS markdown FROM r""")
def table_render(spark, sf):
    return _tables(spark, sf).select("doc_id", "markdown")


@query()
def table_markdown(spark, sf):
    """The first table of each document that has one, rendered."""
    x = tables.analyse(_lines(spark, sf))
    return x.where("markdown is not null").select("doc_id", "start_line", "end_line", "title", "markdown", F.round("metrics.structure_confidence", 6).alias("confidence"), F.round("metrics.content_quality", 6).alias("quality"))


@query(r"SELECT doc_id, round(len(regexp_extract_all(text, '\s')) / length(text)::DOUBLE, 6) AS space_ratio, round(len(regexp_extract_all(text, '\p{L}')) / length(text)::DOUBLE, 6) AS alpha_ratio, round(len(regexp_extract_all(text, '\p{Nd}')) / length(text)::DOUBLE, 6) AS digit_ratio, round(len(regexp_extract_all(text, '\p{P}')) / length(text)::DOUBLE, 6) AS symbol_ratio, 0.0::DOUBLE AS japanese_ratio FROM documents")
def text_properties(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", tables.text_properties(F.col("text")).alias("p"))
    return x.select("doc_id", *[F.round(f"p.{c}", 6).alias(c) for c in ("space_ratio", "alpha_ratio", "digit_ratio", "symbol_ratio", "japanese_ratio")])


# embedders


@query("SELECT vec_id, i::INTEGER AS i, round(embedding[i + 1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS x FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)")
def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("WITH t AS (SELECT label, vec_id, i, embedding[i + 1]::DOUBLE AS x, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS m FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)) SELECT label, i::INTEGER AS i, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS x FROM t GROUP BY label, i")
def mean_pool(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "embedding", F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("m"))
    return vectors.mean_pool_rows(e, "label", "embedding", "m").withColumn("x", F.round("x", 6))


@query("SELECT doc_id, i::INTEGER AS i, round(('0x' || substr(md5(text || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 6) AS x FROM (SELECT doc_id, text, unnest(range(16)) AS i FROM documents)")
def dummy_embed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(vectors.hash_embedding(F.col("text"), 16)).alias("i", "x")).withColumn("x", F.round("x", 6))


@query(_MD_SQL + ", k AS (SELECT doc_id, content FROM o WHERE trim(content, chr(32) || chr(10)) <> '') SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars, round(min((('0x' || substr(md5(content || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)::FLOAT::DOUBLE), 6) AS least FROM k GROUP BY doc_id")
def ingest_pipeline(spark, sf):
    """Markdown files to chunks with vectors, summed up by document."""
    chunks = chunking.chunk_markdown_files(_markdown(spark, sf)).where(F.trim(F.col("content"), F.lit(" \n")) != "")
    rows = HashEmbedder(8).embed(chunks, "content")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("content")).alias("chars"), F.round(F.min(F.get("vector", F.lit(0)).cast("double")), 6).alias("least"))


@query("SELECT sum(n)::BIGINT AS total FROM (SELECT least(5, count(*)) AS n FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id)")
def batch_total(spark, sf):
    return batch_topk(spark, sf).groupBy("query_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"))
