"""Searches over a store: exact vector top-k (single, batch, by shard), keyword and hybrid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cairn.functions.vectors import cosine_to
from cairn.operators import filters as flt

#: Queries that a task multiplies its vectors with at once, and bytes of query vectors that are sent to the executors for one scan.
QUERY_BLOCK, QUERY_BYTES = 256, 16 << 20


def top(df: DataFrame, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The k best rows; equal scores by id.  Plans as TakeOrderedAndProject: each task keeps k rows."""
    return df.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(id_col).asc()).limit(k)


def vector_search(store: DataFrame, query: Sequence[float], k: int = 5, filters: Mapping | None = None, id_col: str = "id", vec_col: str = "vector", norm_col: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Exact cosine top-k with ``score``; an empty query vector finds nothing.  Filters come before scores."""
    rows = flt.apply(store, filters)
    if not len(query):
        rows = rows.where(F.lit(False))
    scored = rows.withColumn("score", cosine_to(F.col(vec_col), query, F.col(norm_col) if norm_col else None))
    return top(scored.select(*(keep or [c for c in store.columns if c != vec_col]), "score"), k, id_col=id_col)


def batch_search(store: DataFrame, queries: DataFrame, k: int = 5, filters: Mapping | None = None, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """``query_id, id, score, rank`` for queries (query_id, query_vector).

    Each task multiplies its vectors with the queries, block by block, and passes on k rows for each; then they are ranked.
    One scan serves QUERY_BYTES of query vectors.
    Vectors of another length, null, zero or with components that make no number score 0.0, as in the single search.
    """
    rows = flt.apply(store, filters).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    spark, size = store.sparkSession, queries.agg(F.sum(F.size("query_vector").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size * 8 // QUERY_BYTES))
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "query_vector").collect()
        shared = spark.sparkContext.broadcast([(r[0], [float(x) for x in r[1] or []]) for r in own])
        part = rows.mapInArrow(_partial_top(shared, k), "query_id long, id long, score double")
        out = part if out is None else out.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _partial_top(shared, k: int):
    def run(parts):
        best: dict[int, list[tuple[float, int]]] = {}
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for qid, v in shared.value:
            by_size.setdefault(len(v), []).append((qid, np.array(v)))
        steps = [(dim, qs[lo : lo + QUERY_BLOCK]) for dim, qs in by_size.items() for lo in range(0, len(qs), QUERY_BLOCK)]
        for part in parts:
            ids, col = np.array(part["id"].to_pylist(), object), part["v"]
            ok = np.array([x is not None for x in ids], bool)
            size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False)  # nulls are NaN
            begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            for dim, qs in steps:
                score = np.zeros((len(qs), len(ids)))
                at = np.flatnonzero(size == dim) if dim else np.zeros(0, int)
                if len(at):
                    x = flat[begin[at][:, None] + np.arange(dim)]
                    q = np.stack([v for _, v in qs])
                    with np.errstate(invalid="ignore", over="ignore"):
                        length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                        found = np.divide(q @ x.T, length, out=np.zeros_like(length), where=length > 0)
                    score[:, at] = np.where(np.isnan(found), 0.0, found)
                for (qid, _), s in zip(qs, score, strict=True):
                    s, own = s[ok], ids[ok]
                    keep = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    best[qid] = sorted(best.get(qid, []) + [(-float(s[i]), int(own[i])) for i in keep])[:k]
        rows = [(q, i, -s) for q, found in best.items() for s, i in found]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "id", "score"])

    return run


def sharded_search(store: DataFrame, query: Sequence[float], k: int = 5, filters: Mapping | None = None, shard_col: str = "shard", id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """2k of each shard, merged to k: equal to ``vector_search``, with the rank inside its shard."""
    scored = flt.apply(store, filters).withColumn("score", cosine_to(F.col(vec_col), query)).select(*[c for c in store.columns if c != vec_col], "score")
    rank = F.row_number().over(Window.partitionBy(shard_col).orderBy(F.desc("score"), id_col))
    return top(scored.withColumn("shard_rank", rank).where(F.col("shard_rank") <= 2 * k), k, id_col=id_col)


def _occurrences(c: Column, word: str) -> Column:
    return (F.char_length(c) - F.char_length(F.replace(c, F.lit(word), F.lit("")))) / F.lit(len(word))


def _position(c: Column, word: str) -> Column:
    return F.instr(c, word) - 1


def keyword_score(content: Column, keyword: str) -> Column:
    """Mean over words of min(0.2 * count, 0.5) + 0.5 * (1 - min(position / length, 0.8)), at most 1."""
    words, c = keyword.lower().split(), F.lower(content)
    total = F.lit(0.0)
    for w in words:
        early = 1 - F.least(_position(c, w) / F.greatest(F.char_length(content), F.lit(1)), F.lit(0.8))
        total = total + F.least(_occurrences(c, w) * 0.2, F.lit(0.5)) + early * 0.5
    return F.least(total / F.lit(max(1, len(words))), F.lit(1.0))


def keyword_match(content: Column, keyword: str, match_type: str = "contains") -> Column:
    """contains: every word; exact, starts_with, ends_with: the whole keyword; all literal and in any case."""
    c, whole = F.lower(content), keyword.lower()
    if match_type == "contains":
        cond = F.lit(bool(whole.split()))
        for w in whole.split():
            cond = cond & c.contains(w)
        return cond
    tests = {"exact": c == F.lit(whole), "starts_with": c.startswith(whole), "ends_with": c.endswith(whole)}
    if match_type not in tests:
        raise ValueError(f"match_type {match_type!r} is none of contains, {', '.join(tests)}")
    return tests[match_type] & F.lit(bool(whole.strip()))


def keyword_search(store: DataFrame, keyword: str, k: int = 5, filters: Mapping | None = None, match_type: str = "contains", scoring: str = "position", candidate_limit: int | None = None, id_col: str = "id", text_col: str = "content", keep: Sequence[str] | None = None) -> DataFrame:
    """Keyword top-k; a blank keyword finds nothing.

    scoring: position (see ``keyword_score``) or constant (1.0).  candidate_limit: score only so many matches, by id.
    """
    rows = flt.apply(store, filters).where(keyword_match(F.col(text_col), keyword, match_type))
    if candidate_limit is not None:
        rows = rows.orderBy(id_col).limit(candidate_limit)
    score = F.lit(1.0) if scoring == "constant" else keyword_score(F.col(text_col), keyword if match_type == "contains" else keyword)
    return top(rows.withColumn("score", score).select(*(keep or store.columns), "score"), k, id_col=id_col)


def text_score(content: Column, query: str) -> Column:
    """0.9 where the whole query occurs; else over its words of three letters or more that occur, divided by all words."""
    whole, c = query.lower(), F.lower(content)
    words = whole.split()
    if not words:
        return F.lit(0.0)
    total = F.lit(0.0)
    for w in words:
        if len(w) >= 3:
            own = F.least(_occurrences(c, w) * 0.3, F.lit(0.8)) + (1 - F.least(_position(c, w) / F.greatest(F.char_length(c), F.lit(1)), F.lit(0.7))) * 0.2
            total = total + F.when(c.contains(w), own).otherwise(F.lit(0.0))
    return F.coalesce(F.when(c.contains(whole), F.lit(0.9)).otherwise(total / F.lit(len(words))), F.lit(0.0))


def hybrid_search(store: DataFrame, text: str, query: Sequence[float], k: int = 5, filters: Mapping | None = None, vector_weight: float = 0.7, text_weight: float = 0.3, id_col: str = "id", text_col: str = "content", vec_col: str = "vector", keep: Sequence[str] | None = None) -> DataFrame:
    """Weighted sum of text score and cosine clamped to 0..1, with its parts ``text_match`` and ``vector_match``."""
    vector = F.least(F.greatest(cosine_to(F.col(vec_col), query), F.lit(0.0)), F.lit(1.0))
    rows = flt.apply(store, filters).withColumns({"text_match": text_score(F.col(text_col), text), "vector_match": vector})
    scored = rows.withColumn("score", F.col("vector_match") * F.lit(float(vector_weight)) + F.col("text_match") * F.lit(float(text_weight)))
    return top(scored.select(*(keep or [c for c in store.columns if c != vec_col]), "score", "text_match", "vector_match"), k, id_col=id_col)
