"""The engine's query API: validated requests, result caches and metrics around the operators."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.config import EngineConfig
from cairn.operators import aggregates, search
from cairn.operators.store import ParquetStore
from cairn.plans.cache import TtlCache
from cairn.plans.metrics import Metrics
from cairn.sources.files import handle_line

HIT = ("id", "content", "source", "source_type", "metadata")


class Engine:
    """One store, one embedder.  Errors propagate; a cached answer is a copy with ``cached`` true.

    Cache keys hold the store's version, so a change of the store is seen at once.
    """

    def __init__(self, spark: SparkSession, store: ParquetStore, embedder, config: EngineConfig | None = None):
        self.spark, self.store, self.embedder, self.config = spark, store, embedder, config or EngineConfig()
        c = self.config
        self.caches = {"query": TtlCache(c.query_cache, c.query_ttl_s), "hybrid": TtlCache(c.text_cache, c.query_ttl_s), "keyword": TtlCache(c.text_cache, c.query_ttl_s)}
        self.embeddings = TtlCache(c.embedding_cache)
        self.metrics = Metrics()

    # shared steps

    def _check(self, top_k: int, *weights: float) -> None:
        if not 1 <= top_k <= self.config.max_top_k:
            raise ValueError(f"top_k must be from 1 to {self.config.max_top_k}")
        if any(not 0 <= w <= 1 for w in weights):
            raise ValueError("weights must be from 0 to 1")

    def _vector(self, text: str) -> list[float]:
        hit = self.embeddings.get(text)
        if hit is None:
            hit = self.embedder.embed_query(text)
            self.embeddings.put(text, hit)
        return hit

    def _shape(self, df: DataFrame) -> list[dict]:
        rows = df.withColumn("metadata", F.to_json("metadata")).collect()  # at most top_k
        return [{**{k: v for k, v in r.asDict().items() if k != "score"}, "metadata": json.loads(r["metadata"]) if r["metadata"] else None, "score": float(r["score"] or 0.0)} for r in rows]

    def _answer(self, kind: str, endpoint: str, params: dict, use_cache: bool, run) -> dict:
        begin = time.perf_counter()
        cache = self.caches[kind]
        key = json.dumps({**params, "version": self.store.version}, sort_keys=True, default=str)
        held = cache.get(key) if use_cache else None
        try:
            results = held if held is not None else run()
        except Exception as e:
            self.metrics.record_error(type(e).__name__)
            self.metrics.record_request("POST", endpoint, 500, time.perf_counter() - begin)
            raise
        if use_cache and held is None:
            cache.put(key, results)
        took = time.perf_counter() - begin
        self.metrics.record_query(kind, took, held is not None)
        self.metrics.record_request("POST", endpoint, 200, took)
        self.metrics.cache_size[kind] = len(cache)
        return {"results": [dict(r) for r in results], "total": len(results), "query_time_ms": took * 1000, "cached": held is not None}

    # searches

    def query(self, text: str, top_k: int = 5, filters: Mapping | None = None, use_cache: bool = True) -> dict:
        self._check(top_k)
        params = {"text": text, "top_k": top_k, "filters": filters}
        return self._answer("query", "/query", params, use_cache, lambda: self._shape(search.vector_search(self.store.df(filters=filters), self._vector(text), top_k, filters, norm_col="vector_norm", keep=HIT)))

    def batch_query(self, texts: Sequence[str], top_k: int = 5, filters: Mapping | None = None, use_cache: bool = True) -> dict:
        """One job for all texts; results keep their order."""
        self._check(top_k)
        if len(texts) > self.config.max_batch:
            raise ValueError(f"at most {self.config.max_batch} queries in a batch")
        params = {"texts": list(texts), "top_k": top_k, "filters": filters}

        def run():
            rows = self.spark.createDataFrame([(i, self._vector(t)) for i, t in enumerate(texts)], "query_id long, query_vector array<float>")
            found = search.batch_search(self.store.df(filters=filters), rows, top_k, filters) if texts else None
            hits = found.join(self.store.df().select(*HIT), "id").withColumn("metadata", F.to_json("metadata")).collect() if texts else []
            out: list[dict] = [{"query": t, "results": []} for t in texts]
            for r in sorted(hits, key=lambda r: (r["query_id"], r["rank"])):
                out[r["query_id"]]["results"].append({**{k: r[k] for k in HIT}, "metadata": json.loads(r["metadata"]) if r["metadata"] else None, "score": float(r["score"])})
            return out

        answer = self._answer("query", "/batch_query", params, use_cache, run)
        return {**answer, "total": sum(len(r["results"]) for r in answer["results"])}

    def hybrid_search(self, text: str, top_k: int = 5, filters: Mapping | None = None, vector_weight: float = 0.7, text_weight: float = 0.3, use_cache: bool = True) -> dict:
        self._check(top_k, vector_weight, text_weight)
        params = {"text": text, "top_k": top_k, "filters": filters, "weights": [vector_weight, text_weight]}
        return self._answer("hybrid", "/hybrid_search", params, use_cache, lambda: self._shape(search.hybrid_search(self.store.df(filters=filters), text, self._vector(text), top_k, filters, vector_weight, text_weight, keep=HIT)))

    def keyword_search(self, keyword: str, top_k: int = 5, filters: Mapping | None = None, match_type: str = "contains", use_cache: bool = True) -> dict:
        self._check(top_k)
        params = {"keyword": keyword, "top_k": top_k, "filters": filters, "match_type": match_type}
        return self._answer("keyword", "/keyword_search", params, use_cache, lambda: self._shape(search.keyword_search(self.store.df(filters=filters), keyword, top_k, filters, match_type, keep=HIT)))

    def handle(self, line: str) -> str:
        """A JSON line of a tool call."""
        return handle_line(line, lambda text, k, filters: self.query(text, k, filters)["results"])

    # state

    def optimize(self) -> dict:
        begin = time.perf_counter()
        self.store.compact()
        for c in self.caches.values():
            c.clear()
        return {"status": "success", "details": {"execution_time_ms": (time.perf_counter() - begin) * 1000}}

    def stats(self) -> dict:
        own = aggregates.store_stats(self.store.df(), self.embedder.dimension).first().asDict()
        types = {r["source_type"]: r["documents"] for r in aggregates.documents_by_type(self.store.df()).collect()}
        size = self.store.size_bytes()
        return {
            **own, "documents_by_type": types, "db_size_bytes": size, "db_size_mb": round(size / 1048576, 2), "registered_files": self.store.registry().count(),
            "cache_info": {k: {"size": len(c), "max_size": c.size, "ttl": c.ttl} for k, c in {**self.caches, "embedding": self.embeddings}.items()},
            "resource_stats": dict(self.metrics.gauges),
        }

    def rebalance_report(self, threshold: float = 0.3) -> dict:
        per = aggregates.shard_stats(self.store.df(), self.store.shards)
        return {**aggregates.imbalance(per, threshold).first().asDict(), "shards": [r.asDict() for r in per.orderBy("shard").collect()]}

    def health(self) -> dict:
        return {"status": "healthy"}

    def metrics_text(self) -> str:
        return self.metrics.render()
