"""Request metrics kept on the driver, rendered in the text exposition format; ``frame`` hands them to Spark."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from cairn.operators.aggregates import LATENCY_BUCKETS


class Metrics:
    def __init__(self) -> None:
        self.requests: Counter = Counter()  # (method, endpoint, status)
        self.queries: Counter = Counter()  # (type, cached)
        self.errors: Counter = Counter()
        self.seconds: dict[str, list[float]] = {}  # type -> [count, sum]
        self.buckets: dict[tuple[str, str], list[int]] = {}
        self.gauges: dict[str, float] = {"engine_active_connections": 0.0, "engine_cpu_usage_percent": 0.0, "engine_memory_usage_mb": 0.0}
        self.cache_size: dict[str, int] = {}
        self.samples: list[tuple[str, str, float]] = []

    def record_request(self, method: str, endpoint: str, status: int, seconds: float) -> None:
        self.requests[method, endpoint, str(status)] += 1
        own = self.buckets.setdefault((method, endpoint), [0] * (len(LATENCY_BUCKETS) + 1))
        for i, bound in enumerate((*LATENCY_BUCKETS, float("inf"))):
            own[i] += seconds <= bound

    def record_query(self, kind: str, seconds: float, cached: bool, count: int = 1) -> None:
        self.queries[kind, str(cached).lower()] += count
        own = self.seconds.setdefault(kind, [0, 0.0])
        own[0] += 1
        own[1] += seconds
        self.samples.append((kind, str(cached).lower(), seconds))
        del self.samples[:-10_000]

    def record_error(self, kind: str) -> None:
        self.errors[kind] += 1

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.samples, "type string, cached string, seconds double")

    def render(self) -> str:
        out = []

        def line(name: str, value, **labels):
            own = ",".join(f'{k}="{v}"' for k, v in labels.items())
            out.append(f"{name}{{{own}}} {value}" if own else f"{name} {value}")

        for (m, e, s), n in sorted(self.requests.items()):
            line("engine_requests_total", n, method=m, endpoint=e, status=s)
        for (m, e), counts in sorted(self.buckets.items()):
            for bound, n in zip((*LATENCY_BUCKETS, "+Inf"), counts, strict=True):
                line("engine_request_latency_seconds_bucket", n, method=m, endpoint=e, le=bound)
        for kind, (n, total) in sorted(self.seconds.items()):
            line("engine_query_processing_seconds_count", n, type=kind)
            line("engine_query_processing_seconds_sum", total, type=kind)
        for (kind, cached), n in sorted(self.queries.items()):
            line("engine_queries_processed_total", n, type=kind, cached=cached)
        for kind, n in sorted(self.errors.items()):
            line("engine_errors_total", n, type=kind)
        for name, value in self.gauges.items():
            line(name, value)
        for kind, n in sorted(self.cache_size.items()):
            line("engine_cache_size", n, cache_type=kind)
        return "\n".join(out) + "\n"
