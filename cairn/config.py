"""Engine settings, as one immutable value."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Nothing here sets a Spark master or memory: the session is the caller's."""

    dimension: int = 512
    shards: int = 1
    max_batch: int = 32
    max_top_k: int = 50
    query_ttl_s: float = 600.0
    query_cache: int = 1000
    text_cache: int = 500  # hybrid and keyword results, each
    embedding_cache: int = 500
    strict_dimension: bool = False
    base_dir: str = ""
    log_level: str = "INFO"
    ignored_patterns: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def from_env(cls, env=os.environ) -> EngineConfig:
        return cls(
            max_batch=int(env.get("MAX_BATCH_SIZE", cls.max_batch)),
            base_dir=env.get("DATA_DIR", cls.base_dir),
            log_level=env.get("LOG_LEVEL", cls.log_level),
        )
