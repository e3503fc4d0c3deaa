"""Entry functions: ingest once, periodically or from events, and answer JSON lines.

    python -m cairn.plans.cli ingest STORE DIR...
    python -m cairn.plans.cli schedule STORE DIR... [--interval 3600]
    python -m cairn.plans.cli watch STORE EVENT_DIR CHECKPOINT
    python -m cairn.plans.cli serve STORE        (tool calls on standard input, answers on standard output)
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from cairn.config import EngineConfig
from cairn.operators.embedders import HashEmbedder
from cairn.operators.store import ParquetStore
from cairn.plans.engine import Engine
from cairn.streaming.worker import Ingestor


def ingest(worker: Ingestor, directories: Iterable[str]) -> dict[str, int]:
    return worker.run_once(list(directories))


def schedule(worker: Ingestor, directories: Iterable[str], interval: float = 3600.0, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> list[dict[str, int]]:
    """Scans every ``interval`` seconds from start to start; scans never overlap.  rounds: stop after so many."""
    out: list[dict[str, int]] = []
    while rounds is None or len(out) < rounds:
        begin = clock()
        out.append(worker.run_once(list(directories)))
        if rounds is None or len(out) < rounds:
            sleep(max(0.0, begin + interval - clock()))
    return out


def serve(engine: Engine, lines: Iterable[str], write: Callable[[str], object]) -> None:
    for line in lines:
        if line.strip():
            write(engine.handle(line) + "\n")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cairn")
    ap.add_argument("command", choices=["ingest", "schedule", "watch", "serve"])
    ap.add_argument("store")
    ap.add_argument("paths", nargs="*")
    ap.add_argument("--interval", type=float, default=3600.0)
    ap.add_argument("--dimension", type=int, default=384)
    ap.add_argument("--shards", type=int, default=4)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    embedder = HashEmbedder(args.dimension)
    store = ParquetStore(spark, args.store, args.shards)
    worker = Ingestor(spark, store, embedder)
    if args.command == "ingest":
        print(ingest(worker, args.paths))
    elif args.command == "schedule":
        schedule(worker, args.paths, args.interval)
    elif args.command == "watch":
        worker.watch(args.paths[0], args.paths[1]).awaitTermination()
    else:
        serve(Engine(spark, store, embedder, EngineConfig.from_env()), sys.stdin, lambda s: (sys.stdout.write(s), sys.stdout.flush()))


if __name__ == "__main__":
    main()
