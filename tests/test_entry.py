"""The driver's contract: entry, registered queries and their oracles on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_oracle(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = duck.execute(registry.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in rel.fetchall()) == got


@pytest.mark.parametrize("pipeline", [True, False])
def test_stands_without_the_corpus_operators(tmp_path, pipeline):
    """A copy without both llm folders, with or without the pipeline's module, still registers all other queries."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("cairn", "tests"):
        shutil.copytree(f"{here}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline and os.path.exists(f"{here}/corpus_pipeline.py") else [])):
        shutil.copy(f"{here}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; from cairn.plans import registry as r; import bench; assert set(e.queries()) == set(r.QUERIES) and set(e.oracle_sql()) == set(r.SQL)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
