import hashlib
import os
import random
import sys

import corpus_pipeline as cp
from pyspark.sql import functions as F

from cairn.llm import decontaminate

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import brute_lines, brute_links, words  # noqa: E402


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    assert cp.ORACLE_SQL is None


def test_pipeline_against_stages_by_hand(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "123"), (9004, "the of and in this")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True).cache()
    a = cp.language(spark, docs, small).cache()
    assert a.columns == docs.columns and a.where("doc_id in (9001, 9002, 9003)").count() == 0
    assert a.count() == docs.count() - 3 and a.where("lang is null").count() == 0
    b = cp.lines(spark, a, small).cache()
    before = [(r.doc_id, r.text) for r in a.collect()]
    want = {i: (t, n) for (i, _), (t, n, _) in brute_lines(before).items()}
    rows = b.collect()
    assert b.columns == docs.columns and {r.doc_id: r.text for r in rows} == {i: t for i, (t, n) in want.items() if not n or decontaminate.item_words(t)}
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) < len(want)
    c = cp.near_duplicates(spark, b, small).cache()
    assert {r.doc_id for r in c.collect()} == {i for i, low, _ in brute_links([(r.doc_id, r.text) for r in rows]) if i == low}
    d = cp.decontamination(spark, c, small).cache()
    items = [decontaminate.item_words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    stay = {r.doc_id for r in d.collect()}
    for r in c.collect():
        w = decontaminate.item_words(r.text)
        leak = any(max((decontaminate.similarity(decontaminate.shingles(w[s : s + len(x)], 5), decontaminate.shingles(x, 5)) for s in range(max(1, len(w) - len(x) + 1))), default=0) >= 0.8 for x in items if len(w) >= 5)
        assert leak == (r.doc_id not in stay)
    e = cp.encoding(spark, d, small)
    assert e.count() == d.count() and e.where("not round_trip or differing > 0").count() == 0


def test_pipeline_runs_on_an_empty_table(spark, small):
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, empty, small)
        assert out.count() == 0


def test_exact_copies_do_not_stay_as_empty_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rng = random.Random(2)
    text = "\n".join("the of and in " + " ".join(words(rng, 12)) for _ in range(12))
    copies = spark.createDataFrame([(9000 + i, text) for i in range(6)], "doc_id long, text string")
    docs = docs.unionByName(copies, allowMissingColumns=True)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
    assert [r.doc_id for r in docs.where("doc_id >= 9000").collect()] == [9000]
    assert docs.where(~F.col("text").rlike(cp.WORD)).count() == 0 and cp.encoding(spark, docs, small).where("n_tokens = 0").count() == 0


def test_rows_that_share_an_id(spark, small):
    """Only the rows that are copies or leaks go, not clean ones with their id."""
    rng = random.Random(3)
    a, b, c = (" ".join(["the of and in", *words(rng, 60)]) for _ in range(3))
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    cols = spark.read.parquet(f"{small}/documents.parquet").columns
    rows = spark.createDataFrame([(1, a), (5, a), (5, b), (6, item), (6, c), (7, b + " x"), (7, b + " y"), (8, c.replace("the of", "the very of")), (8, c.replace("the of", "the very of"))], "doc_id long, text string")
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0).unionByName(rows, allowMissingColumns=True).select(cols).cache()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    kept = sorted((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, small).collect())
    assert kept == sorted([(1, a), (5, b), (6, item), (6, c)])
    assert md5(b + " x") != md5(b + " y")
    left = sorted((r.doc_id, r.text) for r in cp.decontamination(spark, docs, small).collect())
    assert left == sorted((r.doc_id, r.text) for r in docs.collect() if r.text != item)
