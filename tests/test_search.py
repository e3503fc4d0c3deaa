"""Searches and filters on the small literal stores."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cairn.functions.paths import shard_of
from cairn.operators import search
from cairn.operators.filters import apply, build

ROWS = [(1, "最初の文書", "/path/to/test1.md", "markdown", [1.0, 0.0, 0.0, 0.0]), (2, "次の文書", "/path/to/test2.md", "markdown", [0.0, 1.0, 0.0, 0.0]), (3, "別の種類", "/path/to/test3.txt", "text", [0.0, 0.0, 1.0, 0.0])]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame([(*r, f'{{"k": {r[0]}, "s": "{r[0]}", "z": null, "b": true}}') for r in ROWS], "id long, content string, source string, source_type string, vector array<float>, m string").withColumn("metadata", F.parse_json("m")).drop("m").withColumn("created_at", F.col("id") * 100)


def ids(df):
    return [r.id for r in df.collect()]


def test_vector(store):
    got = search.vector_search(store, [0.9, 0.1, 0, 0], 2).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(1, 0.993884), (2, 0.110432)]
    assert ids(search.vector_search(store, [0.9, 0.1, 0, 0], 10, {"metadata.source_type": "markdown"})) == [1, 2]
    assert ids(search.vector_search(store, [], 5)) == []
    assert [r.score for r in search.vector_search(store, [0.0] * 4, 5).collect()] == [0, 0, 0]
    assert [r.score for r in search.vector_search(store, [1.0, 0, 0], 5).collect()] == [0, 0, 0]
    assert round(search.vector_search(store, [-1.0, 0, 0, 0], 3).collect()[-1].score, 6) == -1


def test_plan_is_a_top_k(store):
    plan = search.vector_search(store, [1.0, 0, 0, 0], 2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_keyword(store):
    assert ids(search.keyword_search(store, "別の種類", 2)) == [3]
    assert ids(search.keyword_search(store, "  ", 2)) == []
    assert ids(search.keyword_search(store, "文書", 5, {"source_type": "markdown"})) == [2, 1]  # earlier in the text


@pytest.mark.parametrize(("content", "keyword", "want"), [("abcab", "ab", 0.9), ("100% x", "100%", 0.7), ("100x", "100%", None), ("ABC abc", "abc", 0.9)])
def test_keyword_score(spark, content, keyword, want):
    rows = search.keyword_search(spark.createDataFrame([(1, content)], "id long, content string"), keyword).collect()
    assert ([round(r.score, 6) for r in rows] or [None]) == [want]


def test_match_types(spark):
    df = spark.createDataFrame([(1, "Abc def"), (2, "abc"), (3, "x abc"), (4, None)], "id long, content string")
    assert sorted(ids(search.keyword_search(df, "abc", 9, match_type="starts_with"))) == [1, 2]
    assert sorted(ids(search.keyword_search(df, "abc", 9, match_type="ends_with"))) == [2, 3]
    assert ids(search.keyword_search(df, "abc", 9, match_type="exact")) == [2]
    with pytest.raises(ValueError):
        search.keyword_match(F.col("content"), "x", "fuzzy")


def test_hybrid(store, spark):
    got = search.hybrid_search(store, "別の種類", [0, 0, 0.8, 0], 3, vector_weight=0.5, text_weight=0.5).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(3, 0.95), (1, 0), (2, 0)]
    one = spark.createDataFrame([(1, "xcde", [1.0])], "id long, content string, vector array<float>")
    assert round(search.hybrid_search(one, "ab cde", [1.0]).first().text_match, 6) == 0.225
    assert search.hybrid_search(one, "", [1.0]).first().text_match == 0


def test_filters(store):
    f = lambda x, **k: ids(apply(store, x, **k).orderBy("id"))
    assert f(None) == f({}) == f({"nonsense": 1}) == [1, 2, 3]
    assert f({"source": "/path/to/test1.md"}) == [1] and f({"source": ["/path/to/test1.md", "x"]}) == [1]
    assert f({"created_after": 100, "created_before": 300}) == [2]
    assert f({"metadata": {"k": 1}}) == [1] and f({"metadata": {"k": "1"}}) == [] and f({"metadata": {"s": "1"}}) == [1] and f({"metadata": {"s": 1}}) == []
    assert f({"metadata": {"missing": 1}}) == [] and f({"metadata": {"k": [1, 3]}}) == [1, 3] and f({"metadata": {"z": None}}) == [1, 2, 3] and f({"metadata": {"b": True}}) == [1, 2, 3] and f({"metadata": {"b": 1}}) == []
    assert f({"metadata.k": 2}) == [2] and f({"source_contains": "test3"}) == [3] and f({"path": "%.txt"}) == [3]
    with pytest.raises(ValueError):
        build({"nonsense": 1}, strict=True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_sharded_and_batch_equal_global(spark, data):
    vecs = data.draw(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=25))
    q = data.draw(st.lists(st.integers(-3, 3), min_size=3, max_size=3))
    k = data.draw(st.integers(1, 6))
    df = spark.createDataFrame([(i, f"/s{i % 7}.md", [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, source string, vector array<float>").withColumn("shard", shard_of(F.col("source"), 3))
    one = [(r.id, round(r.score, 9)) for r in search.vector_search(df, [float(x) for x in q], k).collect()]
    assert [(r.id, round(r.score, 9)) for r in search.sharded_search(df, [float(x) for x in q], k).collect()] == one
    rows = search.batch_search(df, spark.createDataFrame([(7, [float(x) for x in q]), (8, [1.0, 0.0, 0.0])], "query_id long, query_vector array<float>"), k).where("query_id = 7").orderBy("rank").collect()
    assert [round(r.score, 6) for r in rows] == [round(s, 6) for _, s in one]


@pytest.mark.parametrize("block,size", [(256, 16 << 20), (7, 16 << 20), (7, 40 * 3 * 8)])
def test_batches_of_many_queries(spark, monkeypatch, block, size):
    """Blocks inside a scan, and several scans, give what single searches give."""
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "QUERY_BYTES", size)
    rows = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5), float(i % 3 - 1)]) for i in range(60)], "id long, vector array<float>")
    asked = [(100 + i, [float(i % 4 - 1), float(i % 9), 1.0]) for i in range(90)] + [(500, None), (501, [])]
    got: dict = {}
    for r in search.batch_search(rows, spark.createDataFrame(asked, "query_id long, query_vector array<float>"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    for qid, q in asked[:90:11]:
        assert got[qid] == [(r.id, round(r.score, 9)) for r in search.vector_search(rows, q, 3).collect()]
    assert len(got) == 92 and got[500] == got[501] == [(0, 0.0), (1, 0.0), (2, 0.0)]
