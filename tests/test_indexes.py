"""The vector index and the text index against searches over all rows."""

import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.operators import search, text_index
from cairn.operators.ann import NOWHERE, VectorIndex
from cairn.operators.text_index import TextIndex

ODD = [(9001, None), (9002, [0.0] * 8), (9003, [1.0] * 3), (9004, [float("nan")] + [1.0] * 7), (9005, [1.0, None] * 4)]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)


def clustered(rng, n, groups=12):
    mids = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(groups)]
    return [(i, [x + rng.gauss(0, 0.1) for x in mids[i % groups]]) for i in range(n)]


def found(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rows = clustered(random.Random(4), 900) + ODD + [(7, [5.0] * 8)] * 3  # ids may repeat
    asked = spark.createDataFrame([(i, v) for i, v in rows[:900:30]] + [(5001, [0.0] * 8), (5002, None), (5003, [1.0])], "query_id long, query_vector array<float>")
    return rows, asked, VectorIndex.build(spark, str(tmp_path_factory.mktemp("ivf")), rows_of(spark, rows), lists=20, k=5)


def test_exact_mode_is_exact(spark, vectors):
    rows, asked, index = vectors
    want = search.batch_search(rows_of(spark, rows), asked, 5)
    assert found(index.search(asked, 5, exact=True)) == found(want)


def test_recall_and_pruning(spark, vectors):
    rows, asked, index = vectors
    asked = asked.where("query_id < 5000")
    want = {(r.query_id, r.id) for r in search.batch_search(rows_of(spark, rows), asked, 5).collect()}
    got = {(r.query_id, r.id) for r in index.search(asked, 5).collect()}
    assert len(want & got) >= 0.95 * len(want)
    assert index.probes < 10  # of 20 lists
    opened = index.search(asked.limit(1), 5).where(F.col("list") != NOWHERE).select("list").distinct().count()
    assert opened <= index.probes
    files = index.rows({0, 1}).inputFiles()
    assert files and all("part=0/" in f or "part=1/" in f for f in files)


def test_changes_touch_their_lists_only(spark, tmp_path):
    rows = clustered(random.Random(9), 400)
    index = VectorIndex.build(spark, str(tmp_path), rows_of(spark, rows), lists=12)
    before = index.snap.read()["lists"]
    assert index.remove(spark.createDataFrame([(5,), (99999,)], "id long")) == 1
    after = index.snap.read()["lists"]
    assert sum(before[j]["folder"] != after[j]["folder"] for j in before) == 1
    new = [(6, rows[7][1]), (1000, rows[8][1]), (1001, None)]
    index.upsert(rows_of(spark, new))
    now = [r for r in rows if r[0] not in (5, 6)] + new
    asked = spark.createDataFrame([(i, v) for i, v in rows[:10]], "query_id long, query_vector array<float>")
    index.vacuum()
    assert found(VectorIndex(spark, str(tmp_path)).search(asked, 7, exact=True)) == found(search.batch_search(rows_of(spark, now), asked, 7))
    assert index.remove(spark.createDataFrame([(-5,)], "id long")) == 0


def test_index_of_nothing(spark, tmp_path):
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vector array<float>")
    index = VectorIndex.build(spark, str(tmp_path / "a"), rows_of(spark, []))
    assert index.search(asked, 3).count() == 0 and index.search(asked, 3, exact=True).count() == 0
    index = VectorIndex.build(spark, str(tmp_path / "b"), rows_of(spark, ODD))
    assert sorted(r.id for r in index.search(asked, 3, exact=True).collect()) == [9001, 9002, 9003]


TEXTS = [
    (1, "The cat sat. the THE other"), (2, None), (3, ""), (4, "   "), (5, "a b\tc\nthat  license that license"), (6, "x" * 5000 + " that"), (7, "ÄÖ that-license ä"), (8, "of the license"), (9, "that\nlicense"),
    (10, "th"), (11, "other oth"), (12, "The cat sat. the THE other"),
]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = TEXTS + [(100 + i, " ".join(rng.choice(["that", "license", "this", "thatched", "of", "lic", "ense", "über"]) for _ in range(rng.randrange(1, 40)))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, content string").repartition(3)
    index = TextIndex(spark, str(tmp_path_factory.mktemp("text")))
    index.add(df)
    return df, index


def scores(df, *more):
    return [(r.id, *[round(r[c], 9) for c in ("score", *more)]) for r in df.collect()]


@pytest.mark.parametrize("keyword", ["that", "That LICENSE", "th", "a", "the the", "x", "xxxxx", "Ä", "nothing here", "  ", "of the license", "that\nlicense", "e", "a b c that license this of x the cat"])
def test_keyword(spark, texts, keyword):
    df, index = texts
    assert scores(index.keyword_search(keyword, 200)) == scores(search.keyword_search(df, keyword, 200, keep=["id"]))


@pytest.mark.parametrize("keyword", ["th", "that", "the cat sat. THE the other", "of the license", "  "])
@pytest.mark.parametrize("match_type", ["starts_with", "ends_with", "exact"])
def test_keyword_at_the_edges(spark, texts, keyword, match_type):
    df, index = texts
    assert scores(index.keyword_search(keyword, 200, match_type)) == scores(search.keyword_search(df, keyword, 200, match_type=match_type, keep=["id"]))


def test_keyword_options(spark, texts):
    df, index = texts
    rows = df.select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("source_type"))
    want = search.keyword_search(df.join(rows, "id"), "that", 30, {"source_type": "odd"}, scoring="constant", keep=["id"])
    assert scores(index.keyword_search("that", 30, scoring="constant", rows=rows, filters={"source_type": "odd"})) == scores(want)
    with pytest.raises(ValueError, match="none of contains"):
        index.keyword_search("x", match_type="fuzzy")


@pytest.mark.parametrize("text", ["that license", "the cat sat. the", "of a", "x", "license über lic", "one two three four five six seven eight nine that"])
def test_hybrid(spark, texts, text):
    df, index = texts
    rows = df.withColumns({"vector": F.array(*[(F.sin(F.col("id") * (j + 1.0))).cast("float") for j in range(4)]), "source_type": F.lit("t")})
    q = [0.3, -0.2, 0.9, 0.1]
    for weights in ({}, {"vector_weight": 0.1, "text_weight": 0.9}, {"vector_weight": 0.0, "text_weight": 1.0}):
        want = search.hybrid_search(rows, text, q, 40, {"source_type": "t"}, keep=["id"], **weights)
        assert scores(index.hybrid_search(rows, text, q, 40, {"source_type": "t"}, **weights), "text_match", "vector_match") == scores(want, "text_match", "vector_match")


def test_fewer_documents_are_read(spark, texts):
    df, index = texts
    assert index.candidates("of the license").count() == 3  # of 162: those with the term "the"
    plan = index.keyword_search("that license", 5)._jdf.queryExecution().toString()
    assert "content" not in plan.split("== Physical Plan ==")[1]


def test_segments(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    assert index.keyword_search("that").count() == 0
    df = lambda rows: spark.createDataFrame(rows, "id long, content string")
    index.add(df([(1, "that one"), (2, "that two"), (3, "three")]))
    index.add(df([(2, "two alone"), (4, "now that")]))
    index.remove(df([(1, None)]).select("id"))
    ids = lambda: [r.id for r in index.keyword_search("that", 10).collect()]
    assert ids() == [4]
    index.add(df([(1, "that again")]))
    assert sorted(ids()) == [1, 4]
    for sort in (False, True):
        index.merge(sort)
        assert sorted(ids()) == [1, 4]
    assert len(index.snap.names("segments")) == 1 and sorted(r.id for r in index.docs().collect()) == [1, 2, 3, 4]


def test_depth_of_rerank_is_calibrated(spark, tmp_path):
    """Vectors without structure under coarse codes: the 100 best codes hold too few of the neighbours, the calibrated number holds them."""
    x = np.random.default_rng(4).normal(size=(3000, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    index = VectorIndex.build(spark, str(tmp_path / "v"), rows, subspaces=1)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    true = {(r.query_id, r.id) for r in search.batch_search(rows, asked, 10).collect()}
    found = {(r.query_id, r.id) for r in index.search(asked, 10).collect()}
    assert len(true & found) >= 0.95 * len(true)
    assert VectorIndex(spark, str(tmp_path / "v")).depth == index.depth > 100


def test_lists_pass_on_what_the_first_ones_leave(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(3000, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    index = VectorIndex.build(spark, str(tmp_path / "v"), rows)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    least = index._bounded(asked, index.search(asked, 10), 10)
    assert 300 <= index._score(index._probes(least, None, True), 10, False, 30).count() < 400
    assert index._score(index._probes(asked, None), 10, False, 30).count() > 3000


def test_postings_are_unpacked_in_bounded_slices():
    """A batch with the large rows of a frequent term in many blocks isn't unpacked whole, and gives the same as its rows one by one."""
    blocks = pa.concat_batches([text_index._block(list(range(k * 500, k * 500 + 500)), ["the word the " * 60] * 500) for k in range(20)])
    assert isinstance(blocks, pa.RecordBatch)
    part = blocks.append_column("segment", pa.array(np.zeros(blocks.num_rows, np.int32))).append_column("shift", pa.array(np.zeros(blocks.num_rows, np.int32)))
    got = list(text_index._placed([part]))
    ones = list(text_index._placed([part.slice(i, 1) for i in range(part.num_rows)]))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches(ones).combine_chunks()) or pa.Table.from_batches(got).to_pylist() == pa.Table.from_batches(ones).to_pylist()
    assert sum(b.num_rows for b in got) == 20 * 500 * 180 and max(b.num_rows for b in got) <= 2 * text_index.UNPACK // 4


def test_trigrams_of_small_batches_share_blocks():
    terms = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array([f"term{i % 7}" for i in range(600)])], names=["number", "term"])
    rows = [r for b in text_index._grams([terms.slice(i, 50) for i in range(0, 600, 50)]) for r in b.to_pylist()]
    assert len({r["gram"] for r in rows}) == len(rows) and next(r for r in rows if r["gram"] == "ter")["numbers"] == list(range(600))


def calls(run):
    """What ``run`` gives and how many functions it calls."""
    n = [0]

    def count(frame, event, arg):
        n[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        return run(), n[0]
    finally:
        sys.setprofile(None)


def test_blocks_take_no_call_a_word():
    """Postings and trigrams are made from arrays; their rows are those of a plain loop."""
    rng = random.Random(8)
    texts = ["", " \t", *["".join(rng.choices("abc é日\x00\x1c\x85\n", k=k)) for k in (5, 3000, 3000, 40, 3000)]]
    ids = [7, -5, 1 << 60, 3, 3, 9, 8]
    text_index._block([1], ["a"])  # the table of white space
    block, n = calls(lambda: text_index._block(ids, texts))
    assert n < 1000
    want = {}
    for i, t in zip(ids, texts, strict=True):
        for m in re.finditer(r"\S+", t):
            want.setdefault(m[0], []).append((i, m.start()))
    row, own, times, _, places = text_index._unpack(block)
    terms = block["term"].to_pylist()
    assert terms == sorted(want)
    got = {}
    for r, i, p in zip(np.repeat(row, times).tolist(), np.repeat(own, times).tolist(), places.tolist(), strict=True):
        got.setdefault(terms[r], []).append((i, p))
    assert got == want
    grams, n = calls(lambda: list(text_index._grams(iter([pa.RecordBatch.from_arrays([pa.array(range(9, 9 + len(terms))), block["term"]], names=["number", "term"])]))))
    assert n < 1000 < len(terms) + sum(map(len, terms))
    held = {}
    for k, t in enumerate(terms, 9):
        for g in {t[i : i + 3] for i in range(max(1, len(t) - 2))}:
            held.setdefault(g, []).append(k)
    assert {r["gram"]: (r["low"], r["numbers"]) for b in grams for r in b.to_pylist()} == {g: (v[0], v) for g, v in held.items()}
