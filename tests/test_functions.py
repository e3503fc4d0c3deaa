"""Chunkers, paths, vectors, measures and tables on literal fixtures and by property."""

import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cairn.functions import chunking, measures, paths, vectors
from cairn.operators import tables
from cairn.operators.embedders import HashEmbedder, ModelEmbedder

relaxed = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("length", "n"), [(0, 0), (1, 1), (200, 1), (201, 2), (350, 2), (351, 3)])
def test_window_counts(spark, length, n):
    assert len(col(spark, "a" * length, chunking.fixed_windows)) == n


def test_windows(spark):
    assert [len(c) for c in col(spark, "a" * 401, lambda c: chunking.fixed_windows(c, 200, 0))] == [200, 200, 1]
    assert col(spark, None, chunking.fixed_windows) == []
    assert col(spark, "😀a😀b", lambda c: chunking.fixed_windows(c, 2, 1)) == ["😀a", "a😀", "😀b"]
    for size, overlap in ((10, 10), (10, 11), (10, -1)):
        with pytest.raises(ValueError):
            chunking.fixed_windows(F.col("x"), size, overlap)


@relaxed
@given(text=st.text(alphabet="ab😀\n é", max_size=900), size=st.integers(1, 12), data=st.data())
def test_windows_cover_the_text(spark, text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = col(spark, text, lambda c: chunking.fixed_windows(c, size, overlap))
    step = size - overlap
    want = [] if not text else [text[i * step : i * step + size] for i in range(1 if len(text) <= size else math.ceil((len(text) - size) / step) + 1)]
    assert got == want
    assert (got[0] + "".join(c[overlap:] for c in got[1:]) if got else "") == text


def test_markdown(spark):
    assert col(spark, "intro\n# A\nbody\n#### d\nx\n## B\nz", chunking.markdown_chunks) == ["intro\n", "# A\nbody\n#### d\nx\n", "## B\nz"]
    assert col(spark, "", chunking.markdown_chunks) == [] and col(spark, None, chunking.markdown_chunks) == []
    assert [len(c) for c in col(spark, "# A\n" + "x" * 500, chunking.markdown_chunks)] == [400, 154]
    assert col(spark, "x\n## T #\n", chunking.markdown_title) == "T"
    assert col(spark, "  first\nsecond", chunking.markdown_title) == "first"
    assert col(spark, "", chunking.markdown_title) == ""
    assert (col(spark, "a\n### Deep\n", chunking.heading_level), col(spark, "a\n### Deep \n", chunking.section_title)) == (3, "Deep")
    assert col(spark, "none", chunking.heading_level) is None and col(spark, "none", chunking.section_title) is None


def test_code(spark):
    py = "import a\nclass A:\n  def m(self): pass\ndef f(x):\n  pass\n"
    js = "async function go(a) {\n}\nrun = () => {\n}\n"
    files = spark.createDataFrame([("/r/m/a.py", py), ("/r/b.tsx", js), ("/r/c.txt", "x"), ("/r/d.rs", "fn x() {}"), ("/r/e.py", "class A:\n  pass\n")], "source string, text string")
    rows = chunking.chunk_code_files(files, "/r").orderBy("source", "chunk_index").collect()
    by = {}
    for r in rows:
        by.setdefault(r.file_name, []).append((r.symbol_type, r.symbol_name))
    assert by["a.py"] == [(None, None), ("class", "A"), ("function", "f")]
    assert [n for _, n in by["b.tsx"]] == ["go", "run"]
    assert by["d.rs"] == [(None, None)] and "c.txt" not in by
    a = next(r for r in rows if r.file_name == "a.py")
    assert (a.relative_path, a.file_extension, a.language, a.module_name, a.chunk_total) == ("m/a.py", ".py", "python", "a", 3)
    both = chunking.chunk_files(files.unionByName(spark.createDataFrame([("/r/x.md", "# T\r\nbody\rend")], "source string, text string")))
    md = both.where("source_type = 'markdown'").first()
    assert (md.title, md.content) == ("T", "# T\nbody\nend") and both.where("source_type = 'code'").count() == len(rows)


def test_shards(spark):
    names = [f"/path/to/test{i}.md" for i in range(9)] + ["", "日本語.md"]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    for n in (3, 4, 7, 64):
        got = [r.s for r in rows.select(paths.shard_of(F.col("p"), n).alias("s")).collect()]
        assert got == [int(hashlib.md5(p.encode()).hexdigest(), 16) % n for p in names]


def test_measures(spark):
    assert [col(spark, x, measures.memory_mb) for x in ("1.5GiB / 8GiB", "512MiB / 1GiB", "2048KiB / 1GiB", "12B / 1GiB", "", None)] == [1536, 512, 2, 0, 0, 0]
    assert [col(spark, x, measures.percent) for x in ("5.5%", "x", None)] == [5.5, 0, 0]
    assert [col(spark, x, lambda c: measures.preview(c, 3)) for x in ("abc", "abcd", None)] == ["abc", "abc...", None]


def test_vectors(spark):
    assert col(spark, [3.0, 4.0], vectors.l2_normalize, "array<float>") == [0.6, 0.8]
    row = spark.createDataFrame([([[1.0, 1.0], [3.0, 3.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<float>>, m array<int>")
    assert row.select(vectors.mean_pool(F.col("t"), F.col("m")).alias("y")).first()["y"] == [2.0, 2.0]
    e = HashEmbedder(5)
    made = e.embed(spark.createDataFrame([("abc é",)], "t string"), "t").first()["vector"]
    assert made == pytest.approx(e.embed_query("abc é")) and all(0 <= x < 1 for x in made)


def test_model_embedder(spark):
    import numpy as np

    def load():
        def encode(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return np.array([[[len(t), 1.0], [len(t), 1.0]] for t in texts]), np.ones((len(texts), 2))

        return encode

    rows = ModelEmbedder(load, 2, batch=1).embed(spark.createDataFrame([("a",), ("bad",), ("abc",)], "t string"), "t").collect()
    assert [r.embed_error for r in rows] == [False, True, False]
    assert rows[1].vector == [0.0, 0.0] and sum(x * x for x in rows[2].vector) == pytest.approx(1)


def test_table_lines(spark):
    cells = [col(spark, x, tables.split_line) for x in ("a | b", "k: v", "x  y", "", "  ", "a|b:c", "x　　y")]
    assert cells == [["a", "b"], ["k", "v"], ["x", "y"], [], [], ["a", "b:c"], ["x", "y"]]
    assert [round(col(spark, x, tables.line_score), 6) for x in ("a | 1", "", "plain", "a  1")] == [0.6, 0, 0, 0.5]
    assert col(spark, ["a | 1", "b | 2"], tables.boundary, "array<string>") is None
    got = col(spark, ["x", "y", "a | 1", "b | 2", "c | 3", "z", "z", "z"], tables.boundary, "array<string>")
    assert (got.start, got.end) == (1, 4)


def test_table_analysis(spark):
    lines = ["Table of fruit", "plain", "", "name | qty", "apple | １２", "pear | 3", "x | 4", "", "", "end"]
    r = tables.analyse(spark.createDataFrame([(1, lines), (2, ["none"]), (3, []), (4, None)], "i int, lines array<string>")).orderBy("i").collect()
    assert r[0].cells == [["name", "qty"], ["apple", "12"], ["pear", "3"]] and r[0].title == "Table of fruit"
    assert r[0].content_types == ["code", "numeric"] and r[0].alignments == ["left", "right"]
    assert r[0].markdown == "\n**Table of fruit**\n\n| name  | qty |\n| ----- | --: |\n| apple | 12  |\n| pear  | 3   |"
    assert all(x.cells is None and x.markdown is None for x in r[1:])


def test_text_properties(spark):
    p = col(spark, "ab 1.", tables.text_properties)
    assert (p.alpha_ratio, p.space_ratio, p.digit_ratio, p.symbol_ratio, p.japanese_ratio) == (0.4, 0.2, 0.2, 0.2, 0)
    assert col(spark, "", tables.text_properties).alpha_ratio == 0


def test_readings_and_edge_vectors(spark):
    from cairn.functions import measures, vectors

    rows = spark.createDataFrame([(x,) for x in ("1.5GiB / 8GiB", "512MiB / 1GiB", "2048KiB / 1GiB", "12B / 1GiB", "x")], "r string")
    assert [r[0] for r in rows.select(measures.memory_mb(F.col("r"))).collect()] == [1536.0, 512.0, 2.0, 0.0, 0.0]
    rows = spark.createDataFrame([(x,) for x in ("12.5%", "0%", "--")], "r string")
    assert [r[0] for r in rows.select(measures.percent(F.col("r"))).collect()] == [12.5, 0.0, 0.0]
    edge = [([0.0, 0.0, 0.0], 0), ([1.0, 2.0], 0), ([-1.0, -2.0, -2.0], -1), ([1.0, 2.0, 2.0], 1), (None, 0), ([0.0, 0.0, 1.0], 0.666667), ([float("nan"), 1.0, 1.0], 0), ([float("inf"), 1.0, 1.0], 0), ([1.0, None, 1.0], 0)]
    rows = spark.createDataFrame([(v, [1.0, 2.0, 2.0], float(s)) for v, s in edge], "v array<float>, q array<float>, s double")
    for score in (vectors.cosine_to(F.col("v"), [1.0, 2.0, 2.0]), vectors.cosine(F.col("v"), F.col("q"))):
        assert all(r[0] == r.s for r in rows.select(F.coalesce(F.round(score, 6), F.lit(0.0)), "s").collect())
