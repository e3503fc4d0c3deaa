"""Deltas, deletion vectors, statistics, clustering, pages and single evaluation of the store and its worker."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.operators import filters as flt
from cairn.operators.store import ParquetStore, _may_match
from cairn.sources import files as src
from cairn.streaming.worker import Ingestor


def many(spark, n, sources=200):
    return spark.range(n).select(
        "id", F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit(" more"), 60)).alias("content"), F.concat(F.lit("/s"), F.lpad((F.col("id") % sources).cast("string"), 4, "0"), F.lit(".md")).alias("source"),
        F.when(F.col("id") % sources < 100, "md").otherwise("py").alias("source_type"), ((F.col("id") * 7919) % n).alias("created_at"), F.array(*[F.sin(F.col("id") * (j + 1.0)).cast("float") for j in range(16)]).alias("vector"),
    )


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("big"))
    s = ParquetStore(spark, path, shards=2)
    s.add(many(spark, 20_000))
    s.compact(files=24)
    return path


def bytes_of(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(path) for f in fs)


def test_a_small_change_writes_little(spark, big):
    s = ParquetStore(spark, big)
    size, before = bytes_of(big), {r.id: r.content for r in s.df().select("id", "content").collect()}
    new = many(spark, 5).withColumn("source", F.lit("/s0003.md")).withColumns({"id": F.col("id") + 900_000, "content": F.lit("changed")})
    assert s.replace(new) == 100
    assert bytes_of(big) - size < 0.01 * size
    want = {i: c for i, c in before.items() if i % 200 != 3} | {900_000 + i: "changed" for i in range(5)}
    assert {r.id: r.content for r in s.df().select("id", "content").collect()} == want
    assert {r.content for r in s.source_rows("/s0003.md").collect()} == {"changed"}
    assert s.delete_file("/s0003.md") == 5 and s.delete_file("/s0003.md") == 0 and not s.file_exists("/s0003.md")
    marked = s.snap.read()["marked"]
    s.compact()
    assert marked == 105 and s.snap.read()["marked"] == 0 and s.snap.read()["marks"] == []
    assert {r.id for r in s.df().select("id").collect()} == {i for i in before if i % 200 != 3}


@pytest.mark.parametrize(
    "f", [{"created_after": 1000, "created_before": 1500}, {"source": "/s0017.md"}, {"source": ["/s0017.md", "/nowhere"]}, {"source_type": "py"}, {"source_type": "none"}, {"source": []}, {"metadata.source": "/s0150.md", "created_after": 19_000}, {"source_contains": "17"}]
)
def test_fewer_files_are_opened(spark, big, f):
    s = ParquetStore(spark, big)
    every, got = s.df(), s.df(filters=f)
    ids = lambda df: sorted(r.id for r in flt.apply(df, f).select("id").collect())
    assert ids(got) == ids(every)
    if _may_match(f) is not None and f.get("source_type") != "py":
        assert len(got.inputFiles()) <= 0.5 * len(every.inputFiles())


def test_statistics_hold_nulls_and_many_values(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path), shards=1)
    rows = [(i, None if i % 3 == 0 else f"s{i}", None if i == 5 else "t", None if i == 7 else i) for i in range(300)]
    s.add(spark.createDataFrame([(*r, [1.0]) for r in rows], "id long, source string, source_type string, created_at long, vector array<float>").coalesce(1))
    st = s.files().collect()
    assert sum(r.rows for r in st) == 300
    for f, want in (({"source": "s100"}, [100]), ({"source_type": "t", "created_before": 4}, [0, 1, 2, 3]), ({"created_after": 297}, [298, 299])):
        assert sorted(r.id for r in flt.apply(s.df(filters=f), f).select("id").collect()) == want


@pytest.mark.parametrize("by", ["created_at", "id"])
def test_pages_are_the_table(spark, tmp_path, by):
    s, rng = ParquetStore(spark, str(tmp_path), shards=2), random.Random(1)
    rows = [(i if i % 50 else None, f"s{i % 9}", rng.randrange(40) if i % 31 else None, [1.0]) for i in range(400)] + [(77, "s1", 3, [1.0])] * 30
    s.add(spark.createDataFrame(rows, "id long, source string, created_at long, vector array<float>"))
    s.compact(cluster_by=[by])
    s.remove_ids(spark.createDataFrame([(i,) for i in range(0, 400, 7)], "id long"))
    got = [[(r[by], r["id"]) for r in p.collect()] for p in s.pages(25, columns=[by, "id"], by=by)]
    flat = [x for p in got for x in p]
    first = lambda x: [(v is not None, v or 0) for v in x]
    want = sorted(((c if by == "created_at" else i, i) for i, _, c, _ in rows if i is None or i % 7 or i > 399), key=first)
    assert flat == want and all(25 <= len(p) for p in got[:-1])
    where = {"source": "s1"}
    assert sum(p.count() for p in s.pages(10, where)) == s.df().where("source = 's1'").count()


def test_a_page_opens_few_files(spark, big):
    s = ParquetStore(spark, big)
    s.compact(cluster_by=["created_at"])
    every = s.files().count()
    page = s.scroll(100, after=(9_000, None))
    assert page.count() == 100 and s._page_files(100, None, (9_000, None), "created_at").count() <= every // 3


def test_older_states_stay_as_long_as_they_are_kept(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path), shards=2)
    s.add(many(spark, 50))
    old = s.df()
    s.delete_file("/s0001.md")
    s.compact(keep=3)
    assert old.count() == 50 and s.df().count() == 49
    s.compact(only=[0])
    assert s.df().count() == 49 and len(s.snap.versions()) == 1


def test_a_failed_change_leaves_nothing(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path), shards=2)
    s.add(many(spark, 5))
    before = s.version
    with pytest.raises(ValueError, match="needs a vector"):
        s.add(many(spark, 5).withColumn("vector", F.lit(None).cast("array<float>")))
    assert s.version == before and len(os.listdir(tmp_path / "data")) == 1
    with pytest.raises(RuntimeError, match="another change"):
        s.snap.commit({**s.snap.read(), "version": before})


def test_rows_are_embedded_once_and_contents_read_once(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(20):
        (docs / f"f{i}.md").write_text(f"# Title {i}\n\ntext {i}\n")
    embedded, read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    class Counting:
        dimension = 2

        def embed(self, df, text, out="vector"):
            def run(parts):
                for b in parts:
                    embedded.add(b.num_rows)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[1.0, 2.0]] * b.num_rows, pa.list_(pa.float32()))], names=[*b.schema.names, out])

            return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {out} array<float>")

    plain = src.contents

    def counted(paths):
        def run(parts):
            for b in parts:
                read.add(b.num_rows)
                yield b

        return plain(paths).mapInArrow(run, src.SCHEMA)

    monkeypatch.setattr(src, "contents", counted)
    s = ParquetStore(spark, str(tmp_path / "s"), shards=2)
    worker = Ingestor(spark, s, Counting())
    out = worker.run_once([str(docs)])
    assert out["added_files"] == 20 and out["added_docs"] == s.df().count() == embedded.value
    had = read.value
    assert worker.run_once([str(docs)])["unchanged_files"] == 20 and read.value == had and embedded.value == s.df().count()
    (docs / "f3.md").write_text("# Other\n\nnew and longer text\n")
    (docs / "f4.md").unlink()
    out = worker.run_once([str(docs)])
    assert (out["updated_files"], out["deleted_files"], out["unchanged_files"]) == (1, 1, 18) and read.value - had <= 3
    assert s.registry().where("file_path like '%f3.md'").first().chunk_count == 1 and s.registry().count() == 19


def test_many_marks_reach_readers_as_bit_maps(spark, tmp_path, monkeypatch):
    """However marks are joined the rows are the same; over 100,000 are broadcast as a few maps."""
    from cairn.operators import store

    n, odd = 140_000, [0, 7, 8, 63, 64, 32767, 32768, 65535, 65536, 139_999]
    s = ParquetStore(spark, str(tmp_path), shards=1)
    s.add(spark.range(0, n, 1, 1).select("id", F.lit("t").alias("content"), F.lit("/a").alias("source"), F.array(F.lit(1.0).cast("float")).alias("vector")))
    gone = F.col("id").isin(odd) | (F.col("id") % 14 < 11) & ~F.col("id").isin([1, 32769, 65534])
    ids = spark.range(n).where(gone)
    s.remove_ids(ids.where("id % 2 = 0"))
    s.remove_ids(ids.where("id % 2 = 1"))
    want = sorted({*range(n)} - {r.id for r in ids.collect()})
    m = s.snap.read()
    assert m["marked"] == n - len(want) > store.MARKS and m["maps"] <= 2 * (n // store.BLOCK + 1)
    # the shuffled join, rows one by one, maps
    for marks, maps, joined in ((0, 0, "LeftAnti"), (n, 0, "LeftAnti"), (store.MARKS, store.MAPS, "bitmap_construct_agg")):
        monkeypatch.setattr(store, "MARKS", marks)
        monkeypatch.setattr(store, "MAPS", maps)
        rows = s._live(None)
        assert joined in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in rows.select("id").collect()) == want
        assert rows.columns == s._live([0]).columns and rows.select("id").distinct().count() == rows.count() == len(want)
    s.compact()
    assert s.snap.read()["maps"] == 0 and sorted(r.id for r in s.df().select("id").collect()) == want
