"""Vectors by content address."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.operators.embed_table import EmbeddingTable
from cairn.operators.embedders import ModelEmbedder, like_lengths


class Counting:
    dimension = 2

    def __init__(self, spark):
        self.seen = spark.sparkContext.accumulator(0)

    def embed(self, df, text, out="vector"):
        seen = self.seen

        def run(parts):
            for b in parts:
                seen.add(b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[float(len(t)), 1.0] for t in b[text].to_pylist()], pa.list_(pa.float32()))], names=[*b.schema.names, out])

        return df.mapInArrow(run, "key string, text string, vector array<float>")

    def embed_query(self, text):
        return [float(len(text)), 1.0]


def test_each_text_is_embedded_once(spark, tmp_path):
    model = Counting(spark)
    t = EmbeddingTable(spark, str(tmp_path), model, "m")
    df = lambda texts: spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "id long, content string, key string")
    first = t.embed(df(["a", "bb", "a", None, ""] * 50), "content")
    got = [(r.id % 5, r.vector) for r in first.collect()]
    assert len(got) == 250 and all(v == [[1.0, 1.0], [2.0, 1.0], [1.0, 1.0], [0.0, 1.0], [0.0, 1.0]][i] for i, v in got) and first.columns == ["id", "content", "key", "vector"]
    assert model.seen.value == t.rows == 3
    again = EmbeddingTable(spark, str(tmp_path), model, "m")
    assert sorted(r.vector[0] for r in again.embed(df(["bb", "ccc"]), "content").collect()) == [2.0, 3.0] and model.seen.value == 4
    again.compact()
    assert again.learn(df(["ccc", "a"]), "content") == 0 and model.seen.value == 4 and len(again.snap.names("vectors")) == 1
    assert EmbeddingTable(spark, str(tmp_path), model, "other").learn(df(["a"]), "content") == 1
    assert again.embed(df([]), "content").count() == 0


def test_failed_texts_are_not_kept(spark, tmp_path):
    def load():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError
            return np.ones((len(texts), 1, 2)), np.ones((len(texts), 1))

        return encode

    t = EmbeddingTable(spark, str(tmp_path), ModelEmbedder(load, 2, batch=1), "m")
    rows = t.embed(spark.createDataFrame([("good",), ("bad",)], "c string"), "c").collect()
    assert {r.c: r.vector is None for r in rows} == {"good": False, "bad": True} and t.rows == 1


def test_batches_of_like_lengths():
    texts = ["x" * n for n in (5, 100, 6, 7, 1, 90, 3000)]
    out = like_lengths(texts, 4, 200)
    assert out == [[4, 0, 2, 3], [5, 1], [6]] and like_lengths([], 4, 200) == []


def test_model_batches_keep_the_rows_order(spark):
    load = lambda: lambda texts: (np.array([[[float(len(t)), 1.0]] for t in texts]), np.ones((len(texts), 1)))
    rows = spark.createDataFrame([(i, "y" * ((i * 37) % 50)) for i in range(200)], "i long, t string")
    for r in ModelEmbedder(load, 2, batch=7, batch_chars=120).embed(rows, "t", "v").withColumn("n", F.char_length("t")).collect():
        assert abs(r.v[0] - r.n * r.v[1]) < 1e-3 and not r.embed_error
