"""Vectors by content address: a table of (key, vector) that is joined before the model, so that each distinct text is embedded once, ever.

The key is the SHA-256 of the model's name and the text.  Texts that the table lacks are told apart by their keys before
the shuffle, sorted by length inside each task (so that a batch's texts are about as long as one another) and embedded;
their vectors are appended as a new folder and a new manifest.  Rows then get their vectors by a join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.operators.snapshots import Snapshots

TABLE = "key string, vector array<float>"


class EmbeddingTable:
    """An embedder that keeps what another one has made.  ``model`` names that one: another model's vectors have other keys."""

    def __init__(self, spark: SparkSession, path: str, embedder, model: str):
        self.spark, self.embedder, self.model, self.dimension = spark, embedder, model, embedder.dimension
        self.snap = Snapshots(spark, path)
        if not self.snap.versions():
            self.snap.commit({"version": 0, "folders": [], "rows": 0})

    def table(self) -> DataFrame:
        folders = self.snap.read()["folders"]
        return self.spark.read.schema(TABLE).parquet(*[f"{self.snap.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], TABLE)

    def key(self, text: Column) -> Column:
        """The address of a text; null counts as empty."""
        return F.sha2(F.concat(F.lit(f"{self.model}\n"), F.coalesce(text, F.lit(""))), 256)

    @property
    def rows(self) -> int:
        """How many texts have been embedded."""
        return self.snap.read()["rows"]

    def learn(self, df: DataFrame, text: str) -> int:
        """Embeds the texts that aren't in the table and appends them; returns how many they were.  Those that the model failed on aren't kept."""
        m = self.snap.read()
        new = df.select(self.key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["key"])
        new = new.join(self.table().select("key"), "key", "left_anti").withColumn("size", F.char_length("text")).repartition("key").sortWithinPartitions("size")
        made = self.embedder.embed(new.select("key", "text"), "text", "vector")
        made = made.where(~F.col("embed_error")) if "embed_error" in made.columns else made
        name = self.snap.new("vectors", m["version"] + 1)
        made.select("key", "vector").write.parquet(f"{self.snap.path}/{name}")
        n = self.spark.read.schema(TABLE).parquet(f"{self.snap.path}/{name}").count()
        if n:
            self.snap.commit({**m, "version": m["version"] + 1, "folders": [*m["folders"], name], "rows": m["rows"] + n})
        else:
            self.snap.fs.delete(self.snap.at(name), True)
        return n

    def embed(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        """``df`` with the vectors of its texts; null where the model failed.  ``df`` is read twice, the model never for a known text."""
        self.learn(df, text)
        known = self.table().select(F.col("key").alias("__key"), F.col("vector").alias(out))
        return df.withColumn("__key", self.key(F.col(text))).join(known, "__key", "left").drop("__key").select(*df.columns, out)

    def embed_query(self, text: str) -> list[float]:
        return self.embedder.embed_query(text)

    def compact(self) -> None:
        """Makes one folder of all, and forgets older states."""
        m = self.snap.read()
        if len(m["folders"]) > 1:
            name = self.snap.new("vectors", m["version"] + 1)
            self.table().write.parquet(f"{self.snap.path}/{name}")
            self.snap.commit({**m, "version": m["version"] + 1, "folders": [name]})
        self.snap.sweep(["vectors"], {f for x in self.snap.forget() for f in x["folders"]})
