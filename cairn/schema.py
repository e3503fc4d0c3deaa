"""The store's and the file registry's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

STORE = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("content", T.StringType()), T.StructField("source", T.StringType()), T.StructField("source_type", T.StringType()),
        T.StructField("relative_path", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("file_extension", T.StringType()), T.StructField("language", T.StringType()),
        T.StructField("title", T.StringType()), T.StructField("heading_level", T.IntegerType()), T.StructField("section_title", T.StringType()),
        T.StructField("module_name", T.StringType()), T.StructField("symbol_type", T.StringType()), T.StructField("symbol_name", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_total", T.IntegerType()),
        T.StructField("metadata", T.VariantType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("vector_norm", T.DoubleType()),
        T.StructField("created_at", T.LongType()), T.StructField("shard", T.IntegerType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("file_path", T.StringType()), T.StructField("last_modified", T.DoubleType()), T.StructField("file_hash", T.StringType()),
        T.StructField("last_vectorized", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("chunk_count", T.LongType()),
        T.StructField("file_size", T.LongType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType = STORE) -> DataFrame:
    """The schema's columns in order: casts those present, adds nulls for the others."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
