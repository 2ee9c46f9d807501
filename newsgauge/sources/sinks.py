"""Table sinks: CSV, Parquet per source and label, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 1_000_000


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; arrays and structs as JSON text, null as an empty cell."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    flat.write.mode(mode).csv(
        path, header=True, quote='"', escape='"', nullValue="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def sink_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def sink_partitioned(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = ("source", "label"),
    mode: str = "errorifexists",
) -> None:
    """One folder per source and label. Rebalancing gathers small ones and splits a hot one."""
    rebalanced = df.hint("rebalance", *[F.col(k) for k in keys])
    rebalanced.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*keys).parquet(path)


def sink_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors keyed by article; a repeated run replaces them, unless ``mode`` says append."""
    vectors = df.select(
        F.col("article_id").cast("bigint"), F.col("embedding").cast("array<float>").alias("embedding")
    )
    vectors.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
