"""Table scans: CSV with missing-value strings, Parquet, and labelled sets of CSV files."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge.functions.fixed_values import NA_STRINGS
from newsgauge.functions.text import read_ec_repr
from newsgauge.operators.clean import nan_to_null
from newsgauge.sources.csv_records import csv_records

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("top_img", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("publish_date", T.StringType()),
        T.StructField("movies", T.StringType()),
        T.StructField("images", T.StringType()),
    ]
)
AFFECT_SCHEMA = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("vreg", T.DoubleType()),
        T.StructField("voc", T.IntegerType()),
        T.StructField("eireg_anger", T.DoubleType()),
        T.StructField("eireg_fear", T.DoubleType()),
        T.StructField("eireg_joy", T.DoubleType()),
        T.StructField("eireg_sadness", T.DoubleType()),
        T.StructField("ec", T.ArrayType(T.StringType())),
    ]
)


def _strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def _typed(f: T.StructField) -> Column:
    """A text cell as its type: missing-value strings are null, a malformed cell is an error."""
    cell = F.when(~F.col(f.name).isin(NA_STRINGS), F.col(f.name))
    if isinstance(f.dataType, T.ArrayType):
        return read_ec_repr(cell).alias(f.name)
    if isinstance(f.dataType, T.IntegerType):
        # A column with missing cells may hold whole numbers as 1.0.
        return cell.cast("double").cast("int").alias(f.name)
    return cell.cast(f.dataType).alias(f.name)


_CSV = {
    "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "mode": "FAILFAST",
    "maxCharsPerColumn": -1,
}


def _cells(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """The cells of CSV records as strings."""
    as_strings = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {k: str(v) for k, v in _CSV.items()}
    return records.select("file", F.from_csv("record", as_strings.simpleString(), options).alias("c"))


def _by_header(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    extra: Sequence[Column] = (),
    recursive: bool = False,
) -> DataFrame:
    """Cells of CSV files as strings, found by the column names in each file's header.

    Columns a file does not have are null, its other columns are ignored, and their order does
    not matter. The headers of all files are read by one job; ``extra`` may use the column ``file``.
    """
    records = csv_records(spark, path, recursive)
    headers: dict[str, list[str]] = {}
    for row in records.where("first").select("file", "record").collect():
        headers.setdefault(row["record"], []).append(row["file"])
    if not headers:
        raise FileNotFoundError(f"no CSV file with a header in {path}")
    rows = records.where("not first")
    if len(headers) > 1:
        files = [(file, n) for n, part in enumerate(headers.values()) for file in part]
        rows = rows.join(spark.createDataFrame(files, "file string, header int"), "file")

    def scan(number: int, header: str) -> DataFrame:
        names = next(csv.reader(io.StringIO(header, newline="")))
        mine = rows if len(headers) == 1 else rows.where(F.col("header") == number)
        cells = _cells(mine, [f"_{i}" for i in range(len(names))])
        at = {name: f"c._{i}" for i, name in reversed(list(enumerate(names)))}
        wanted = [
            (F.col(at[f.name]) if f.name in at else F.lit(None).cast("string")).alias(f.name)
            for f in schema
        ]
        return cells.select(*wanted, *extra)

    return reduce(DataFrame.unionByName, [scan(n, h) for n, h in enumerate(headers)])


def scan_csv_strings(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, header: bool = True
) -> DataFrame:
    """CSV cells as written, all strings, by the names in the header.

    ``header=False`` takes columns by position and returns a header as a row. Cells may hold line
    breaks in quotes; every file is read by as many tasks as its size asks for.
    """
    if header:
        return _by_header(spark, path, schema)
    cells = _cells(csv_records(spark, path), [f"_{i}" for i in range(len(schema))])
    return cells.select([F.col(f"c._{i}").alias(f.name) for i, f in enumerate(schema)])


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with a header, typed by an explicit schema, missing-value strings as null."""
    cells = scan_csv_strings(spark, path, schema)
    return nan_to_null(cells.select([_typed(f) for f in schema]))


def scan_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return nan_to_null(df.select(*columns) if columns else df)


def scan_labelled_files(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = ARTICLE_SCHEMA,
    name_pattern: str = r"([^/]+)$",
) -> DataFrame:
    """All CSV files of a folder in one scan, with source and label taken from each file's name.

    ``name_pattern`` finds the name in the file's path. The source is its part before ``_``,
    the label is fake if the name contains "fake". An existing source or label is replaced.
    """
    kept = T.StructType([f for f in schema if f.name not in ("source", "label")])
    found = F.regexp_extract(F.url_decode(F.col("file")), name_pattern, 1)
    cells = _by_header(spark, path, kept, [found.alias("_name")], recursive=True)
    named = cells.select(*[_typed(f) for f in kept], "_name")
    return named.select(
        *[c for c in named.columns if c != "_name"],
        F.split_part("_name", F.lit("_"), F.lit(1)).alias("source"),
        F.when(F.contains("_name", F.lit("fake")), "fake").otherwise("real").alias("label"),
    )
