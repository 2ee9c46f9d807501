"""Records of CSV files with quoted line breaks, read by many tasks per file.

A quote may only stand in quoted cells, so that a line break is inside a cell if and only if an odd
number of quotes comes before it in the file. Each byte range of a file counts its quotes; an
exclusive prefix sum over the ranges of a file gives the state each one starts in; then every range
cuts its lines into records by itself. A record that crosses ranges leaves a piece in each, and only
these pieces are shuffled, to be put together in order. What goes to the tasks is the list of the
ranges that start inside a cell, at most one number per range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How a piece lies in its record, in the order of pieces within a range.
_WHOLE, _END, _MIDDLE, _START = 0, 1, 2, 3
_FIELDS = "file string, range long, kind int, first boolean, record string"
_SCHEMA = pa.schema(
    [("file", pa.string()), ("range", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()),
     ("record", pa.string())]
)
BATCH_CHARS = 1 << 20


def _lines(spark: SparkSession, path: str | Sequence[str], recursive: bool) -> DataFrame:
    # Lines end at line feeds only: a carriage return may be part of a cell.
    reader = spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n")
    paths = [path] if isinstance(path, str) else list(path)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        "value",
    )


def _inside(lines: DataFrame) -> dict[str, list[int]]:
    """Per file the byte ranges that start within a quoted cell."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    ranges = lines.groupBy("file", "range").agg(F.sum(quotes.cast("long")).alias("quotes"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    states = ranges.select(
        "file", "range",
        (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        (F.sum("quotes").over(Window.partitionBy("file")) % 2 == 1).alias("open"),
    ).where("inside or open")
    found: dict[str, list[int]] = {}
    for row in states.collect():
        if row["open"]:
            raise ValueError(f"{row['file']} has an odd number of quotes, so its records are unclear")
        found.setdefault(row["file"], []).append(row["range"])
    return found


def _cut(inside: dict[str, list[int]]):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                odd = pc.bit_wise_and(pc.count_substring(batch.column(2), '"'), 1)
                yield from zip(*(c.to_pylist() for c in (*batch.columns, odd)))

        for (file, start), lines in groupby(rows(), key=lambda row: row[:2]):
            within = start in inside.get(file, ())
            kind = _END if within else _WHOLE
            first = start == 0 and not within
            held: list[str] = []
            for _, _, line, odd in lines:
                held.append(line)
                within ^= bool(odd)
                if not within:
                    yield file, start, kind, first, "\n".join(held)
                    kind, first, held = _WHOLE, False, []
            if held:
                yield file, start, _MIDDLE if kind == _END else _START, first, "\n".join(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for piece in pieces(batches):
            held.append(piece)
            size += len(piece[-1]) + 64
            if size >= BATCH_CHARS:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def csv_records(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """``file, first, record``: every record that is not empty; ``first`` marks that of each file.

    Line breaks within cells are line feeds. A file with an odd number of quotes is an error.
    """
    lines = _lines(spark, path, recursive)
    pieces = lines.mapInArrow(_cut(_inside(lines)), _FIELDS)
    whole = pieces.where(F.col("kind") == _WHOLE).select("file", "first", "record")
    order = Window.partitionBy("file").orderBy("range", "kind")
    crossing = (
        pieces.where(F.col("kind") != _WHOLE)
        .withColumn("number", F.sum((F.col("kind") == _START).cast("int")).over(order))
        .groupBy("file", "number")
        .agg(
            F.max("first").alias("first"),
            F.array_sort(F.collect_list(F.struct("range", "kind", "record"))).alias("parts"),
        )
        .select("file", "first", F.array_join("parts.record", "\n").alias("record"))
    )
    record = F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    both = whole.unionByName(crossing)
    return both.select("file", "first", record.alias("record")).where("record <> ''")
