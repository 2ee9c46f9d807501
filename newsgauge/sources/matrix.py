"""Matrix files by rows: a folder of raw row-major 32-bit floats, read and written by many tasks.

A folder holds one ``<part>.f32`` (rows of ``width`` floats, as ``numpy.memmap`` opens them) and one
``<part>.ids`` (64-bit keys of the rows) for each writing task, and ``manifest.json``, which lists the
parts in row order. The manifest is written when all tasks are done, so a reader sees a whole matrix or
the one before, and files of lost or repeated tasks are not listed. A reader's task opens its own range
of rows only.

Defined results: a null vector is a row of NaN, and comes back as null; a vector of another width, a null
within a vector or a null key is an error; an empty table is a matrix without rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from newsgauge.sources.files import open_place

FORMAT = "matrix_rows"
SCHEMA = "row bigint, article_id bigint, embedding array<float>"
TASK_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
_FLOAT, _KEY = 4, 8


@dataclass(frozen=True)
class Manifest:
    """Parts are pairs of a file's name and its number of rows, in row order."""

    width: int
    parts: tuple[tuple[str, int], ...]

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.parts)

    @classmethod
    def read(cls, path: str) -> Manifest | None:
        files, place = open_place(path)
        try:
            with files.open_input_file(f"{place}/manifest.json") as source:
                held = json.loads(source.read())
        except FileNotFoundError:
            return None
        return cls(held["width"], tuple((name, n) for name, n in held["parts"]))

    def write(self, path: str) -> None:
        files, place = open_place(path)
        files.create_dir(place, recursive=True)
        fresh = f"{place}/manifest-{uuid.uuid4().hex}"
        with files.open_output_stream(fresh) as sink:
            sink.write(json.dumps({"width": self.width, "parts": self.parts}).encode())
        files.move(fresh, f"{place}/manifest.json")


@dataclass
class RowRange(InputPartition):
    """Rows ``start`` to ``stop`` of a part, whose first row is row ``first`` of the matrix."""

    part: str
    first: int
    start: int
    stop: int


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes
        found = Manifest.read(path)
        if found is None:
            raise FileNotFoundError(f"no matrix at {path}")
        self.manifest = found

    def partitions(self) -> list[RowRange]:
        step = max(1, self.task_bytes // max(1, self.manifest.width * _FLOAT))
        ranges, first = [], 0
        for part, rows in self.manifest.parts:
            ranges += [RowRange(part, first, at, min(at + step, rows)) for at in range(0, rows, step)]
            first += rows
        return ranges

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands over where there are no ranges
            return
        files, place = open_place(self.path)
        width = self.manifest.width
        step = max(1, BATCH_BYTES // max(1, width * _FLOAT))
        with (
            files.open_input_file(f"{place}/{partition.part}.f32") as values,
            files.open_input_file(f"{place}/{partition.part}.ids") as keys,
        ):
            for at in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - at)
                floats = np.frombuffer(values.read_at(n * width * _FLOAT, at * width * _FLOAT), "<f4")
                ids = np.frombuffer(keys.read_at(n * _KEY, at * _KEY), "<i8")
                missing = np.isnan(floats.reshape(n, width)).all(axis=1) if width else np.ones(n, bool)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width, mask=np.append(missing, False))
                first = partition.first + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + n)), pa.array(ids),
                     pa.ListArray.from_arrays(offsets, pa.array(floats))],
                    names=["row", "article_id", "embedding"],
                )


@dataclass
class Written(WriterCommitMessage):
    partition: int
    part: str
    rows: int


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, overwrite: bool):
        self.path, self.width, self.overwrite = path, width, overwrite

    def _floats(self, vectors: pa.Array) -> np.ndarray:
        out = np.full((len(vectors), self.width), np.nan, dtype="<f4")
        present = np.flatnonzero(np.asarray(vectors.is_valid()))
        flat = vectors.flatten()  # leaves null vectors out
        sizes = np.asarray(vectors.value_lengths().drop_null())
        if (sizes != self.width).any() or flat.null_count:
            raise ValueError(f"a vector does not have {self.width} numbers")
        out[present] = np.asarray(flat).reshape(len(present), self.width)
        return out

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        part = f"part-{number:06d}-{uuid.uuid4().hex}"
        files, place = open_place(self.path)
        files.create_dir(place, recursive=True)
        rows = 0
        with (
            files.open_output_stream(f"{place}/{part}.f32") as values,
            files.open_output_stream(f"{place}/{part}.ids") as keys,
        ):
            for batch in iterator:
                ids = batch.column(0)
                if ids.null_count:
                    raise ValueError("a row of a matrix has no key")
                values.write(self._floats(batch.column(1)).tobytes())
                keys.write(np.asarray(ids).astype("<i8").tobytes())
                rows += batch.num_rows
        return Written(number, part, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fresh = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        before = None if self.overwrite else Manifest.read(self.path)
        parts = tuple((m.part, m.rows) for m in fresh)
        if before is not None and before.rows:
            if before.width != self.width and parts:
                raise ValueError(f"the matrix has rows of {before.width} numbers, not {self.width}")
            Manifest(before.width, before.parts + parts).write(self.path)
        else:
            Manifest(self.width, parts).write(self.path)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to undo: files that no manifest lists belong to no matrix."""


class MatrixSource(DataSource):
    """``spark.read.format(FORMAT).load(path)`` and its counterpart, once registered."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], int(self.options["width"]), overwrite)


def sink_matrix(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors ``article_id, embedding`` as rows in order of their key; ``append`` puts them behind.

    A sort by ranges deals the rows out, so each task writes consecutive rows.
    """
    spark = df.sparkSession
    vectors = df.select(
        F.col("article_id").cast("bigint").alias("article_id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    spark.dataSource.register(MatrixSource)
    ordered = vectors.orderBy("article_id", "embedding")
    ordered.write.format(FORMAT).mode(mode).option("width", max(width or 0, 0)).save(path)


def scan_matrix(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``row, article_id, embedding``: dense row numbers from 0, in tasks of about ``task_bytes``."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format(FORMAT).option("task_bytes", task_bytes).load(path)


def matrix_shape(path: str) -> tuple[int, int]:
    """Rows and width, from the manifest alone."""
    found = Manifest.read(path)
    if found is None:
        raise FileNotFoundError(f"no matrix at {path}")
    return found.rows, found.width
