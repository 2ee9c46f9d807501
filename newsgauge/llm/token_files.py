"""Token files: Arrow files of fixed-size-list batches, with random access to their rows.

All documents in ascending doc_id order are one stream of ids, each ended by the end id. A range
of documents goes to one file pair in the shared folder. ``<name>.arrow`` holds rows of ``ids`` and
``mask`` (bits), fixed-size lists of one length; only the last row of a file is padded, mask unset. As
every row and every batch but the last has one size, a row is found by arithmetic and read without
copying from the memory-mapped file. ``<name>.index.arrow`` lists doc_id, first id and number of ids.

A file is written under a name of its own by each attempt of a task and counts only once the
task's manifest row is committed, so a lost executor leaves unused files at worst.

Defined results: a null text is an empty text, with the end id alone; null doc_ids come first;
repeated rows are written each; equal doc_ids follow each other by text; an empty table gives no
files. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgauge.llm.blocks import blocks
from newsgauge.llm.tokens import encoder
from newsgauge.session import materialize, new_path

LENGTH = 1024
BATCH_ROWS = 256
END_ID = 1

MANIFEST = pa.schema([
    ("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()),
])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path: a plain path, file:, hdfs: or an object store."""
    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Writes a stream of ids as rows of one length."""

    def __init__(self, uri: str, dtype: pa.DataType):
        self.files, self.path = _open(uri)
        self.schema = pa.schema([
            ("ids", pa.list_(dtype, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH)),
        ])
        self.sink = self.files.open_output_stream(f"{self.path}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0
        self.index: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= LENGTH * BATCH_ROWS:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.held)
        block = LENGTH * BATCH_ROWS
        end = len(ids) if last else len(ids) // block * block
        for at in range(0, end, block):
            part = ids[at : min(at + block, end)]
            rows = -(-len(part) // LENGTH)
            padded = np.zeros(rows * LENGTH, dtype=ids.dtype)
            padded[: len(part)] = part
            mask = np.arange(rows * LENGTH) < len(part)
            self.out.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(padded), LENGTH),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), LENGTH)],
                schema=self.schema,
            ))
        self.held = [ids[end:]]
        self.size = len(ids) - end

    def close(self) -> None:
        if self.size:
            self._write(last=True)
        self.out.close()
        self.sink.close()
        columns = list(zip(*self.index))
        table = pa.table({
            name: pa.array(column, pa.int64())
            for name, column in zip(("doc_id", "first", "n_tokens"), columns)
        })
        with self.files.open_output_stream(f"{self.path}.index.arrow") as sink:
            with pa.ipc.new_file(sink, table.schema) as out:
                out.write_table(table)


class TokenFile:
    """Random access to a written file; rows are views of the mapped or loaded buffers."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.reader = pa.ipc.open_file(self._source(files, f"{path}.arrow"))
        self.index = pa.ipc.open_file(self._source(files, f"{path}.index.arrow")).read_all()

    @staticmethod
    def _source(files: fs.FileSystem, path: str):
        if isinstance(files, fs.LocalFileSystem):
            return pa.memory_map(path)
        return files.open_input_file(path)

    def _flat(self, batch: int) -> np.ndarray:
        return self.reader.get_batch(batch).column(0).flatten().to_numpy()

    def sequence(self, row: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one row, both views of the file; the mask is a bitmap."""
        batch, at = divmod(row, BATCH_ROWS)
        lo = at * LENGTH
        mask = self.reader.get_batch(batch).column(1).flatten()
        return self._flat(batch)[lo : lo + LENGTH], mask.slice(lo, LENGTH)

    def ids(self, first: int, count: int) -> np.ndarray:
        """A range of the file's ids."""
        block = LENGTH * BATCH_ROWS
        parts = []
        while count:
            batch, at = divmod(first, block)
            part = self._flat(batch)[at : at + count]
            parts.append(part)
            first, count = first + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        part = TaskContext.get().partitionId()
        writer = uri = None
        end = np.array([end_id], dtype=coder.dtype)
        for batch in batches:
            for rows, _ in blocks(batch):
                if writer is None:
                    files, place = _open(folder)
                    files.create_dir(place, recursive=True)
                    uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
                    writer = _Writer(uri, pa.from_numpy_dtype(coder.dtype))
                doc_ids = rows.column(0).to_pylist()
                for doc_id, ids in zip(doc_ids, coder.encode(rows.column(1).to_pylist())):
                    writer.add(doc_id, np.concatenate((ids, end)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in
                 zip((part, uri, len(writer.index), writer.tokens), MANIFEST)],
                schema=MANIFEST,
            )

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents; returns the manifest ``part, file, documents, tokens, base``.

    ``base`` is the number of ids in all files before; files follow each other by ``part``.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    manifest = materialize(
        spark,
        rows.repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(
            _write(new_path(spark, "tokens"), path, end_id),
            "part int, file string, documents long, tokens long",
        ),
        "manifest",
    )
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for entry in batch.to_pylist():
            tokens = TokenFile(entry["file"])
            for part in tokens.index.to_batches(max_chunksize=4096):
                first, count = (np.asarray(part.column(c)) for c in (1, 2))
                sums = [
                    zlib.crc32(tokens.ids(int(a), int(n)).astype("<u4").tobytes())
                    for a, n in zip(first, count)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(first + entry["base"]), part.column(2),
                     pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (
        manifest.select("file", "base")
        .repartition(files)
        .mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
