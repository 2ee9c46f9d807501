"""Texts in compressed chunk files in the shared folder, for jobs that read them several times.

A chunk is one record batch of an Arrow file. Chunks are found by file and number, so later passes
move only small rows that name a chunk, and each task loads the chunks it needs. Files are written
under a name of their own by every attempt of a task and count once the manifest row is committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.blocks import Block, blocks
from newsgauge.session import materialize, new_path

CHUNK_BYTES = 1 << 20
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, place = fs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        sink = out = None
        held: list[pa.RecordBatch] = []
        size = number = 0

        def flush() -> None:
            nonlocal held, size, number, sink, out
            if out is None:
                files.create_dir(place, recursive=True)
                sink = files.open_output_stream(f"{place}/{name}")
                options = pa.ipc.IpcWriteOptions(compression="zstd")
                out = pa.ipc.new_file(sink, _SCHEMA, options=options)
            out.write_batch(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, size, number = [], 0, number + 1

        for batch in batches:
            for rows, block in blocks(batch, limit=limit):
                held.append(rows.cast(_SCHEMA))
                size += len(block.data)
                if size >= limit:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + i for i in range(number)], pa.int64()),
                 pa.array([f"{folder}/{name}"] * number), pa.array(range(number), pa.int32())],
                names=["chunk", "file", "number"],
            )

    return run


def write_chunks(docs: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """Store ``doc_id, text``; returns the manifest ``chunk, file, number``. A null text is empty."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    written = rows.mapInArrow(
        _write(new_path(spark, "chunks"), limit), "chunk long, file string, number int"
    )
    return materialize(spark, written, "manifest")


def load_chunk(file: str, number: int) -> tuple[list, Block]:
    """The doc_ids and texts of a chunk."""
    files, path = fs.FileSystem.from_uri(file)
    with files.open_input_file(path) as source:
        batch = pa.ipc.open_file(source).get_batch(number)
    ((_, block),) = blocks(batch, limit=1 << 62)
    return batch.column(0).to_pylist(), block
