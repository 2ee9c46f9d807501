"""Best-fit packing of token pieces into sequences of a fixed size, by exact complements.

Every document is its ids and an end id. Longer ones are cut from the back, so that only the first
piece may be shorter than a sequence. What to pack is decided on the number of pieces of each
length, a table of at most ``size`` rows: lengths that fill a gap exactly, alone, as a pair or as a
triple, are consumed together as often as their counts allow; best fit places what is left. Of the
plans with triples, with pairs and with single complements only, the best one counts. It has a
few thousand entries at most, whatever the number of documents. Tasks then number the pieces of
each length (in salted groups, so that a frequent length is spread) and look their number up in it.

Defined results: a null text is an empty text, one piece of the end id alone; repeated rows are
packed each on its own; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.llm.blocks import blocks
from newsgauge.llm.tokens import encoder
from newsgauge.session import materialize

SIZE = 1024
END_ID = 2
GROUP_ROWS = 20_000


def cuts(tokens: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be shorter than size."""
    first = (tokens - 1) % size + 1
    return [(0, first), *((at, size) for at in range(first, tokens, size))]


def _cut(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for rows, _ in blocks(batch):
                doc_ids = rows.column(0).to_pylist()
                out: list[tuple] = []
                for doc_id, ids in zip(doc_ids, encode(rows.column(1).to_pylist())):
                    wide = np.append(ids, end_id).astype("<u4")
                    for piece, (start, length) in enumerate(cuts(len(wide), size)):
                        data = wide[start : start + length].tobytes()
                        out.append((doc_id, piece, start, length, zlib.crc32(data), data))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in columns[2:5]),
                     pa.array(columns[5], pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return run


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids`` (little-endian 32-bit) of every document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).mapInArrow(
        _cut(path, size, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary",
    )


class _Counts:
    """How many pieces of each length are left, and the combinations taken so far."""

    def __init__(self, counts: np.ndarray):
        self.left = counts
        self.taken: list[tuple[tuple[int, ...], int]] = []

    def available(self, members: tuple[int, ...]) -> int:
        return min(int(self.left[m]) // members.count(m) for m in set(members))

    def take(self, members: tuple[int, ...]) -> int:
        n = self.available(members)
        if n:
            for m in members:
                self.left[m] -= n
            self.taken.append((tuple(sorted(members, reverse=True)), n))
        return n


def _pairs_with_sum(counts: _Counts, total: int, reserved: int) -> list[tuple[int, int]]:
    """Pairs of available lengths that add up to ``total``, most available first."""
    a = np.arange((total + 1) // 2, total)
    b = total - a
    left = counts.left.copy()
    left[reserved] -= 1
    room = np.where(a == b, left[a] // 2, np.minimum(left[a], left[b]))
    best = np.argsort(-room, kind="stable")
    return [(int(a[i]), int(b[i])) for i in best[:4] if room[i] > 0]


def _complement(counts: _Counts, length: int, size: int, most: int) -> tuple[int, ...] | None:
    """Up to ``most`` (three at most) available lengths that fill the gap beside a piece exactly."""
    gap = size - length
    if counts.available((length, gap)):
        return (gap,)
    if most > 1:
        for pair in _pairs_with_sum(counts, gap, length):
            if counts.available((length, *pair)):
                return pair
    for third in range(gap - 2, 0, -1) if most > 2 else ():
        if counts.available((length, third)):
            for pair in _pairs_with_sum(counts, gap - third, length):
                if counts.available((length, third, *pair)):
                    return (third, *pair)
    return None


def _planned(left: np.ndarray, size: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    counts = _Counts(left)
    counts.take((size,))
    for length in range(size - 1, 0, -1):
        while left[length]:
            rest = _complement(counts, length, size, most)
            if rest is None or not counts.take((length, *rest)):
                break
    for length in range(size, 0, -1):
        while left[length]:
            members, gap = (length,), size - length
            while gap:
                fits = np.flatnonzero(left[1 : gap + 1] > 0)[::-1] + 1
                more = next((int(m) for m in fits if counts.available((*members, int(m)))), None)
                if more is None:
                    break
                members, gap = (*members, more), gap - more
            counts.take(members)
    return counts.taken


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how many sequences hold each; all pieces are placed.

    Triples use up short pieces that best fit may need more, so complements of up to three, two
    and one pieces are tried, and the plan with the fewest sequences is taken.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    plans = [_planned(left.copy(), size, most) for most in (3, 2, 1)]
    return min(plans, key=lambda taken: sum(n for _, n in taken))


def _lookup(taken: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, ...]:
    """For each length the ranges of its numbers: sorted keys, first sequence, place."""
    used = np.zeros(size + 1, dtype=np.int64)
    rows, sequence = [], 0
    for members, n in taken:
        offset = 0
        for m in members:
            rows.append((m, used[m], sequence, offset))
            used[m] += n
            offset += m
        sequence += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def _place(taken: list[tuple[tuple[int, ...], int]], size: int):
    lengths, firsts, sequences, offsets = _lookup(taken, size)
    begin = np.searchsorted(lengths, np.arange(size + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column(batch.schema.get_field_index("length")))
            number = np.asarray(batch.column(batch.schema.get_field_index("number")))
            at = np.zeros(len(length), dtype=np.int64)
            for m in np.unique(length):
                mine = length == m
                ranges = firsts[begin[m] : begin[m + 1]]
                at[mine] = begin[m] + np.searchsorted(ranges, number[mine], "right") - 1
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequences[at] + number - firsts[at]), pa.array(offsets[at])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return run


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces, read a few times.

    Pieces of one length are numbered in groups of about ``GROUP_ROWS`` by a hash of their
    document; the groups of a length follow each other.
    """
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    taken = plan(histogram, size)
    groups = -(-sum(histogram.values()) // GROUP_ROWS) or 1
    salted = cut.withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int")
    )
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        "length", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    numbered = (
        salted.withColumn("place", F.row_number().over(within))
        .join(bases, ["length", "salt"])
        .select(*cut.columns, (F.col("base") + F.col("place") - 1).alias("number"))
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return numbered.mapInArrow(_place(taken, size), f"{fields}, sequence_id long, offset long")


def packed_documents(
    docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    cut = pieces(docs, path, size, end_id).drop("ids")
    return pack(materialize(docs.sparkSession, cut, "pieces"), size)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [b"".join(p["ids"] for p in sorted(r, key=lambda p: p["offset"]))
                for r in batch.column(1).to_pylist()]
        ids = [np.frombuffer(r, dtype="<u4").astype(np.int64) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["sequence_id", "ids"]
        )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from packed pieces that still have their ids: the training rows."""
    parts = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("p"))
    return parts.mapInArrow(_assemble, "sequence_id long, ids array<long>")
