"""First-fit decreasing packing with a tournament tree of bin capacities, in randomised groups.

Every document is its ids and an end id. Its whole sequences are cut off the front; the rest, which
is shorter than a sequence, is what has to be packed. Documents are dealt to groups at random, so
that each group sees the lengths of the whole table, whatever the order or the hot keys of its rows.
A group is packed by one task: its rests, longest first, go to the first bin with room. The bins are
the leaves of a tournament tree whose inner nodes hold the largest room below them, so that a bin is
found in as many steps as the tree has levels. Bins that are left with a gap are then filled up from
the emptiest bins, whose pieces may be cut for it; what a group has left in the end goes to
sequences of a power of two of ids, which need no padding either.

A group has about ``GROUP_BYTES`` of text (one text may be longer); the number of groups grows with
the table, and neither texts nor lengths of more than one group meet. Texts are shuffled once.

Defined results: a null text is an empty text, one piece of the end id alone; repeated rows are
packed each on its own; a null doc_id stays null; an empty table gives no rows; other columns are
not read. Sequence ids are unique, with gaps between groups.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.blocks import blocks
from newsgauge.llm.tokens import encoder

SIZE = 2048
END_ID = 1
GROUP_BYTES = 16 << 20
ROW_BYTES = 64  # what a row counts for besides its text
SEED = 13
SEQUENCES_PER_GROUP = 1 << 40

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
Piece = tuple[int, int, int]  # document, start, length


class TournamentTree:
    """Rooms of ``bins`` empty bins; finds the first bin with enough room."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """Take ``length`` from the first bin that has it, and return the bin's number."""
        room = self.room
        if room[1] < length:
            raise ValueError(f"no bin has room for {length}")
        at = 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        room[at] -= length
        number = at - self.leaves
        while at > 1:
            at //= 2
            largest = max(room[2 * at], room[2 * at + 1])
            if room[at] == largest:
                break
            room[at] = largest
        return number


def first_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Numbers of the items in each bin; items go longest first, ties in the given order."""
    tree = TournamentTree(len(lengths), size)
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        number = tree.place(lengths[item])
        if number == len(bins):
            bins.append([])
        bins[number].append(item)
    return bins


def _take(pieces: list[Piece], wanted: int) -> list[Piece]:
    """Move ``wanted`` ids from the end of a list of pieces, cutting one at most."""
    taken = []
    while wanted:
        document, start, length = pieces.pop()
        if length > wanted:
            pieces.append((document, start, length - wanted))
            start, length = start + length - wanted, wanted
        taken.append((document, start, length))
        wanted -= length
    return taken


def fill_gaps(bins: list[list[Piece]], size: int) -> list[list[Piece]]:
    """The same ids in bins that are full, but for powers of two at the end.

    The fullest of the bins with a gap is filled up first, from the emptiest ones.
    """
    held = [sum(length for _, _, length in pieces) for pieces in bins]
    full = [pieces for pieces, n in zip(bins, held) if n == size]
    order = sorted((i for i, n in enumerate(held) if n < size), key=lambda i: -held[i])
    first, last = 0, len(order) - 1
    while first < last:
        filled, emptied = order[first], order[last]
        moved = min(size - held[filled], held[emptied])
        bins[filled].extend(_take(bins[emptied], moved))
        held[filled] += moved
        held[emptied] -= moved
        if held[filled] == size:
            full.append(bins[filled])
            first += 1
        if not held[emptied]:
            last -= 1
    for i in order[first : last + 1]:
        full += [_take(bins[i], 1 << b) for b in range(size.bit_length()) if held[i] >> b & 1]
    return full


def pack_group(tokens: list[int], size: int) -> list[list[Piece]]:
    """Sequences of (document, start, length) for documents of so many tokens."""
    whole = [[(i, at, size)] for i, n in enumerate(tokens) for at in range(0, n - size + 1, size)]
    rests = [(i, n - n % size, n % size) for i, n in enumerate(tokens) if n % size]
    bins = first_fit_decreasing([length for _, _, length in rests], size)
    return whole + fill_gaps([[rests[k] for k in members] for members in bins], size)


def _pack(path: str, size: int, end_id: int, with_ids: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # One order of rows, however the group's rows arrive.
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        encode = encoder(path).encode
        ids: list[np.ndarray] = []
        for batch in table.to_batches():
            for rows, _ in blocks(batch):
                ids += [np.append(i, end_id) for i in encode(rows.column(1).to_pylist())]
        doc_ids = table.column("doc_id").to_pylist()
        first = key[0].as_py() * SEQUENCES_PER_GROUP
        out: list[tuple] = []
        for number, pieces in enumerate(pack_group([len(i) for i in ids], size)):
            offset = 0
            for i, start, length in pieces:
                data = ids[i][start : start + length].astype("<u4").tobytes()
                crc = zlib.crc32(data)
                row = (doc_ids[i], start, length, crc, len(ids[i]), first + number, offset)
                out.append((*row, data) if with_ids else row)
                offset += length
        schema = pa.schema([(n, pa.int64()) for n in COLUMNS])
        if with_ids:
            schema = schema.append(pa.field("ids", pa.binary()))
        columns = list(zip(*out)) or [[] for _ in schema]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def packed_pieces(
    docs: DataFrame,
    path: str,
    size: int = SIZE,
    end_id: int = END_ID,
    with_ids: bool = True,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    ``with_ids`` adds ``ids``, little-endian 32-bit, from which ``packing.sequences`` makes rows.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    weight = F.sum(F.octet_length("text") + F.lit(ROW_BYTES))
    groups = -(-(texts.agg(weight).first()[0] or 0) // group_bytes) or 1
    dealt = texts.withColumn("group", F.floor(F.rand(SEED) * groups).cast("long"))
    fields = ", ".join(f"{n} long" for n in COLUMNS) + (", ids binary" if with_ids else "")
    return dealt.groupBy("group").applyInArrow(_pack(path, size, end_id, with_ids), fields)
