"""Repeated passages: bytes covered by a 50-byte string that also starts in an earlier document.

Suffixes are sorted only where they can matter. Every 50-byte window has an anchor gram that
depends on its bytes alone, and consecutive windows of one anchor form a span (``anchors``).

1. Texts are stored once, in compressed chunks, and never shuffled.
2. Each chunk sends its different spans as sorted, packed hashes, by gram. A span that equals one of
   an earlier document is covered as a whole. Where different spans of different documents share a
   gram, the first document of each goes on.
3. These send the suffixes that start at their anchors, as front-coded sorted runs, with the bytes
   left of the anchor. Runs are merged by loser trees that never compare a known prefix again; the
   common prefixes of neighbours tell which windows have equal right parts, hashes of the left bytes
   which have equal left parts, and the smallest document of equal windows covers the others.
4. Chunks apply both answers and drop the covered bytes.

Equal documents and frequent passages are one entry a chunk in step 2, and only a span's first
document reaches step 3, so no group of copies meets in one task. Equality of spans rests on 128
bits or more of hashes (gram and span), that of left parts on 64 bits within one gram and right
part.

Defined results: a null text is an empty text, with no bytes and no spans; a null doc_id counts as
the smallest; rows of equal doc_id do not cover each other; texts shorter than the window keep all
bytes; an empty table gives no rows; other columns are not read. Memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.anchors import GRAM, LENGTH, Spans
from newsgauge.llm.chunks import load_chunk, write_chunks
from newsgauge.llm.components import cells
from newsgauge.llm.merge import front_code, front_decode, merge_runs
from newsgauge.session import materialize

_LEAST = -(1 << 63)


class Chunk:
    """The spans of a chunk and its entries: its different spans, sorted by bucket, gram and hash.

    ``entry`` is the entry of each span, ``smallest`` the smallest document of each entry.
    """

    def __init__(self, file: str, number: int, buckets: int, length: int):
        self.ids, self.block = load_chunk(file, number)
        self.order = np.array([_LEAST if i is None else i for i in self.ids], dtype=np.int64)
        self.spans = spans = Spans(self.block, length, GRAM)
        bucket = (spans.gram_hash % np.uint64(buckets)).astype(np.int64)
        key = (spans.gram_hash >> np.uint64(32)).astype(np.uint32)
        self.doc = self.order[spans.text]
        sort = np.lexsort((self.doc, spans.span_hash, key, bucket))
        new = np.zeros(len(sort), dtype=bool)
        new[:1] = True
        for column in (bucket, key, spans.span_hash):
            part = column[sort]
            new[1:] |= part[1:] != part[:-1]
        self.entry = np.zeros(len(sort), dtype=np.int64)
        self.entry[sort] = np.cumsum(new) - 1
        first = sort[new]
        self.bucket, self.key, self.hash = bucket[first], key[first], spans.span_hash[first]
        self.smallest, self.text = self.doc[first], spans.text[first]
        self.begin = np.searchsorted(self.bucket, np.arange(buckets + 1))


def _planes(values: np.ndarray) -> bytes:
    """The bytes of integers, lowest byte of all first: small numbers compress to almost nothing."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(dtype).reshape(-1)


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _send_entries(buckets: int, length: int):
    """Per chunk and bucket: gram keys, span hashes and smallest documents, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row["file"], row["number"], buckets, length)
                rank = np.argsort(c.order, kind="stable")
                place = np.empty(len(rank), dtype=np.uint32)
                place[rank] = np.arange(len(rank))
                out = []
                for b in range(buckets):
                    lo, hi = c.begin[b], c.begin[b + 1]
                    if lo < hi:
                        mine, docs = np.unique(place[c.text[lo:hi]], return_inverse=True)
                        ids = c.order[rank[mine]]
                        out.append((
                            b, row["chunk"], _planes(_steps(c.key[lo:hi])),
                            _planes(c.hash[lo:hi]), _planes(docs.astype(np.uint32)),
                            _planes(_steps(ids)),
                        ))
                if out:
                    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, k) for v, k in zip(zip(*out), kinds)],
                        names=["bucket", "chunk", "keys", "hashes", "docs", "ids"],
                    )

    return run


def _answer_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tell chunks which entries an earlier document covers, and which go on."""
    for cell in cells(batches, ["bucket"]):
        rows = cell.to_pylist()
        keys = [np.cumsum(_unplanes(r["keys"], "<u4"), dtype=np.uint32) for r in rows]
        ids = [np.cumsum(_unplanes(r["ids"], "<i8")) for r in rows]
        doc = np.concatenate([i[_unplanes(r["docs"], "<u4")] for i, r in zip(ids, rows)])
        hashes = np.concatenate([_unplanes(r["hashes"], "<u8") for r in rows])
        counts = [len(k) for k in keys]
        key = np.concatenate(keys)
        source = np.repeat(np.arange(len(rows)), counts)
        place = np.concatenate([np.arange(n, dtype=np.uint32) for n in counts])

        sort = np.lexsort((doc, hashes, key))
        key, hashes, ordered = key[sort], hashes[sort], doc[sort]
        new_gram = np.ones(len(sort), dtype=bool)
        new_gram[1:] = key[1:] != key[:-1]
        new_span = new_gram.copy()
        new_span[1:] |= hashes[1:] != hashes[:-1]
        smallest = ordered[new_span][np.cumsum(new_span) - 1]
        # Of each gram: how many different spans, and the first documents they have.
        starts = np.flatnonzero(new_gram)
        gram = np.cumsum(new_gram) - 1
        different = np.add.reduceat(new_span.astype(np.int64), starts)
        low, high = np.minimum.reduceat(smallest, starts), np.maximum.reduceat(smallest, starts)
        goes_on = ((different > 1) & (low < high))[gram] & (ordered == smallest)
        told = (ordered > smallest) | goes_on
        back, smallest, goes_on = sort[told], smallest[told], goes_on[told]
        by_row = np.lexsort((place[back], source[back]))
        cuts = np.searchsorted(source[back][by_row], np.arange(len(rows) + 1))
        for i, row in enumerate(rows):
            mine = by_row[cuts[i] : cuts[i + 1]]
            if len(mine):
                yield _answer(row, place[back[mine]], smallest[mine], goes_on[mine])


def _answer(row: dict, place: np.ndarray, smallest: np.ndarray, goes_on: np.ndarray):
    """One row; places ascend."""
    return pa.RecordBatch.from_arrays(
        [pa.array([row["chunk"]]), pa.array([row["bucket"]], pa.int32()),
         pa.array([_planes(_steps(place))], pa.binary()),
         pa.array([_planes(smallest)], pa.binary()),
         pa.array([np.packbits(goes_on).tobytes()], pa.binary())],
        names=["chunk", "bucket", "places", "smallest", "goes_on"],
    )


_ANSWERS = "chunk long, bucket int, places binary, smallest binary, goes_on binary"


def _apply(chunk: Chunk, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of each entry in all chunks, and whether the entry goes on."""
    smallest = chunk.smallest.copy()
    goes_on = np.zeros(len(smallest), dtype=bool)
    for a in answers:
        places = np.cumsum(_unplanes(a["places"], "<u4"), dtype=np.int64)
        at = chunk.begin[a["bucket"]] + places
        smallest[at] = _unplanes(a["smallest"], "<i8")
        goes_on[at] = np.unpackbits(np.frombuffer(a["goes_on"], np.uint8))[: len(at)].astype(bool)
    return smallest, goes_on


def _send_suffixes(buckets: int, length: int):
    """Front-coded sorted runs of the anchored suffixes that go on, per chunk and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ["chunk"]):
            rows = cell.to_pylist()
            head = next(r for r in rows if r["file"] is not None)
            answers = [r for r in rows if r["file"] is None]
            if not answers:
                continue
            c = Chunk(head["file"], head["number"], buckets, length)
            smallest, goes_on = _apply(c, answers)
            chosen = np.flatnonzero(goes_on[c.entry] & (c.doc == smallest[c.entry]))
            text, spans = c.block.data.tobytes(), c.spans
            first, anchor, last = spans.first[chosen], spans.anchor[chosen], spans.last[chosen]
            end = last + length
            suffixes = [text[a:b] for a, b in zip(anchor.tolist(), end.tolist())]
            bucket = c.bucket[c.entry[chosen]].tolist()
            order = sorted(range(len(chosen)), key=lambda i: (bucket[i], suffixes[i]))
            lo = 0
            out = []
            while lo < len(order):
                hi = lo
                while hi < len(order) and bucket[order[hi]] == bucket[order[lo]]:
                    hi += 1
                mine = np.array(order[lo:hi])
                shared, rests = front_code([suffixes[i] for i in mine])
                lefts = [text[a:b] for a, b in zip(first[mine].tolist(), anchor[mine].tolist())]
                out.append((
                    bucket[order[lo]], head["chunk"], bytes(shared),
                    bytes(len(r) for r in rests), b"".join(rests), bytes(len(x) for x in lefts),
                    b"".join(lefts), _planes((anchor - first + last - first)[mine].astype(np.uint8)),
                    _planes(c.doc[chosen[mine]]), _planes(chosen[mine].astype(np.uint32)),
                ))
                lo = hi
            if out:
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 8]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=_RUN_COLUMNS
                )

    return run


_RUN_COLUMNS = ["bucket", "chunk", "shared", "rest_sizes", "rests", "left_sizes", "lefts",
                "windows", "docs", "spans"]
_RUNS = "bucket int, chunk long, " + ", ".join(f"{c} binary" for c in _RUN_COLUMNS[2:])


def _cut(data: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _merge_suffixes(length: int):
    """Merge the runs of a bucket and tell which windows an earlier document covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ["bucket"]):
            rows = cell.to_pylist()
            decoded = []
            for r in rows:
                shared = list(r["shared"])
                decoded.append((front_decode(shared, _cut(r["rests"], r["rest_sizes"])), shared))
            merged = np.array(list(merge_runs(decoded)), dtype=np.int64).reshape(-1, 3)
            begin = np.concatenate(([0], np.cumsum([len(d[0]) for d in decoded])))
            at = begin[merged[:, 0]] + merged[:, 1]
            known = merged[:, 2]
            doc = np.concatenate([_unplanes(r["docs"], "<i8") for r in rows])[at]
            left_size = np.concatenate([np.frombuffer(r["left_sizes"], np.uint8) for r in rows])
            lefts = [x for r in rows for x in _cut(r["lefts"], r["left_sizes"])]
            # Bytes left of the anchor, nearest first.
            matrix = np.zeros((len(at), length), dtype=np.uint8)
            for i, j in enumerate(at.tolist()):
                left = lefts[j]
                matrix[i, : len(left)] = np.frombuffer(left[::-1], np.uint8)
            reach = left_size[at].astype(np.int64)
            size = np.concatenate([np.frombuffer(r["windows"], np.uint8) for r in rows])[at]
            # ``windows`` holds left reach plus the number of windows less one.
            count = size.astype(np.int64) - reach + 1
            covered = _covered(known, doc, matrix, reach, count, length)

            some = np.flatnonzero(covered)
            source, span = merged[some, 0], np.concatenate(
                [_unplanes(r["spans"], "<u4") for r in rows]
            )[at[some]]
            for i in np.unique(source):
                mine = source == i
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[i]["chunk"]]), pa.array([_planes(span[mine])], pa.binary()),
                     pa.array([_planes(covered[some[mine]])], pa.binary())],
                    names=["chunk", "spans", "windows"],
                )

    return run


def _covered(
    known: np.ndarray,
    doc: np.ndarray,
    lefts: np.ndarray,
    reach: np.ndarray,
    count: np.ndarray,
    length: int,
) -> np.ndarray:
    """For suffixes in order, a bit for each window of their span that an earlier document has.

    A window with l bytes left of the anchor has ``length - l`` bytes from it. Suffixes agree on
    those if all common prefixes between them are as long, so equal right parts are stretches of
    the order; equal left parts have equal hashes of l bytes.
    """
    result = np.zeros(len(doc), dtype=np.uint64)
    hashes = np.zeros(len(doc), dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for left in range(0, int(reach.max(initial=-1)) + 1):
        if left:
            hashes = (hashes ^ (lefts[:, left - 1].astype(np.uint64) + np.uint64(1))) * factor
            hashes ^= hashes >> np.uint64(29)
        stretch = np.cumsum(known < length - left)
        offset = reach - left  # the window's number in its span
        valid = np.flatnonzero((offset >= 0) & (offset < count))
        sort = valid[np.lexsort((doc[valid], hashes[valid], stretch[valid]))]
        new = np.ones(len(sort), dtype=bool)
        new[1:] = (stretch[sort][1:] != stretch[sort][:-1]) | (
            hashes[sort][1:] != hashes[sort][:-1]
        )
        smallest = doc[sort][new][np.cumsum(new) - 1]
        hit = sort[doc[sort] > smallest]
        result[hit] |= np.uint64(1) << offset[hit].astype(np.uint64)
    return result


def _finish(buckets: int, length: int):
    """Drop the covered bytes of every text of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ["chunk"]):
            rows = cell.to_pylist()
            head = next(r for r in rows if r["file"] is not None)
            c = Chunk(head["file"], head["number"], buckets, length)
            smallest, _ = _apply(c, [r for r in rows if r["places"] is not None])
            marks = np.zeros(len(c.block.data) + 1, dtype=np.int32)
            whole = c.doc > smallest[c.entry]
            np.add.at(marks, c.spans.first[whole], 1)
            np.add.at(marks, c.spans.last[whole] + length, -1)
            for r in rows:
                if r["spans"] is not None:
                    at = c.spans.first[_unplanes(r["spans"], "<u4")]
                    bits = _unplanes(r["windows"], "<u8")
                    for k in range(64):
                        hit = at[(bits >> np.uint64(k)) & np.uint64(1) == 1] + k
                        np.add.at(marks, hit, 1)
                        np.add.at(marks, hit + length, -1)
            removed = np.cumsum(marks[:-1]) > 0
            starts, ends, first = c.block.runs(removed)
            offsets = c.block.offsets
            base = np.repeat(offsets[:-1], np.diff(first))
            spans = pa.ListArray.from_arrays(
                pa.array(first, pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(starts - base), pa.array(ends - base)], names=["start", "end"]
                ),
            )
            kept_bytes = c.block.data[~removed].tobytes()
            kept_at = np.concatenate(([0], np.cumsum(~removed)))[offsets].tolist()
            kept = [kept_bytes[a:b] for a, b in zip(kept_at, kept_at[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.ids, pa.int64()), pa.array(np.diff(offsets)), spans,
                 pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    return run


def _by(rows: DataFrame, key: str) -> DataFrame:
    """Rows together by key. The number of tasks is given, as small rows may name large chunks."""
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, F.col(key)).sortWithinPartitions(key)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, removed, kept``: the byte spans (start, end) that are dropped, maximal,
    and the bytes that are left."""
    spark = docs.sparkSession
    buckets = 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    manifest = write_chunks(docs)
    entries = _by(manifest, "chunk").mapInArrow(
        _send_entries(buckets, length),
        "bucket int, chunk long, keys binary, hashes binary, docs binary, ids binary",
    )
    answers = materialize(
        spark, _by(entries, "bucket").mapInArrow(_answer_entries, _ANSWERS), "answers"
    )
    asked = manifest.join(answers.select("chunk").distinct(), "chunk", "left_semi")
    runs = _by(answers.unionByName(asked, allowMissingColumns=True), "chunk").mapInArrow(
        _send_suffixes(buckets, length), _RUNS
    )
    windows = materialize(
        spark,
        _by(runs, "bucket").mapInArrow(
            _merge_suffixes(length), "chunk long, spans binary, windows binary"
        ),
        "windows",
    )
    told = manifest.unionByName(answers, allowMissingColumns=True).unionByName(
        windows, allowMissingColumns=True
    )
    return _by(told, "chunk").mapInArrow(
        _finish(buckets, length),
        "doc_id long, n_bytes long, removed array<struct<start long, end long>>, kept binary",
    )
