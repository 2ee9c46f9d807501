"""Texts as flat numpy arrays: the vectorised core of the operators that work inside tasks.

An Arrow batch is cut into blocks of a bounded number of bytes (one text may be longer), and a
block is one ``uint8`` array of UTF-8 with the offsets of its texts. Words, lines and k-grams are
spans of that array; their 64-bit hashes come from prefix sums, so no loop runs over characters
in Python. A null text counts as empty.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a copy: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def kept(name: str, make: Callable[[], object]) -> object:
    """A value made once in a worker process, for all its tasks.

    Functions travel to the workers by value, with the globals of their module; what is kept here
    stays where it was made.
    """
    store = sys.modules.setdefault("_kept_values", types.ModuleType("_kept_values")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def _byte_values() -> np.ndarray:
    base = np.uint64(_BASE)
    return kept("byte values", lambda: mix(np.arange(1, 257, dtype=np.uint64) * base))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    # Two sizes do for nearly all blocks.
    size = next((s for s in (1 << 14, 1 << 21) if n <= s), 1 << (n - 1).bit_length())

    def powers(factor: int) -> np.ndarray:
        steps = np.full(size, factor, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return kept(f"powers {size}", lambda: (powers(_BASE), powers(pow(_BASE, -1, 1 << 64))))


class Block:
    """Texts of consecutive rows: ``data`` (uint8), ``offsets`` (len(texts) + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.offsets = offsets
        self._sums: np.ndarray | None = None

    @staticmethod
    def of(texts: list[str | None]) -> Block:
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        offsets = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return Block(np.frombuffer(b"".join(parts), dtype=np.uint8), offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span; equal bytes have equal hashes anywhere."""
        n = len(self.data)
        up, down = power_tables(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_byte_values()[self.data] * up[:n], out=self._sums[1:])
        value = (self._sums[ends] - self._sums[starts]) * down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes, cut between texts: starts, ends, and the number of the
        first run of each text (len(texts) + 1)."""
        n = len(inside)
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before[self.offsets[:-1][self.offsets[:-1] < n]] = False
            after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes that are no ASCII white space."""
        return self.runs(~_WHITE[self.data])


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(
    batch: pa.RecordBatch, name: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Cut a batch into slices of about ``limit`` bytes of text, each with its block."""
    if not batch.num_rows:
        return
    column = text_column(batch, name)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        part = offsets[first : last + 1]
        yield batch.slice(first, last - first), Block(data[part[0] : part[-1]], part - part[0])
        first = last


def owners(first: np.ndarray) -> np.ndarray:
    """The text number of each item, from the first item of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_STEPS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
          0x85EBCA77C2B2AE63]


def window_hashes(
    hashes: np.ndarray, first: np.ndarray, width: int, short: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of a text.

    Returns the hashes, the word number at which each window starts, and the first window of each
    text. With ``short``, a text of 1 to ``width - 1`` words has one window of all its words.
    """
    counts = np.diff(first)
    windows = np.maximum(counts - width + 1, 0)
    if short:
        windows = np.where((counts > 0) & (windows == 0), 1, windows)
    begin = np.concatenate(([0], np.cumsum(windows)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], windows)
    size = np.repeat(np.minimum(counts, width), windows)
    padded = np.concatenate((hashes, np.zeros(width, dtype=np.uint64)))
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        term = padded[at + k] * np.uint64(_STEPS[k % len(_STEPS)] + 2 * (k // len(_STEPS)))
        if short and k:
            term[size <= k] = 0
        total += term
    if short:
        total += size.astype(np.uint64)
    return mix(total), at, begin


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a block, and the first one of each text."""
    starts, ends, first = block.words()
    hashes, _, begin = window_hashes(block.span_hashes(starts, ends), first, width, short=True)
    return hashes, begin


def distinct_per_text(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text's hashes, sorted, and the first one of each text."""
    text = owners(first)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(first)))
