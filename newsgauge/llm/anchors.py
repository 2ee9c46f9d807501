"""Anchored windows: which 50-byte strings of a text meet at which of its 20-byte grams.

Every window of ``LENGTH`` bytes has one anchor, the leftmost of its grams with the smallest hash.
It depends on the bytes of the window alone, so equal windows have the same anchor at the same
place. Consecutive windows with one anchor form a span; there is about one span for 16 bytes.
"""

from __future__ import annotations

import numpy as np

from newsgauge.llm.blocks import Block

LENGTH = 50
GRAM = 20


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by doubling."""
    have, result = 1, values
    while have * 2 <= width:
        result = np.minimum(result[:-have], result[have:])
        have *= 2
    if have < width:
        rest = width - have
        result = np.minimum(result[:-rest], result[rest:])
    return result


class Spans:
    """The spans of a block: anchor, first and last window, text number, and two hashes."""

    def __init__(self, block: Block, length: int = LENGTH, gram: int = GRAM):
        self.block = block
        n, width = len(block.data), length - gram + 1
        sizes = np.diff(block.offsets)
        counts = np.maximum(sizes - length + 1, 0)
        if n < length or not counts.any():
            empty = np.zeros(0, dtype=np.int64)
            self.anchor = self.first = self.last = self.text = empty
            self.gram_hash = self.span_hash = np.zeros(0, dtype=np.uint64)
            return
        starts = np.arange(n - gram + 1)
        hashes = block.span_hashes(starts, starts + gram)
        # The place in the low half makes the leftmost of equal hashes the smallest.
        keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64)
        least = sliding_minimum(keyed, width)
        text = np.repeat(np.arange(len(block)), counts)
        begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
        windows = np.arange(len(text)) - np.repeat(begin - block.offsets[:-1], counts)
        anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(windows), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        self.anchor, self.text, self.first = anchor[at], text[at], windows[at]
        self.last = windows[np.append(at[1:], len(windows)) - 1]
        self.gram_hash = hashes[self.anchor]
        self.span_hash = block.span_hashes(self.first, self.last + length)

    def __len__(self) -> int:
        return len(self.anchor)
