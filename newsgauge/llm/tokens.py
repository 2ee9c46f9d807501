"""Token ids of whole texts by a public tokenizer file, fast enough for a whole corpus.

Both supported vocabularies split a text into pieces by a pattern and merge within pieces only, so
the ids of a text are the ids of its pieces. Piece borders of many texts are found at once in
numpy; each distinct piece goes to the ``tokenizers`` library once per worker, and is looked up by
a 64-bit hash afterwards. Texts with characters whose class may depend on the Unicode version
(unassigned ones) are handed to the library whole.

Special tokens in a text are ordinary text; none are added.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from newsgauge.llm.blocks import kept, mix, power_tables

_OTHER, _LETTER, _NUMBER, _WHITE, _DOUBT = 0, 1, 2, 3, 4
CACHE_PIECES = 1_500_000

# Unicode white space.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
           0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    return kept("character classes", _class_table)


def _class_table() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    category = unicodedata.category
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        name = category(chr(c))
        table[c] = _DOUBT if name == "Cn" else kind.get(name[0], _OTHER)
    table[_SPACES] = _WHITE
    return table


def _character_values() -> np.ndarray:
    step = np.uint64(0x9E3779B97F4A7C15)
    return kept("character values", lambda: mix(np.arange(1, 0x110001, dtype=np.uint64) * step))


def _marks(codes: np.ndarray, kinds: np.ndarray, opens: np.ndarray, spaced: bool) -> np.ndarray:
    """Where pieces start, white space included.

    ``opens`` marks the first character of each text. With ``spaced`` a space belongs to the piece
    after it, and white space before another piece keeps its last character apart.
    """
    n = len(codes)
    begins = opens.copy()
    begins[1:] |= kinds[1:] != kinds[:-1]
    same = ~opens  # the character before belongs to the same text
    before = np.zeros(n, dtype=np.uint32)
    before[1:] = codes[:-1]
    solid = kinds != _WHITE
    starts = begins.copy()
    if spaced:
        joined = solid & begins & same & (before == 0x20)
        starts[joined] = False
        after_white = np.zeros(n, dtype=bool)
        after_white[1:] = solid[1:] & ~solid[:-1] & same[1:]
        starts[np.flatnonzero(after_white) - 1] = True
    else:
        starts |= kinds == _NUMBER

    # An apostrophe that is a piece of its own takes s, t, m, d, re, ve or ll after it.
    quote = np.flatnonzero((codes == 0x27) & begins & (starts if spaced else True))
    quote = quote[quote + 1 < n]
    quote = quote[(kinds[quote + 1] == _LETTER) & same[quote + 1]]
    one = codes[quote + 1]
    two = np.where(quote + 2 < n, codes[np.minimum(quote + 2, n - 1)], 0)
    two = np.where((quote + 2 < n) & same[np.minimum(quote + 2, n - 1)], two, 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
    long |= (one == ord("l")) & (two == ord("l"))
    taken = short | long
    quote, size = quote[taken], np.where(short[taken], 2, 3)
    starts[quote + 1] = False
    rest = quote + size
    rest = rest[rest < n]
    starts[rest[(kinds[rest] == _LETTER) & same[rest]]] = True
    return starts


class Encoder:
    """Ids of texts; one per worker and vocabulary, with a bounded cache of pieces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lower = self.tokenizer.normalizer is not None
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=self.dtype)

    def _normal(self, text: str) -> str:
        if not self.lower:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Add pieces to the cache; ``hashes`` are sorted."""
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        ids = [e.ids for e in found]
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        at = len(self.pool) + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.pool = np.concatenate((self.pool, np.array([x for i in ids for x in i], self.dtype)))
        where = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, where, hashes)
        self.at = np.insert(self.at, where, at)
        self.sizes = np.insert(self.sizes, where, sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        texts = [self._normal(t) for t in texts]
        joined = "".join(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        n = len(codes)
        if not n:
            return [np.zeros(0, dtype=self.dtype) for _ in texts]
        kinds = _classes()[codes]
        opens = np.zeros(n, dtype=bool)
        opens[offsets[:-1][lengths > 0]] = True

        starts = np.flatnonzero(_marks(codes, kinds, opens, not self.lower))
        ends = np.append(starts[1:], n)
        if self.lower:
            solid = kinds[starts] != _WHITE
            starts, ends = starts[solid], ends[solid]
        hashes = self._hashes(codes, starts, ends)

        # Distinct pieces in order are found in the cache much faster than all as they come.
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        distinct, first = ranked[new], order[new]
        where = self._find(distinct)
        unknown = where < 0
        if unknown.any():
            if len(self.keys) + int(unknown.sum()) > CACHE_PIECES:
                self._forget()
                unknown[:] = True
            spans = zip(starts[first[unknown]].tolist(), ends[first[unknown]].tolist())
            self._learn(distinct[unknown], [joined[a:b] for a, b in spans])
            where = self._find(distinct)
        number = np.empty(len(hashes), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        where = where[number]

        sizes = self.sizes[where]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.pool[np.repeat(self.at[where] - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, offsets)]
        result = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        doubt = np.concatenate(([0], np.cumsum(kinds == _DOUBT)))
        for i in np.flatnonzero(doubt[offsets[1:]] > doubt[offsets[:-1]]):
            whole = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
            result[i] = np.array(whole, dtype=self.dtype)
        return result

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash in the cache, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        where = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[where] == hashes, where, -1)

    @staticmethod
    def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = power_tables(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_character_values()[codes] * up[: len(codes)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    return kept(f"encoder {path}", lambda: Encoder(path))
