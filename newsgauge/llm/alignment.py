"""Cross-tokenizer alignment: tokens of two vocabularies that cover the same bytes of a text.

Both tokenizers cut the same bytes, a space and the text; a token is known by the byte at which it
ends. Byte offsets at which tokens of both end cut them into groups. Tokens that share bytes are
linked, and a pair of ids is as strong as the links that hold it in the whole corpus.

Ends are merged along the merge path: the texts of a chunk lie behind each other, so its A and B
ends are two sorted lists, and the path that merges them is divided by diagonals ``WORK`` steps
apart. Where the path crosses a diagonal is found by binary search, for all diagonals at once. The
pieces between two diagonals are independent and of equal work, so they advance side by side, a step
of all pieces being one numpy operation. Each emits its overlaps; groups that run across a border are
stitched by summing up the groups that the pieces before have closed.

Per chunk (about ``CHUNK_BYTES`` of texts of one task, or one longer text) the distinct pairs are
counted before anything is shuffled. Counts of the corpus come from one aggregate by pair and go back
to the chunks that hold the pair, so neither links nor a table of all pairs meet in one place: a chunk
needs the pairs of its own texts only. Documents wait for them as numbers of pairs in their chunk.

Defined results: a null or empty text, and one that either tokenizer does not give back byte by byte,
has no tokens; repeated rows count each; a null doc_id stays null; an empty table has no rows; other
columns are not read. Special tokens in a text are plain text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsgauge.llm.blocks import blocks, kept
from newsgauge.llm.tokens import encoder
from newsgauge.session import materialize

WORK = 64
CHUNK_BYTES = 1 << 20
MARK = "▁"


# --- vocabularies --------------------------------------------------------------------------


class Spelling:
    """Bytes of every token of a vocabulary, as one pool."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.pool[at]


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_spelling(path: str) -> Spelling:
    """Of a byte-level file of the tokenizers library; special tokens are spelled as they read."""
    byte_of = _byte_characters()
    tokenizer = Tokenizer.from_file(path)
    words = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return Spelling([
        bytes(byte_of[c] for c in w) if all(c in byte_of for c in w) else w.encode() for w in words
    ])


class Pieces:
    """A sentencepiece file: ids of texts and the bytes of its pieces."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.spelling = Spelling([
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.model.encode(texts, num_threads=1)
        return [np.array(ids, dtype=np.int32) for ids in found]


# --- merge path ----------------------------------------------------------------------------


def diagonal_cuts(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` the merge of two sorted lists has taken after so many steps.

    Equal values are taken from ``a`` first.
    """
    low = np.maximum(diagonals - len(b), 0)
    high = np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        taken = np.zeros(len(diagonals), dtype=bool)
        m = middle[open_]
        taken[open_] = a[m] <= b[diagonals[open_] - 1 - m]
        low = np.where(open_ & taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)
    return low


class MergePath:
    """Overlaps and groups of two lists of token ends over the same bytes.

    ``link_a, link_b``: the pairs of overlapping tokens in order. ``group_a, group_b``: the number
    of each token's group.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, work: int = WORK):
        total = len(a) + len(b)
        starts = np.arange(0, total, work)
        i = diagonal_cuts(a, b, starts)
        j = starts - i
        pieces = len(starts)
        steps = np.minimum(total - starts, work)
        shape = (pieces, work)
        at_a, at_b = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=np.int32)
        from_a, links, closes = (np.zeros(shape, dtype=bool) for _ in range(3))
        far = max(int(a[-1]) if len(a) else 0, int(b[-1]) if len(b) else 0) + 1
        # Before its first step a piece looks back across its border.
        ends_a, ends_b = np.append(a, far), np.append(b, far)
        last_a = np.where(i > 0, ends_a[i - 1], -1)
        for step in range(min(work, total)):
            next_a, next_b = ends_a[i], ends_b[j]
            take = next_a <= next_b
            at_a[:, step], at_b[:, step], from_a[:, step] = i, j, take
            same = ~take & (last_a == next_b)
            links[:, step] = ~same
            closes[:, step] = same
            last_a = np.where(take, next_a, last_a)
            more = step + 1 < steps
            i = i + (take & more)
            j = j + (~take & more)
        used = np.arange(work)[None, :] < steps[:, None]
        # Groups closed by the pieces before, and by the steps of the piece before this one.
        closes &= used
        inside = np.cumsum(closes, axis=1, dtype=np.int32)
        before = np.concatenate(([0], np.cumsum(inside[:, -1])))[:-1] if pieces else np.zeros(0, int)
        group = (before[:, None] + inside - closes).astype(np.int32)
        links &= used
        self.link_a, self.link_b = at_a[links], at_b[links]
        self.group_a = group[from_a & used]
        self.group_b = group[~from_a & used]


# --- chunks --------------------------------------------------------------------------------

_DIGITS = 7


def _decimals(n: int) -> np.ndarray:
    """Decimal ASCII digits of 0..n-1, left of a free last column; unused places are 0."""
    table = np.zeros((n, _DIGITS), dtype=np.uint8)
    for i, word in enumerate(np.char.mod("%d", np.arange(n)).astype("S6")):
        table[i, : len(word)] = np.frombuffer(word, dtype=np.uint8)
    return table


def group_texts(
    a: np.ndarray, b: np.ndarray, path: MergePath, first_a: np.ndarray, first_b: np.ndarray
) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` for each text, from the ids and the first token of each text."""
    groups = int(path.group_a[-1]) + 1 if len(a) else 0
    count_a = np.bincount(path.group_a, minlength=groups)
    count_b = np.bincount(path.group_b, minlength=groups)
    until_a, until_b = np.cumsum(count_a), np.cumsum(count_b)
    place_a = np.arange(len(a)) + (until_b - count_b)[path.group_a]
    place_b = np.arange(len(b)) + until_a[path.group_b]
    digits = kept("decimals", lambda: _decimals(1 << 17))
    text = np.zeros((len(a) + len(b), _DIGITS), dtype=np.uint8)
    text[place_a] = digits[a]
    text[place_b] = digits[b]
    text[:, -1] = ord(",")
    text[place_a[until_a - 1], -1] = ord("|")
    text[place_b[until_b - 1], -1] = ord(";")
    flat = text.reshape(-1)
    size = np.concatenate(([0], np.cumsum((text != 0).sum(axis=1))))
    data = flat[flat != 0].tobytes()
    cuts = size[first_a + first_b]
    return [data[x : max(x, y - 1)] for x, y in zip(cuts.tolist(), cuts[1:].tolist())]


def _same_bytes(spelling: Spelling, ids: list[np.ndarray], want: list[bytes]) -> np.ndarray:
    """Which texts the ids of a vocabulary give back byte by byte."""
    joined = spelling.joined(np.concatenate(ids)) if ids else np.zeros(0, np.uint8)
    sizes = np.array([int(spelling.sizes[i].sum()) for i in ids], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = joined.tobytes()
    return np.array([
        data[end - size : end] == w for end, size, w in zip(ends.tolist(), sizes.tolist(), want)
    ], dtype=bool)


class Chunk:
    """Texts of one task, tokenized block by block; aligned when the chunk is full."""

    def __init__(self, a_path: str, b_path: str):
        self.a_path, self.b_path = a_path, b_path
        self.doc_ids: list[int | None] = []
        self.ids_a: list[np.ndarray] = []
        self.ids_b: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_ids: list[int | None], texts: list[str]) -> None:
        spell_a = kept(f"bytes of {self.a_path}", lambda: byte_spelling(self.a_path))
        pieces = kept(f"pieces {self.b_path}", lambda: Pieces(self.b_path))
        spaced = [" " + t if t else "" for t in texts]
        ids_a = [i.astype(np.int32) for i in encoder(self.a_path).encode(spaced)]
        ids_b = pieces.encode(texts)
        want = [t.encode("utf-8", "surrogatepass") for t in spaced]
        good = _same_bytes(spell_a, ids_a, want) & _same_bytes(pieces.spelling, ids_b, want)
        none = np.zeros(0, dtype=np.int32)
        self.doc_ids += doc_ids
        self.ids_a += [i if ok else none for i, ok in zip(ids_a, good)]
        self.ids_b += [i if ok else none for i, ok in zip(ids_b, good)]
        self.bytes += sum(map(len, want))

    def rows(self, number: int, with_groups: bool) -> Iterator[pa.RecordBatch]:
        """A row per document, then the distinct pairs of the chunk with their links."""
        spell_a = kept(f"bytes of {self.a_path}", lambda: byte_spelling(self.a_path))
        spell_b = kept(f"pieces {self.b_path}", lambda: Pieces(self.b_path)).spelling
        n_a = np.array([len(i) for i in self.ids_a], dtype=np.int64)
        n_b = np.array([len(i) for i in self.ids_b], dtype=np.int64)
        first_a, first_b = (np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b))
        a, b = np.concatenate(self.ids_a), np.concatenate(self.ids_b)
        path = MergePath(np.cumsum(spell_a.sizes[a]), np.cumsum(spell_b.sizes[b]))
        texts = group_texts(a, b, path, first_a, first_b)
        group_of = np.append(path.group_a, path.group_a[-1] + 1 if len(a) else 0)
        n_groups = np.diff(group_of[first_a])
        cuts = np.searchsorted(path.link_a, first_a)

        pairs, distinct = pd.factorize(a[path.link_a].astype(np.int64) << 32 | b[path.link_b])
        counts = np.bincount(pairs, minlength=len(distinct))
        owner = np.repeat(np.arange(len(n_a)), np.diff(cuts))
        keys = np.sort(owner * np.int64(max(1, len(distinct))) + pairs)
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
        times = np.diff(np.append(new, len(keys))).astype("<u4")
        owner, held = np.divmod(keys[new], max(1, len(distinct)))
        held = held.astype("<u4")
        cuts_held = np.searchsorted(owner, np.arange(len(n_a) + 1)).tolist()
        links = np.diff(cuts).tolist()
        spans = list(zip(cuts_held, cuts_held[1:]))
        empty = np.zeros(len(n_a), dtype=np.int64)
        yield _batch(
            np.full(len(n_a), number), pa.array(self.doc_ids, pa.int64()), n_a, n_b, n_groups, links,
            [hashlib.sha256(t).hexdigest() if n else "" for t, n in zip(texts, links)],
            [held[x:y].tobytes() for x, y in spans], [times[x:y].tobytes() for x, y in spans],
            [t.decode() for t in texts] if with_groups else [None] * len(texts),
            pa.nulls(len(n_a), pa.int64()), empty, empty, empty,
        )
        k = len(distinct)
        nothing = [pa.nulls(k, f.type) for f in list(_SCHEMA)[1:10]]
        yield _batch(
            np.full(k, number), *nothing, np.arange(k), distinct >> 32, distinct & 0xFFFFFFFF, counts
        )


_FIELDS = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "held binary, times binary, groups string, pair long, a_id long, b_id long, links long"
)
_SCHEMA = pa.schema(
    [
        (name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind])
        for name, kind in (field.split(" ") for field in _FIELDS.split(", "))
    ]
)


def _batch(*columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _aligned(a_path: str, b_path: str, with_groups: bool, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(a_path, b_path)
        for batch in batches:
            for rows, _ in blocks(batch):
                chunk.add(rows.column(0).to_pylist(), rows.column(1).to_pylist())
                if chunk.bytes >= chunk_bytes:
                    yield from chunk.rows(number, with_groups)
                    number, chunk = number + 1, Chunk(a_path, b_path)
        if chunk.doc_ids:
            yield from chunk.rows(number, with_groups)

    return run


def _scored(with_groups: bool):
    names = [*RESULT, *(["groups"] if with_groups else [])]

    def run(key: tuple, documents: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.asarray(pairs.column("pair").combine_chunks())
        total = np.zeros(len(order), dtype=np.int64)
        best = np.zeros(len(order), dtype=bool)
        total[order] = np.asarray(pairs.column("total").combine_chunks())
        best[order] = np.asarray(pairs.column("best").combine_chunks().cast(pa.int8()))
        sums, bests = [], []
        for held, times in zip(documents.column("held").to_pylist(), documents.column("times").to_pylist()):
            at = np.frombuffer(held, dtype="<u4")
            n = np.frombuffer(times, dtype="<u4").astype(np.int64)
            sums.append(int((total[at] * n).sum()))
            bests.append(int(n[best[at]].sum()))
        made = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        columns = [made[n] if n in made else documents.column(n) for n in names]
        return pa.table(columns, names=names)

    return run


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Alignment:
    """Documents aligned by two tokenizers; the chunks are stored, as they are read twice."""

    def __init__(
        self,
        docs: DataFrame,
        a_path: str,
        b_path: str,
        with_groups: bool = False,
        chunk_bytes: int = CHUNK_BYTES,
    ):
        """``a_path`` is a byte-level file of the tokenizers library, ``b_path`` one of sentencepiece."""
        texts = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        run = _aligned(a_path, b_path, with_groups, chunk_bytes)
        self.with_groups = with_groups
        self.chunks = materialize(docs.sparkSession, texts.mapInArrow(run, _FIELDS), "alignment")

    def pairs(self) -> DataFrame:
        """``a_id, b_id, total, best``: links of each pair, and whether its B id has none stronger."""
        rows = self.chunks.where("pair is not null")
        totals = rows.groupBy("a_id", "b_id").agg(F.sum("links").alias("total"))
        totals = materialize(self.chunks.sparkSession, totals, "pair-totals")
        strongest = totals.groupBy("b_id").agg(F.max("total").alias("most"))
        return totals.join(strongest, "b_id").select(
            "a_id", "b_id", "total", (F.col("total") == F.col("most")).alias("best")
        )

    def documents(self) -> DataFrame:
        """One row per document; with its groups as text, if they were asked for.

        ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
        """
        wanted = self.chunks.where("pair is not null").select("chunk", "pair", "a_id", "b_id")
        answers = wanted.join(self.pairs(), ["a_id", "b_id"]).select("chunk", "pair", "total", "best")
        # Renewed columns, as both sides come from one table.
        kept_columns = [c for c in self.chunks.columns if c not in ("pair", "a_id", "b_id", "links")]
        texts = self.chunks.where("pair is null").select([F.col(c).alias(c) for c in kept_columns])
        fields = ", ".join(
            f"{n} {'string' if n.startswith('groups') else 'long'}"
            for n in [*RESULT, *(["groups"] if self.with_groups else [])]
        )
        return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
            _scored(self.with_groups), fields
        )
