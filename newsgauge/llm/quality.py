"""Quality rules: counts of a text, and the divergence of its histograms from its language.

Base rules count words, repeated lines and repeated three-word windows. The method compares two
histograms of a text with the reference of its language by Jensen-Shannon distance (base 2, 0 to
1): one of character classes, one of common words (every other word is one more class). The
references are sums over all documents that pass the base rules and have fewer than
``SYMBOLS_PER_WORD`` symbols, by language; languages outside ``LANGUAGES`` share one reference. Texts with fewer than ``MIN_WORDS`` words are too short for a
histogram to mean anything; the method passes them (the base rules reject them by length). It
rejects a text that is farther than both ``CHARACTER_DISTANCE`` and ``WORD_DISTANCE``: either
distance alone also grows with names, tables of numbers or a wrong language label.

Defined results: a null text has no words and fails the base rules; null or unknown languages use
the shared reference; where a language has no reference (no document of it passes the base
rules), the method passes; repeated rows are judged alike, each on its own; other columns are
passed through by ``keep`` and not read by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.blocks import Block, blocks, owners, window_hashes

MIN_WORDS = 50
CHARACTER_DISTANCE = 0.19
WORD_DISTANCE = 0.29
SYMBOLS_PER_WORD = 0.1
LANGUAGES = ("de", "en", "es", "fr")

# Common words of the four languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be on not are this by or at from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}
# Character classes, by byte.
CLASSES = ("lower", "upper", "digit", "space", "newline", "sentence", "symbol", "other")

_SYMBOLS = b"#*$%&|<>"
_SENTENCE = b".,;:!?'\"()-"


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("symbol"), dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = CLASSES.index("space")
    table[0x0A] = CLASSES.index("newline")
    table[list(_SENTENCE)] = CLASSES.index("sentence")
    table[0x80:] = CLASSES.index("other")
    return table


def _common_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the common words, lower case and capitalised, and their classes."""
    words = sorted({w for group in COMMON.values() for w in group})
    spelled = [(form, i) for i, w in enumerate(words) for form in {w, w.capitalize()}]
    block = Block.of([form for form, _ in spelled])
    hashes = block.span_hashes(block.offsets[:-1], block.offsets[1:])
    order = np.argsort(hashes)
    return hashes[order], np.array([i for _, i in spelled])[order]


_CLASS = _class_table()
_COMMON_HASHES, _COMMON_CLASS = _common_table()
WORD_CLASSES = int(_COMMON_CLASS.max()) + 2
_SYMBOL = np.isin(np.arange(256), list(_SYMBOLS))
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: its key occurs twice in its text; its key occurred before in its text."""
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    twice, again = np.zeros(len(k), dtype=bool), np.zeros(len(k), dtype=bool)
    twice[order] = same[1:] | same[:-1]
    again[order] = same[:-1]
    return twice, again


def measure(block: Block) -> dict[str, np.ndarray]:
    """The counts and both histograms of each text of a block."""
    texts, data = len(block), block.data
    starts, ends, first = block.words()
    n_words = np.diff(first)
    hashes = block.span_hashes(starts, ends)

    in_words = np.concatenate(([0], np.cumsum(_LEAD[data])))
    word_chars = _per_text(in_words[ends] - in_words[starts], first)

    windows, at, begin = window_hashes(hashes, first, 3)
    twice, _ = _repeated(windows, owners(begin))
    covered = np.zeros(len(hashes) + 2, dtype=bool)
    for k in range(3):
        covered[at[twice] + k] = True

    line_starts, line_ends, line_first = block.runs(data != 0x0A)
    # A line has a word if one starts in it; its first word is the first at or after its start.
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    kept = np.concatenate(([0], np.cumsum(has_word)))
    lines = block.span_hashes(line_starts[has_word], line_ends[has_word])
    _, again = _repeated(lines, owners(kept[line_first]))

    classes = np.repeat(np.arange(texts) * len(CLASSES), np.diff(block.offsets)) + _CLASS[data]
    where = np.minimum(np.searchsorted(_COMMON_HASHES, hashes), len(_COMMON_HASHES) - 1)
    word_class = np.where(_COMMON_HASHES[where] == hashes, _COMMON_CLASS[where], WORD_CLASSES - 1)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": _per_text(_SYMBOL[data], block.offsets),
        "n_dup_lines": _per_text(again, kept[line_first]),
        "n_repeat_words": _per_text(covered[: len(hashes)], first),
        "characters": np.bincount(classes, minlength=texts * len(CLASSES)).reshape(texts, -1),
        "words": np.bincount(
            owners(first) * WORD_CLASSES + word_class, minlength=texts * WORD_CLASSES
        ).reshape(texts, -1),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def _typical(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Texts that count for the reference of their language."""
    return ~base_failed(counts) & (counts["n_symbols"] < SYMBOLS_PER_WORD * counts["n_words"])


def js_distance(histograms: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row to its reference row; 0 where either is empty."""
    sums, sizes = histograms.sum(axis=1), reference.sum(axis=1)
    p = histograms / np.maximum(sums, 1)[:, None]
    q = reference / np.maximum(sizes, 1)[:, None]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    distance = np.sqrt(np.clip((left + right) / 2, 0, 1))
    return np.where((sums > 0) & (sizes > 0), distance, 0.0)


def _language(values: list) -> np.ndarray:
    """The number of each row's reference; the last one is shared by all other languages."""
    return np.array(
        [LANGUAGES.index(v) if v in LANGUAGES else len(LANGUAGES) for v in values], dtype=np.int64
    )


_DIMENSIONS = len(CLASSES) + WORD_CLASSES


def _histogram_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((len(LANGUAGES) + 1, _DIMENSIONS), dtype=np.int64)
    for batch in batches:
        for rows, block in blocks(batch):
            counts = measure(block)
            good = _typical(counts)
            both = np.hstack((counts["characters"], counts["words"]))[good]
            np.add.at(sums, _language(rows.column(1).to_pylist())[good], both)
    language, place = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(language), pa.array(place), pa.array(sums[language, place])],
        names=["language", "place", "total"],
    )


def references(docs: DataFrame) -> np.ndarray:
    """Histogram sums of all typical documents, one row a language.

    Tasks send one row per language and class; the result has a fixed size.
    """
    found = (
        docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .mapInArrow(_histogram_sums, "language long, place long, total long")
        .groupBy("language", "place")
        .agg(F.sum("total").alias("total"))
        .collect()
    )
    sums = np.zeros((len(LANGUAGES) + 1, _DIMENSIONS))
    for row in found:
        sums[row.language, row.place] = row.total
    return sums


def _verdicts(counts: dict, languages: np.ndarray, reference: np.ndarray) -> tuple:
    sums = reference[languages]
    characters = js_distance(counts["characters"], sums[:, : len(CLASSES)])
    words = js_distance(counts["words"], sums[:, len(CLASSES) :])
    failed = base_failed(counts)
    far = (characters > CHARACTER_DISTANCE) & (words > WORD_DISTANCE)
    kept = ~failed & ~(far & (counts["n_words"] >= MIN_WORDS))
    return characters, words, failed, kept


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, reference: np.ndarray | None = None) -> DataFrame:
    """Counts, distances and verdict of every document, one row each."""
    reference = references(docs) if reference is None else reference

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks(batch):
                counts = measure(block)
                verdicts = _verdicts(counts, _language(rows.column(2).to_pylist()), reference)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *(pa.array(counts[c], pa.int64()) for c in _COUNTS),
                     *(pa.array(v) for v in verdicts)],
                    names=["doc_id", *_COUNTS, "js_characters", "js_words", "base_failed", "kept"],
                )

    columns = ", ".join(f"{c} long" for c in _COUNTS)
    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
    ).mapInArrow(
        run,
        f"doc_id long, {columns}, js_characters double, js_words double, "
        "base_failed boolean, kept boolean",
    )


def keep(docs: DataFrame, reference: np.ndarray | None = None) -> DataFrame:
    """The documents that are kept, with all their columns; nothing is shuffled."""
    reference = references(docs) if reference is None else reference

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks(batch):
                lang = rows.column(rows.schema.get_field_index("lang")).to_pylist()
                *_, kept = _verdicts(measure(block), _language(lang), reference)
                yield rows.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
