"""Document fingerprints: MinHash signatures of word shingles, and the joins over their bands.

Words are runs of characters that are no ASCII white space; a shingle is five of them (a shorter
text has one shingle of all its words). Each of the 128 universal hash permutations
``(a * x + b) mod 2^64 >> 32`` of the shingle hashes keeps its minimum; a fingerprint is the low
16 bits of each minimum. The share of equal values estimates the Jaccard similarity.

Defined results: a null text is an empty text; a text without words has the fingerprint of the
empty set (all bits set); equal texts have equal fingerprints; columns other than the ones named
are neither read nor kept, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.blocks import Block, blocks, mix, shingles

WORDS = 5
PERMUTATIONS = 128
THRESHOLD = 0.8
BAND_ROWS = 4
_CHUNK = 1 << 14


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the universal hash permutations."""
    start = np.arange(1, 2 * count + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)
    values = mix(start * np.uint64(0x9E3779B97F4A7C15))
    return values[:count] | np.uint64(1), values[count:]


def signatures(hashes: np.ndarray, first: np.ndarray, count: int = PERMUTATIONS) -> np.ndarray:
    """The minimum of each permutation over each text's hashes: ``uint16 [texts, count]``."""
    texts = len(first) - 1
    lowest = np.full((count, texts), 0xFFFFFFFF, dtype=np.uint32)
    a, b = permutations(count)
    filled = np.flatnonzero(np.diff(first))
    product = np.empty(_CHUNK, dtype=np.uint64)
    # Chunks stay in the processor's cache for all permutations. A text may span several.
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        lo = np.searchsorted(first[filled], at, "right") - 1
        hi = np.searchsorted(first[filled], at + len(part), "left")
        inside = filled[lo:hi]
        cuts = np.maximum(first[inside] - at, 0)
        out = product[: len(part)]
        for k in range(count):
            np.multiply(part, a[k], out=out)
            np.add(out, b[k], out=out)
            high = out.view(np.uint32)[1::2]
            lowest[k, inside] = np.minimum(lowest[k, inside], np.minimum.reduceat(high, cuts))
    return (lowest & 0xFFFF).astype(np.uint16).T.copy()


def _hex(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


FINGERPRINTED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, " \
    "edited_fingerprint string, near_edited double, near_next double"  # fmt: skip


def edited_text(text: str, after: str) -> str:
    """The last third of the code points gives way to as many of the next text's first ones."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def _compared(ids: list, texts: list[str], judged: np.ndarray) -> pa.RecordBatch:
    """Results of the texts at ``judged``, each compared with its successor in the list."""
    signature = signatures(*shingles(Block.of(texts), WORDS))
    edited = [edited_text(texts[i], texts[i + 1]) for i in judged]
    changed = signatures(*shingles(Block.of(edited), WORDS))
    own, after = signature[judged], signature[judged + 1]
    values = [
        [ids[i] for i in judged],
        [len(texts[i]) for i in judged],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        _hex(own),
        _hex(changed),
        (own == changed).mean(axis=1),
        (own == after).mean(axis=1),
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, f.type) for v, f in zip(values, FINGERPRINTED)], schema=FINGERPRINTED
    )


def _fingerprint_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare neighbours of a sorted partition. Every range ends with a guest, the first text of
    the next range, which is only looked at."""
    ids: list = []
    texts: list[str] = []
    guests: list[bool] = []
    for batch in batches:
        for rows, _ in blocks(batch):
            ids += rows.column(0).to_pylist()
            texts += rows.column(1).to_pylist()
            guests += rows.column(2).to_pylist()
            judged = np.flatnonzero(~np.array(guests[:-1], dtype=bool))
            if len(judged):
                yield _compared(ids, texts, judged)
            ids, texts, guests = ids[-1:], texts[-1:], guests[-1:]


def _search(key: Column, heads: list[int], lo: int, hi: int) -> Column:
    """The number of the last of the descending heads that is not below the key."""
    if hi - lo == 1:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key <= F.lit(heads[mid]), _search(key, heads, mid, hi)).otherwise(
        _search(key, heads, lo, mid)
    )


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness.

    The edited text has the last third of its code points replaced by as many of the next
    document's first ones (all, if that has fewer). The next document has the next smaller
    doc_id; after the smallest comes the largest. Rows of equal doc_id follow each other by
    text; a null doc_id counts as the smallest. A single document is its own next one.

    The ids alone are sorted first and cut into ranges; only the largest id of each range goes to
    the driver. The texts are then shuffled once, by range, and the first text of each range also
    goes to the range before, so every text meets its successor.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        rows.select(key.alias("key"))
        .repartitionByRange(ranges, F.desc("key"))
        .groupBy(F.spark_partition_id())
        .agg(F.max("key").alias("head"))
        .collect()
    )
    heads = sorted({r["head"] for r in found}, reverse=True) or [0]
    largest = F.element_at(F.lit(heads), F.col("range") + 1)
    before = F.pmod(F.col("range") - 1, F.lit(len(heads)))
    homes = F.when(
        key == largest,
        F.array(
            F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")),
            F.struct(before.alias("range"), F.lit(True).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))))
    return (
        rows.withColumn("range", _search(key, heads, 0, len(heads)))
        .select("doc_id", "text", F.explode(homes).alias("home"))
        .select("doc_id", "text", "home.guest", "home.range")
        .repartition(F.col("range"))
        .sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")
        .mapInArrow(_fingerprint_sorted, _RESULT)
    )


def near_leaders(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, leader_id, jaccard, n_links``: documents and the nearest smaller id they are near
    copies of.

    Signature bands are joined, all members of a bucket are compared in bounded blocks, and
    Jaccard is verified on whole shingle sets, by the cells of ``jaccard_join``.
    """
    from newsgauge.llm import jaccard_join  # which needs this module's signatures

    return jaccard_join.leaders(docs, threshold)
