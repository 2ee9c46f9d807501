"""Similarity join of documents on word shingles, with Bayesian candidate pruning.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least
0.8. Equal texts form a class, and only one of them is compared. Candidates share at least one
band of four MinHash values out of 32 bands (a pair of similarity 0.8 has none with probability
5e-8). Their MinHash values are then compared 16 at a time: with a uniform prior, the posterior
of the similarity after m equal values of n is Beta(m + 1, n - m + 1), and a pair is dropped once
the probability of reaching the threshold is below 1e-9. The rest is verified on whole shingle
sets.

Pairs never become rows. Buckets and groups of any size are cut into blocks, a cell sees two
blocks, and tells only how many links each text has and a spanning forest of them.

Defined results: a null text is an empty text; texts without words are linked to nothing, but
equal ones share a class; a repeated row counts as a copy; a null doc_id takes part like any
other, and is never the smallest of its class if another id is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.blocks import blocks, distinct_per_text, shingles
from newsgauge.llm.components import cells, components, fixed_bytes, forest
from newsgauge.llm.minhash import BAND_ROWS, PERMUTATIONS, THRESHOLD, WORDS, signatures
from newsgauge.session import materialize

BANDS = PERMUTATIONS // BAND_ROWS
STEP = 16
TOLERANCE = 1e-9
BLOCK_TEXTS = 256
BLOCK_CHARS = 4_000_000
_SIGNATURE_BYTES = 2 * PERMUTATIONS


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values, a pair with fewer equal ones is dropped.

    The probability that a Beta(m + 1, n - m + 1) variable reaches t is that of at most m
    successes in n + 1 trials of probability t.
    """
    result = {}
    for n in range(STEP, PERMUTATIONS + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        result[n] = m
    return result


def plausible(
    signature: np.ndarray, left: np.ndarray, right: np.ndarray, least: dict[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step of the comparison drops."""
    matches = np.zeros(len(left), dtype=np.int32)
    for n, m in least.items():
        part = signature[:, n - STEP : n]
        matches = matches + (part[left] == part[right]).sum(axis=1, dtype=np.int32)
        alive = matches >= m
        left, right, matches = left[alive], right[alive], matches[alive]
    return left, right


def _pairs(blocks_of_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a cell: between its two blocks, or within the one it has."""
    rows = np.arange(len(blocks_of_rows))
    a, b = rows[blocks_of_rows == 0], rows[blocks_of_rows == 1]
    if len(b):
        return np.repeat(a, len(b)), np.tile(b, len(a))
    i, j = np.triu_indices(len(a), 1)
    return a[i], a[j]


def node_of(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


_SKETCH = pa.schema([
    ("doc_id", pa.int64()), ("node", pa.binary()), ("chars", pa.int64()), ("signature", pa.binary()),
])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, block in blocks(batch):
            hashes, first = shingles(block, WORDS)
            packed = signatures(hashes, first)
            values = [
                packed[i].tobytes() if first[i] < first[i + 1] else None for i in range(len(block))
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1).cast(pa.binary()),
                 pa.array(np.diff(block.offsets)), pa.array(values, pa.binary())],
                schema=_SKETCH,
            )


def _split(rows: DataFrame, key: str, blocks_column: str, node: str = "node") -> DataFrame:
    """Send each row to the cells of its block: with itself, and with every other block.

    ``side`` is 0 for the smaller block of a cell and 1 for the larger one.
    """
    own = F.pmod(F.xxhash64(node), F.col(blocks_column)).cast("int")
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks_column).cast("int") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0))
        .drop("own", "other", blocks_column)
        .repartition(F.col(key), F.col("low"), F.col("high"))
        .sortWithinPartitions(key, "low", "high")
    )


def _edge_rows(nodes: list, label: np.ndarray) -> list[pa.Array]:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return [
        pa.array([nodes[i] for i in moved], pa.binary()),
        pa.array([nodes[label[i]] for i in moved], pa.binary()),
    ]


def _candidate_cells(least: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ["bucket", "low", "high"]):
            if cell.num_rows < 2:
                continue
            signature = fixed_bytes(cell.column("signature"), _SIGNATURE_BYTES).view(np.uint16)
            left, right = _pairs(np.asarray(cell.column("side")))
            left, right = plausible(signature, left, right, least)
            if len(left):
                label = forest(left, right, cell.num_rows)
                yield pa.RecordBatch.from_arrays(
                    _edge_rows(cell.column("node").to_pylist(), label), names=["u", "v"]
                )

    return run


def intersections(
    sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096
) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sets.

    Sums products of 0/1 matrices over slices of the vocabulary, exact in 32-bit floats as no
    slice has 2^24 columns.
    """
    a, a_of = np.unique(left, return_inverse=True)
    b, b_of = np.unique(right, return_inverse=True)
    used = np.union1d(a, b)
    joined = np.concatenate([sets[i] for i in used])
    row = np.repeat(used, [len(sets[i]) for i in used])
    vocabulary, column = np.unique(joined, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    place_a = np.full(len(sets), -1)
    place_a[a] = np.arange(len(a))
    place_b = np.full(len(sets), -1)
    place_b[b] = np.arange(len(b))
    total = np.zeros((len(a), len(b)), dtype=np.float64)
    for at in range(0, len(vocabulary), columns):
        lo, hi = np.searchsorted(column, [at, at + columns])
        r, c = row[lo:hi], column[lo:hi] - at
        part_a = np.zeros((len(a), columns), dtype=np.float32)
        part_b = np.zeros((len(b), columns), dtype=np.float32)
        in_a, in_b = place_a[r] >= 0, place_b[r] >= 0
        part_a[place_a[r[in_a]], c[in_a]] = 1
        part_b[place_b[r[in_b]], c[in_b]] = 1
        total += part_a @ part_b.T
    return total[a_of, b_of].astype(np.int64)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add signature and shingle set to each text, and leave the text out."""
    for batch in batches:
        for rows, block in blocks(batch):
            hashes, first = distinct_per_text(*shingles(block, WORDS))
            packed = signatures(hashes, first)
            names = ["node", "root", "n_blocks", "class_id"]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(c)) for c in names),
                 pa.array([row.tobytes() for row in packed], pa.binary()),
                 pa.array([hashes[lo:hi].tobytes() for lo, hi in zip(first, first[1:])],
                          pa.binary())],
                names=[*names, "signature", "shingles"],
            )


def _cell_links(
    cell: pa.Table, least: dict[int, int], threshold: Fraction
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linked pairs of a cell, and their similarity."""
    signature = fixed_bytes(cell.column("signature"), _SIGNATURE_BYTES).view(np.uint16)
    left, right = _pairs(np.asarray(cell.column("side")))
    left, right = plausible(signature, left, right, least)
    if not len(left):
        return left, right, np.zeros(0)
    sets = [np.frombuffer(s, dtype=np.uint64) for s in cell.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    both = intersections(sets, left, right)
    union = sizes[left] + sizes[right] - both
    linked = both * threshold.denominator >= threshold.numerator * union
    return left[linked], right[linked], both[linked] / union[linked]


def _link_cells(least: dict[int, int], threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ["root", "low", "high"]):
            if cell.num_rows < 2:
                continue
            left, right, _ = _cell_links(cell, least, threshold)
            n = cell.num_rows
            links = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
            label = forest(left, right, n)
            some = np.flatnonzero(links)
            nodes = cell.column("node").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i in some], pa.binary()),
                 pa.array([nodes[label[i]] for i in some], pa.binary()),
                 pa.array(links[some], pa.int64())],
                names=["u", "v", "links"],
            )

    return run


def _leader_cells(least: dict[int, int], threshold: Fraction):
    """For each text of a cell its number of links, and the nearest one of smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ["root", "low", "high"]):
            if cell.num_rows < 2:
                continue
            left, right, likeness = _cell_links(cell, least, threshold)
            n = cell.num_rows
            links = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
            ids = np.asarray(cell.column("class_id"))
            upper = np.where(ids[left] > ids[right], left, right)
            lower = left + right - upper
            order = np.lexsort((ids[lower], -likeness, upper))
            order = order[(ids[lower] < ids[upper])[order]]
            led, first = np.unique(upper[order], return_index=True)
            leader, jaccard = np.zeros(n, dtype=np.int64), np.zeros(n)
            leader[led], jaccard[led] = ids[lower[order[first]]], likeness[order[first]]
            none = np.ones(n, dtype=bool)
            none[led] = False
            some = np.flatnonzero(links)
            nodes = cell.column("node").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i in some], pa.binary()),
                 pa.array(leader[some], pa.int64(), mask=none[some]),
                 pa.array(jaccard[some], pa.float64(), mask=none[some]),
                 pa.array(links[some], pa.int64())],
                names=["node", "leader_id", "jaccard", "links"],
            )

    return run


def _grouped(docs: DataFrame, least: dict[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row for every document, one for every node, and the cells in which nodes are compared."""
    spark = docs.sparkSession
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), node_of(_text()).alias("node"),
        _text().alias("text"),
    )
    sketches = materialize(
        spark,
        named.mapInArrow(_sketch, "doc_id long, node binary, chars long, signature binary"),
        "sketches",
    )
    classes = materialize(
        spark,
        sketches.groupBy("node").agg(
            F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("rows"),
            F.first("chars").alias("chars"), F.first("signature").alias("signature"),
        ),
        "classes",
    )

    # Texts that share a band with another text.
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    bands = (
        classes.where("signature is not null")
        .select("node", "signature", band.alias("band"))
        .select(
            "node",
            F.xxhash64(
                "band", F.substring("signature", F.col("band") * 2 * BAND_ROWS + 1, F.lit(2 * BAND_ROWS))
            ).alias("bucket"),
        )
    )
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    members = materialize(spark, bands.join(shared, "bucket"), "buckets")
    candidates = _split(
        members.withColumn("n_blocks", F.ceil(F.col("texts") / (4 * BLOCK_TEXTS)))
        .drop("texts")
        .join(classes.select("node", "signature"), "node"),
        "bucket",
        "n_blocks",
    )
    near = components(candidates.mapInArrow(_candidate_cells(least), "u binary, v binary"))

    # Groups of plausible pairs, with whole shingle sets.
    near = materialize(spark, near.join(classes.drop("signature"), "node"), "near")
    sizes = near.groupBy("root").agg(
        F.ceil(
            F.greatest(
                F.count(F.lit(1)) / F.lit(BLOCK_TEXTS), F.sum("chars") / F.lit(BLOCK_CHARS)
            )
        ).alias("n_blocks")
    )
    wanted = near.join(sizes, "root").select("node", "root", "n_blocks", "class_id")
    # A few texts of all are wanted, but how many has no bound: shuffled, not broadcast.
    texts = (
        named.join(
            wanted.withColumnRenamed("node", "class_node").hint("merge"),
            F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node")),
        )
        .select("node", "root", "n_blocks", named["doc_id"].alias("class_id"), "text")
    )
    prepared = texts.mapInArrow(
        _prepared, "node binary, root binary, n_blocks long, class_id long, signature binary, shingles binary",
    ).dropDuplicates(["node"])
    return sketches, classes, _split(prepared, "root", "n_blocks")


def _linked(docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node`` of every document, and what is known of every node."""
    least = least_matches(threshold, tolerance)
    sketches, classes, compared = _grouped(docs, least)
    links = materialize(
        docs.sparkSession,
        compared.mapInArrow(
            _link_cells(least, Fraction(threshold).limit_denominator(1000)),
            "u binary, v binary, links long",
        ),
        "links",
    )

    counts = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("n_links"))
    roots = components(links.select("u", "v")).join(classes.select("node", "class_id"), "node")
    # The smallest id of a group, and the text that has it.
    order = F.struct(F.col("class_id").isNull().alias("nameless"), "class_id", "node")
    leaders = roots.groupBy("root").agg(F.min(order).alias("leader"))
    groups = roots.join(leaders, "root").select("node", "leader")
    described = classes.select("node", "class_id", (F.col("rows") - 1).alias("n_copies")).join(
        counts, "node", "left"
    ).join(groups, "node", "left")
    return sketches.select("doc_id", "node"), described


def jaccard_join(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """``doc_id, class_id, n_copies, n_links, group_id``, one row per document.

    class_id is the smallest doc_id of equal texts, n_copies their number besides the document,
    n_links the number of different texts it is linked to, and group_id the smallest doc_id that
    links and copies lead to.
    """
    rows, described = _linked(docs, threshold, tolerance)
    return rows.join(described, "node").select(
        "doc_id",
        "class_id",
        "n_copies",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("leader.class_id", "class_id").alias("group_id"),
    )


def leaders(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """``doc_id, leader_id, jaccard, n_links`` of the documents that are linked to, or copies of,
    one of smaller id: the most similar of these (of several the smallest id), and the number of
    different texts the document is linked to. Null ids and texts without words take no part.
    """
    least = least_matches(threshold, tolerance)
    rows, classes, compared = _grouped(docs.where("doc_id is not null"), least)
    found = compared.mapInArrow(
        _leader_cells(least, Fraction(threshold).limit_denominator(1000)),
        "node binary, leader_id long, jaccard double, links long",
    )
    nearest = F.struct((-F.col("jaccard")).alias("distance"), "leader_id")
    best = found.groupBy("node").agg(
        F.sum("links").alias("n_links"),
        F.min(F.when(F.col("leader_id").isNotNull(), nearest)).alias("best"),
    )
    copy = F.col("doc_id") > F.col("class_id")
    return (
        rows.select("doc_id", "node")
        .join(classes.where("signature is not null").select("node", "class_id"), "node")
        .join(best, "node", "left")
        .select(
            "doc_id",
            F.when(copy, F.col("class_id")).otherwise(F.col("best.leader_id")).alias("leader_id"),
            F.when(copy, 1.0).otherwise(-F.col("best.distance")).alias("jaccard"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
        .where("leader_id is not null")
    )


def keep_one(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """The row of smallest doc_id of each group of linked documents and copies, unchanged."""
    _, described = _linked(docs, threshold, tolerance)
    kept = described.where("leader is null or leader.node = node").select("node", "class_id")
    return (
        docs.select(
            node_of(_text()).alias("_node"), F.col("doc_id").cast("long").alias("_id"),
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        )
        .join(
            kept.hint("merge"),
            (F.col("_node") == F.col("node")) & F.col("_id").eqNullSafe(F.col("class_id")),
            "left_semi",
        )
        .groupBy("_node")
        .agg(F.first("_row").alias("_row"))
        .select("_row.*")
    )
