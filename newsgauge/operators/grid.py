"""All-against-all scoring in blocks: a grid of bounded cells that emit only their best rows.

Left rows are cut into blocks, right rows too, and every cell of the grid sees one block of
each. A cell returns the k best partners per left row, so the pairs themselves never leave
the task. Every cell is one task's work of a bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEFT_ROWS = 4096
RIGHT_ROWS = 4096
BLOCK_UNITS = 4_000_000
RESULT = "left_id bigint, right_id bigint, score double"


def score_grid(
    left: DataFrame,
    right: DataFrame,
    cell: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    left_rows: int = LEFT_ROWS,
    right_rows: int = RIGHT_ROWS,
    units: str | None = None,
) -> DataFrame:
    """Score left against right rows: ``left_id, right_id, score``.

    Blocks have at most about ``left_rows`` and ``right_rows`` rows and, where a SQL expression
    for the size of a row is given, ``BLOCK_UNITS`` units, so that long rows make more blocks.
    There are at least as many cells as the cluster has cores, if there are rows for them.
    """
    least = math.isqrt(2 * left.sparkSession.sparkContext.defaultParallelism)

    def blocks(side: DataFrame, rows: int) -> int:
        size = F.sum(F.expr(units)) if units else F.lit(0)
        n, total = side.agg(F.count(F.lit(1)), size).first()
        return max(1, min(n, least), -(-n // rows), -(-(total or 0) // BLOCK_UNITS))

    left_blocks, right_blocks = blocks(left, left_rows), blocks(right, right_rows)

    def block(id_column: str, count: int) -> Column:
        return F.pmod(F.xxhash64(id_column), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    cells = ["left_block", "right_block"]
    lefts = left.withColumn("left_block", block("left_id", left_blocks)).withColumn(
        "right_block", every(right_blocks)
    )
    # Renewed columns, as both sides may come from one table.
    rights = (
        right.select([F.col(c).alias(c) for c in right.columns])
        .withColumn("right_block", block("right_id", right_blocks))
        .withColumn("left_block", every(left_blocks))
    )
    return lefts.groupBy(*cells).cogroup(rights.groupBy(*cells)).applyInPandas(cell, RESULT)


def score_routes(
    routes: DataFrame,
    source: DataFrame,
    cell: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    left_rows: int = LEFT_ROWS,
    right_rows: int = RIGHT_ROWS,
) -> DataFrame:
    """Score rows only against the blocks they are sent to: ``left_id, right_id, score``.

    ``routes`` has ``left_id, block`` and may name a row several times, ``source`` has ``right_id,
    block``. Where a block has more rows than a cell may hold, on either side, it is dealt to several
    cells, so that a block that everything is sent to is no hot spot.
    """
    # Renewed columns, as both sides may come from one table.
    routes, source = (df.select([F.col(c).alias(c) for c in df.columns]) for df in (routes, source))

    def parts(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    cells = parts(routes, left_rows, "lefts").join(parts(source, right_rows, "rights"), "block")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        count = "lefts" if own == "left_part" else "rights"
        every = "rights" if count == "lefts" else "lefts"
        return (
            df.join(cells, "block")
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(count)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(every) - 1)))
            .drop("lefts", "rights")
        )

    keys = ["block", "left_part", "right_part"]
    lefts = dealt(routes, "left_id", "left_part", "right_part").groupBy(*keys)
    rights = dealt(source, "right_id", "right_part", "left_part").groupBy(*keys)
    return lefts.cogroup(rights).applyInPandas(cell, RESULT)


def best_per_row(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k highest finite scores per row; ties go to the left.

    Overwrites ``scores``.
    """
    rows = np.arange(scores.shape[0])
    found_rows, found_columns = [], []
    for _ in range(min(k, scores.shape[1])):
        best = scores.argmax(axis=1)
        good = np.isfinite(scores[rows, best])
        found_rows.append(rows[good])
        found_columns.append(best[good])
        scores[rows, best] = -np.inf
    if not found_rows:
        return rows[:0], rows[:0]
    return np.concatenate(found_rows), np.concatenate(found_columns)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Add ``rank`` 1..k per left row, by score, then right id."""
    window = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
