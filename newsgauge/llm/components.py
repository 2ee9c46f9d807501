"""Connected components of large graphs, and cells of rows that a task handles together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.session import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One half step: every node links its larger (or its other smaller) neighbours to the
    smallest node it sees. The smallest is a partial aggregate; the join has one row per node on
    the other side, so a hub's edges may be split among tasks."""
    if larger:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    linked = around.join(least, "u")
    if larger:
        found = linked.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        found = linked.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            least.select("u", F.col("least").alias("v"))
        )
    return found.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge; root is the smallest node it reaches.

    ``edges`` has columns u and v of one ordered type; direction, repeats, loops and nulls do not
    matter (an edge to null is ignored). Alternating large and small stars: the number of rounds
    grows with the logarithm of a component's size, whatever its diameter. Each round is written
    to the shared folder; a component never has to fit into a task.
    """
    spark = edges.sparkSession
    kept = edges.where("u is not null and v is not null and u <> v")
    state = materialize(
        spark,
        kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        mark = state.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if not mark[0] or mark == seen:
            break
        seen = mark
        state = materialize(spark, _star(_star(state, True), False), "stars")
    members = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())


def cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, as one table each, from a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def fixed_bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as rows of bytes."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, width)


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n items reaches over the given pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after
