"""Cosine top-k neighbours from other domains: exact, or by an inverted-file index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.vectors import norm
from newsgauge.operators.grid import BLOCK_UNITS, RESULT, best_per_row, score_grid, score_routes, top_k
from newsgauge.operators.skew import first_ids, join_lookup
from newsgauge.session import materialize

DIGITS = 9
RECALL = 0.93
TRIAL_ROWS = 512
SAMPLE_VALUES = 4_000_000
CHUNK_PAIRS = 1 << 22
CELL_ROWS = 1 << 14
ROUTE_VALUES = 1 << 20


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _wanted(asked: pd.Series, lists: pd.Series) -> np.ndarray:
    """Left x right rows: whether the right row's list is one the left row asks for."""
    known, number = np.unique(lists.to_numpy(), return_inverse=True)
    sizes = asked.map(len).to_numpy()
    column = np.searchsorted(known, np.concatenate(asked.to_numpy()))
    row = np.repeat(np.arange(len(asked)), sizes)
    # A list that has no rows in this cell is no use.
    here = np.append(known, -1)[column] == np.concatenate(asked.to_numpy())
    table = np.zeros((len(asked), len(known)), dtype=bool)
    table[row[here], column[here]] = True
    return table[:, number]


def _cosine_cell(k: int):
    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"left_id": [], "right_id": [], "score": []}).astype(
                {"left_id": "int64", "right_id": "int64", "score": "float64"}
            )
        right = right.sort_values("right_id")
        candidates = _unit_rows(right["embedding"]).T
        domains, ids = right["domain"].to_numpy(), right["right_id"].to_numpy()
        parts = []
        size = max(1, CHUNK_PAIRS // len(right))
        for start in range(0, len(left), size):
            chunk = left.iloc[start : start + size]
            scores = np.round(_unit_rows(chunk["embedding"]) @ candidates, DIGITS) + 0.0
            scores[chunk["domain"].to_numpy()[:, None] == domains[None, :]] = -np.inf
            if "lists" in chunk:
                scores[~_wanted(chunk["lists"], right["list"])] = -np.inf
            kept = scores.copy()
            rows, columns = best_per_row(scores, k)
            parts.append(
                pd.DataFrame(
                    {
                        "left_id": chunk["left_id"].to_numpy()[rows],
                        "right_id": ids[columns],
                        "score": kept[rows, columns],
                    }
                )
            )
        return pd.concat(parts, ignore_index=True)

    return cell


def retrieve_top_k(
    targets: DataFrame, k: int = 4, source: DataFrame | None = None, block_rows: int = 4096
) -> DataFrame:
    """Per target the k most similar articles of other domains: exact, ties by id.

    Takes ``article_id, domain, embedding``, for the articles to search among too if ``source`` is
    given (else the targets are searched among themselves); gives ``article_id, neighbour_id,
    cosine, rank``. Null and zero vectors, those with a NaN, and rows without a domain take no part.

    Copies of a vector within a domain share one search, and only their k smallest ids can be
    neighbours, so copies are collapsed first. All blocks of targets then meet all blocks of the
    source, at every size of the tables.
    """
    scored = lambda searched, found: score_grid(
        searched, found, _cosine_cell(k), block_rows, block_rows, "size(embedding)"
    )
    return _answers(targets, source, k, scored)


def _keyed(vectors: DataFrame) -> DataFrame:
    length = norm(F.col("embedding"))
    # NaN is above infinity.
    known = F.col("domain").isNotNull()
    usable = vectors.where(known & (length > 0) & (length <= F.lit(math.inf)))
    return usable.select(
        F.col("article_id").alias("id"), "domain", "embedding",
        F.xxhash64("embedding").alias("c1"),
        F.xxhash64(F.lit("second"), "embedding").alias("c2"),
    )


def _answers(targets: DataFrame, source: DataFrame | None, k: int, score) -> DataFrame:
    """Search distinct vectors by ``score``, and give every copy the answer of its search."""
    spark = targets.sparkSession
    copy_key = ["domain", "c1", "c2"]
    first = materialize(spark, first_ids(_keyed(targets), copy_key, "id", k), "vectors")
    searched = first.where(F.col("place") == 1)
    found = first if source is None else first_ids(_keyed(source), copy_key, "id", k)
    scored = score(
        searched.select(F.col("id").alias("left_id"), "domain", "embedding"),
        found.select(F.col("id").alias("right_id"), "domain", "embedding"),
    )
    keys = searched.select(F.col("id").alias("left_id"), *copy_key)
    answers = top_k(scored, k).join(keys, "left_id").select(
        *copy_key, F.col("right_id").alias("neighbour_id"), F.col("score").alias("cosine"), "rank"
    )
    copies = _keyed(targets).select(F.col("id").alias("article_id"), *copy_key)
    return join_lookup(copies, answers, copy_key).select(
        "article_id", "neighbour_id", "cosine", "rank"
    )


# --- inverted lists ------------------------------------------------------------------------


def fit_centroids(vectors: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of some unit vectors: Lloyd rounds by cosine from evenly spaced rows."""
    centres = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)]
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1.0), centres)
    return centres


def probes_for(
    units: np.ndarray, domains: np.ndarray, centres: np.ndarray, k: int, recall: float
) -> int:
    """How many lists the first rows have to look into to find that share of their neighbours."""
    trial, own = units[:TRIAL_ROWS], domains[:TRIAL_ROWS]
    scores = trial @ units.T
    scores[own[:, None] == domains[None, :]] = -np.inf
    rows, columns = best_per_row(scores, k)
    if not len(rows):
        return 1
    order = np.argsort(np.argsort(-(trial @ centres.T), axis=1, kind="stable"), axis=1)
    place = order[rows, (units @ centres.T).argmax(axis=1)[columns]]
    return int(np.quantile(place, recall, method="higher")) + 1


def _list_column(centres: np.ndarray):
    """Add ``list``: the nearest list of a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = max(1, ROUTE_VALUES // len(centres))
        for whole in batches:
            for start in range(0, len(whole), size):
                batch = whole.iloc[start : start + size]
                near = _unit_rows(batch["embedding"]) @ centres.T
                yield batch.assign(list=near.argmax(axis=1).astype("int32"))

    return run


def _routes(
    centres: np.ndarray, probes: int, blocks: np.ndarray, only: dict[int, object], unused: list[int]
):
    """A row per block with ``lists``: the nearest lists of a row that lie in the block.

    Lists of nothing but the row's own domain are no use. A row goes to a block once, however many of
    its lists lie there, and what is made at a time is bounded.
    """
    wanted = min(probes, len(centres))
    copies = min(wanted, int(blocks.max()) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            if not len(whole):
                continue
            values = len(centres) + copies * len(whole["embedding"].iloc[0])
            size = max(1, ROUTE_VALUES // values)
            for start in range(0, len(whole), size):
                batch = whole.iloc[start : start + size]
                near = _unit_rows(batch["embedding"]) @ centres.T
                near[:, unused] = -np.inf
                for number, domain in only.items():
                    near[batch["domain"].to_numpy() == domain, number] = -np.inf
                nearest = np.argsort(-near, axis=1, kind="stable")[:, :wanted]
                row, column = np.nonzero(np.isfinite(np.take_along_axis(near, nearest, axis=1)))
                lists = nearest[row, column].astype("int32")
                order = np.lexsort((lists, blocks[lists], row))
                row, lists = row[order], lists[order]
                block = blocks[lists]
                new = np.flatnonzero(
                    np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1]))[: len(row)]
                )
                parts = np.split(lists, new[1:]) if len(new) else []
                yield batch.iloc[row[new]].assign(block=block[new], lists=pd.Series(parts, dtype=object).to_numpy())

    return run


def _sample(found: DataFrame, n: int, size: int) -> pd.DataFrame:
    """The rows of the smallest hashes: the same ones on any partitioning. A task sends its share."""
    number = F.xxhash64("right_id")
    share = (size + 6 * math.sqrt(size) + 10) / max(1, n)
    some = found.where(number <= F.lit(int(share * 2**64) - 2**63)) if share < 1 else found
    rows = some.orderBy(number, "right_id").limit(size).select("domain", "embedding").toPandas()
    return rows if len(rows) == size or share >= 1 else _sample(found, 0, size)


def retrieve_by_lists(
    targets: DataFrame,
    k: int = 4,
    source: DataFrame | None = None,
    lists: int | None = None,
    probes: int | None = None,
    recall: float = RECALL,
    sample_values: int = SAMPLE_VALUES,
) -> DataFrame:
    """``retrieve_top_k`` by an inverted-file index: bounded work per target, cosines exact.

    Centroids are fitted on a sample of the source of at most ``sample_values`` numbers; by default
    there are about as many lists as the square root of its rows. Every row of the source is put
    into the list of its nearest centroid, every target compared with all rows of the ``probes``
    nearest lists that hold other domains; a neighbour in a list not probed is missed. If not given,
    ``probes`` is the least number that finds the share ``recall`` of the neighbours which the first
    ``TRIAL_ROWS`` rows of the sample have in the sample: few where vectors lie in clusters, half
    of the lists where they lie anywhere. Large lists are dealt to several cells.
    """

    def score(searched: DataFrame, found: DataFrame) -> DataFrame:
        spark = searched.sparkSession
        found = materialize(spark, found, "found")
        shape = found.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        n, size = shape[0], max(1, shape[1] or 1)
        rows = _sample(found, n, max(1, sample_values // size))
        if rows.empty:
            return spark.createDataFrame([], RESULT)
        units = _unit_rows(rows["embedding"])
        wanted = lists or math.isqrt(n)
        centres = fit_centroids(units, max(1, min(wanted, len(units) // 4)))

        def fields(df: DataFrame, added: str) -> str:
            return ", ".join(f"{name} {kind}" for name, kind in df.dtypes) + added

        index = materialize(
            spark, found.mapInPandas(_list_column(centres), fields(found, ", list int")), "lists"
        )
        # One row per list. Neighbours in number share a block, of the size of a cell.
        shape = index.groupBy("list").agg(
            F.min("domain").alias("a"), F.max("domain").alias("b"), F.count(F.lit(1)).alias("rows")
        ).collect()
        only = {r["list"]: r["a"] for r in shape if r["a"] == r["b"]}
        unused = sorted(set(range(len(centres))) - {r["list"] for r in shape})
        least = math.isqrt(2 * spark.sparkContext.defaultParallelism)
        cell_rows = max(1, min(CELL_ROWS, BLOCK_UNITS // size, -(-n // least)))
        counts = np.zeros(len(centres), dtype=np.int64)
        counts[[r["list"] for r in shape]] = [r["rows"] for r in shape]
        blocks = ((np.cumsum(counts) - counts) // cell_rows).astype("int32")
        block_of = spark.createDataFrame(list(enumerate(blocks.tolist())), "list int, block int")
        count = probes or probes_for(units, rows["domain"].to_numpy(), centres, k, recall)
        routes = searched.mapInPandas(
            _routes(centres, count, blocks, only, unused),
            fields(searched, ", block int, lists array<int>"),
        )
        placed = index.join(F.broadcast(block_of), "list")
        return score_routes(routes, placed, _cosine_cell(k), cell_rows, cell_rows)

    return _answers(targets, source, k, score)


def vector_check(vectors: DataFrame) -> DataFrame:
    """One row: number of vectors, shortest and longest size, smallest and largest norm."""
    return vectors.select(F.size("embedding").alias("s"), norm(F.col("embedding")).alias("n")).agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min("s").alias("min_size"),
        F.max("s").alias("max_size"),
        F.round(F.min("n"), 4).alias("min_norm"),
        F.round(F.max("n"), 4).alias("max_norm"),
    )
