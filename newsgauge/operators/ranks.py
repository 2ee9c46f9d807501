"""Exact ranks of very large groups, without sorting a group in one task.

A label has two values, so ``row_number() over (partition by label ..)`` would put a third
or more of all rows into one task. Where only the positions of a few cuts matter, the cut
values are found from histograms instead, and rows are then compared with them in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
SMALL = 10_000
HASH_SPAN = (0, (1 << 60) - 1)


@dataclass(frozen=True)
class Cut:
    """The r smallest rows are those below ``value``, plus ``taken`` of the ``ties`` equal to it."""

    value: int
    taken: int
    ties: int


@dataclass
class _Search:
    """Values lo..hi hold ``rows`` rows, of which the first ``wanted`` belong to the cut."""

    lo: int
    hi: int
    wanted: int
    rows: int | None

    def width(self) -> int:
        return (self.hi - self.lo) // BINS + 1

    def exact(self) -> bool:
        return (self.rows is not None and self.rows <= SMALL) or self.hi - self.lo < BINS


def hash_key(key: Column, seed: int) -> Column:
    """A pseudo-random 60-bit number of a key: the order of rows in a seeded shuffle."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def exact_cuts(
    df: DataFrame,
    group: Column,
    value: Column,
    ranks: dict[object, list[int]],
    span: tuple[int, int] | None = None,
) -> dict[tuple[object, int], Cut]:
    """The cut after the r smallest rows, for each group and rank r.

    ``value`` is an integer column without nulls, within ``span`` if that is known. Ranks of 0
    and beyond the group's size are left out. Every pass over the two columns brings at most
    ``SMALL`` counts per cut to the driver, and narrows its range by a factor of ``BINS``.
    """
    data = df.select(group.alias("g"), value.cast("bigint").alias("v"))
    searches: dict[tuple[object, int], _Search] = {}
    if span is None:
        spans = data.where(F.col("g").isin(list(ranks))).groupBy("g").agg(
            F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")
        )
        for row in spans.collect():
            for r in ranks[row.g]:
                searches[row.g, r] = _Search(row.lo, row.hi, r, row.n)
    else:
        searches = {(g, r): _Search(*span, r, None) for g, rs in ranks.items() for r in rs}

    found: dict[tuple[object, int], Cut] = {}
    while searches:
        counts = _counts(data, searches)
        narrowed = {}
        for cut, s in searches.items():
            at = _locate(counts[cut], s.wanted)
            if at is None:
                continue
            bin_number, inside, rows = at
            if s.exact():
                found[cut] = Cut(bin_number, inside, rows)
            else:
                start = s.lo + bin_number * s.width()
                narrowed[cut] = _Search(start, min(s.hi, start + s.width() - 1), inside, rows)
        searches = narrowed
    return found


def _counts(data: DataFrame, searches: dict) -> dict[object, dict[int, int]]:
    """Per search the number of rows per bin of its range, or per value where few are left."""
    cuts = list(searches)
    entries = []
    for i, (g, r) in enumerate(cuts):
        s = searches[g, r]
        inside = (F.col("g") == g) & F.col("v").between(s.lo, s.hi)
        bin_number = F.expr("v" if s.exact() else f"(v - ({s.lo}L)) div {s.width()}L")
        entries.append(F.when(inside, F.struct(F.lit(i).alias("cut"), bin_number.alias("bin"))))
    # Not filtered beforehand: a pushed-down filter would compute the value once more.
    rows = (
        data.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
        .groupBy("cut", "bin")
        .count()
        .collect()
    )
    result: dict[object, dict[int, int]] = {cut: {} for cut in cuts}
    for row in rows:
        result[cuts[row.cut]][row.bin] = row["count"]
    return result


def _locate(counts: dict[int, int], wanted: int) -> tuple[int, int, int] | None:
    """The bin of the ``wanted``-th row, how many of its rows belong, and its size."""
    seen = 0
    for at in sorted(counts):
        if 0 < wanted <= seen + counts[at]:
            return at, wanted - seen, counts[at]
        seen += counts[at]
    return None
