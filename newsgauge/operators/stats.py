"""Grouped statistics of affect scores. Each is one partial and one final aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as V
from newsgauge.functions.affect import dominant_emotion, vreg_bucket
from newsgauge.functions.ttest import t_p_value

EIREG = [f"eireg_{e}" for e in V.INTENSITY_EMOTIONS]


def label_counts(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def source_label_counts(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("label").isNotNull() & F.col("source").isNotNull())
        .groupBy("source", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "source", "label")
    )


def mean_affect(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] = tuple(V.AFFECT_COLUMNS),
    digits: int = 4,
) -> DataFrame:
    """Mean scores per group, nulls skipped, rows without a group left out."""
    present = df.where(_all_present(keys))
    return present.groupBy(*keys).agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])


def _all_present(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition


def _label_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``dimension`` and, for real and fake, n, mean and sample variance; one scan."""
    aggregates = []
    for c in columns:
        aggregates += [
            F.count(c).alias(f"n_{c}"),
            F.avg(c).alias(f"m_{c}"),
            F.var_samp(c).alias(f"v_{c}"),
        ]
    wide = df.where(F.col("label").isin(V.LABELS)).groupBy("label").agg(*aggregates)
    cells = [
        F.struct(
            F.lit(c).alias("dimension"),
            F.col(f"n_{c}").alias("n"),
            F.col(f"m_{c}").alias("m"),
            F.col(f"v_{c}").alias("v"),
        )
        for c in columns
    ]
    # Two rows from here on.
    long = wide.select("label", F.inline(F.array(*cells)))
    sides = [
        F.max(F.when(F.col("label") == label, F.col(x))).alias(f"{label}_{name}")
        for label in ("real", "fake")
        for x, name in (("n", "n"), ("m", "mean"), ("v", "var"))
    ]
    return long.groupBy("dimension").agg(*sides)


def ttest_by_label(df: DataFrame, columns: Sequence[str] = tuple(V.AFFECT_COLUMNS)) -> DataFrame:
    """Two-sided t-test of real against fake with pooled variance, nulls dropped."""
    n1, n2 = F.col("real_n"), F.col("fake_n")
    freedom = (n1 + n2 - 2).cast("double")
    pooled = F.try_divide((n1 - 1) * F.col("real_var") + (n2 - 1) * F.col("fake_var"), freedom)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    tested = (
        _label_moments(df, columns)
        .withColumn("freedom", freedom)
        .withColumn("t", F.try_divide(F.col("real_mean") - F.col("fake_mean"), error))
        .withColumn("p", t_p_value("t", "freedom"))
    )
    return tested.select(
        "dimension", "real_mean", "real_var", "fake_mean", "fake_var", "t", "p",
        F.coalesce(F.col("p") < 0.05, F.lit(False)).alias("significant"),
    )


def paper_table(df: DataFrame) -> DataFrame:
    """Summary table of the five dimensions without voc, significance as ``*``."""
    return ttest_by_label(df, V.FEATURES).withColumn(
        "significant", F.when(F.col("significant"), "*").otherwise("")
    )


def high_emotion_counts(df: DataFrame, threshold: float = V.HIGH_EMOTION) -> DataFrame:
    """Per label and emotion the rows above and not above a threshold.

    Rows without a score count in the share's denominator, in neither count.
    """
    aggregates = [F.count(F.lit(1)).alias("total")]
    for c in EIREG:
        aggregates += [
            F.count_if(F.col(c) > threshold).alias(f"high_{c}"),
            F.count_if(F.col(c) <= threshold).alias(f"low_{c}"),
        ]
    wide = df.where(F.col("label").isin(V.LABELS)).groupBy("label").agg(*aggregates)
    cells = [
        F.struct(
            F.lit(c).alias("emotion"), F.col(f"high_{c}").alias("high"), F.col(f"low_{c}").alias("low")
        )
        for c in EIREG
    ]
    share = F.col("high") * 100.0 / F.col("total")
    return wide.select("label", "total", F.inline(F.array(*cells))).select(
        "label", "emotion", "high", "low",
        F.round(share, 1).alias("high_pct"),
        F.round(100.0 - share, 1).alias("low_pct"),
    )


def high_emotion_share(df: DataFrame, threshold: float = V.HIGH_EMOTION) -> DataFrame:
    """Per emotion the share of high rows among fake and real, and their ratio."""
    aggregates = []
    for label in V.LABELS:
        chosen = F.col("label") == label
        for c in EIREG:
            hit = F.when(F.col(c) > threshold, 100.0).otherwise(0.0)
            aggregates.append(F.avg(F.when(chosen, hit)).alias(f"{label}_{c}"))
    row = df.where(F.col("label").isin(V.LABELS)).agg(*aggregates)
    cells = [
        F.struct(
            F.lit(c).alias("emotion"),
            F.col(f"fake_{c}").alias("fake_pct"),
            F.col(f"real_{c}").alias("real_pct"),
            F.try_divide(F.col(f"fake_{c}"), F.col(f"real_{c}")).alias("lift"),
        )
        for c in EIREG
    ]
    return row.select(F.inline(F.array(*cells)))


def _crosstab(df: DataFrame, value: Column, values: Sequence[str]) -> DataFrame:
    return (
        df.where(F.col("label").isNotNull())
        .select("label", value.alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("label")
        .agg(*[F.count_if(F.col("value") == v).alias(v) for v in values])
    )


def _row_percent(table: DataFrame, values: Sequence[str], digits: int = 1) -> DataFrame:
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return table.select(
        "label", *[F.round(F.try_divide(F.col(v) * 100.0, total), digits).alias(v) for v in values]
    )


def dominant_crosstab(df: DataFrame) -> DataFrame:
    return _crosstab(df, dominant_emotion(), V.INTENSITY_EMOTIONS)


def dominant_pct(df: DataFrame) -> DataFrame:
    return _row_percent(dominant_crosstab(df), V.INTENSITY_EMOTIONS)


def bucket_crosstab(df: DataFrame) -> DataFrame:
    return _crosstab(df, vreg_bucket(F.col("vreg")), V.VREG_BUCKETS)


def bucket_pct(df: DataFrame) -> DataFrame:
    return _row_percent(bucket_crosstab(df), V.VREG_BUCKETS)


def affect_histogram(
    df: DataFrame, columns: Sequence[str] = tuple(V.FEATURES), bins: int = 20
) -> DataFrame:
    """Per label and column the counts in equal bins over the group's own range.

    Bins are half open, the last one closed. A constant group gets a range of width 1 around
    its value. Empty bins are listed with 0.
    """
    rows = df.where(F.col("label").isin(V.LABELS)).select("label", *columns)
    aggregates = []
    for c in columns:
        aggregates += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    cells = [
        F.struct(
            F.lit(c).alias("dimension"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max")
        )
        for c in columns
    ]
    flat = F.col("min") == F.col("max")
    # At most len(LABELS) * len(columns) rows, so safe to broadcast.
    ranges = (
        rows.groupBy("label").agg(*aggregates)
        .select("label", F.inline(F.array(*cells)))
        .where(F.col("min").isNotNull())
        .select(
            "label", "dimension",
            F.when(flat, F.col("min") - 0.5).otherwise(F.col("min")).alias("lo"),
            F.when(flat, F.col("max") + 0.5).otherwise(F.col("max")).alias("hi"),
        )
    )
    values = [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("x")) for c in columns]
    scores = rows.select("label", F.inline(F.array(*values))).where(F.col("x").isNotNull())
    step = (F.col("hi") - F.col("lo")) / bins
    guess = F.least(
        F.floor((F.col("x") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
        F.lit(bins - 1),
    )
    at = F.col("guess")
    lower, upper = at * F.col("step") + F.col("lo"), (at + 1) * F.col("step") + F.col("lo")
    bin_number = (
        F.when(F.col("x") < lower, at - 1)
        .when((F.col("x") >= upper) & (at < bins - 1), at + 1)
        .otherwise(at)
    )
    filled = (
        scores.join(F.broadcast(ranges), ["label", "dimension"])
        .withColumn("step", step)
        .withColumn("guess", guess)
        .groupBy("label", "dimension", (bin_number + 1).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = ranges.withColumn("step", step).withColumn(
        "bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))
    )
    return frame.join(filled, ["label", "dimension", "bin"], "left").select(
        "label", "dimension", "bin",
        ((F.col("bin") - 1) * F.col("step") + F.col("lo")).alias("bin_start"),
        F.when(F.col("bin") == bins, F.col("hi"))
        .otherwise(F.col("bin") * F.col("step") + F.col("lo"))
        .alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
