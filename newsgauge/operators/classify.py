"""Scaling, class centroids, folds, distance scores and classification reports.

``fit`` steps bring a handful of numbers to the driver; applying them is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as V
from newsgauge.functions.affect import is_fake, label_name
from newsgauge.operators.ranks import HASH_SPAN, exact_cuts, hash_key

FOLDS = 5


# --- moments -------------------------------------------------------------------------------


@dataclass
class Moments:
    """Count, mean and population variance of each feature in a set of rows."""

    n: list[int]
    mean: list[float]
    var: list[float]

    def __add__(self, other: Moments) -> Moments:
        out = Moments([], [], [])
        for n1, m1, v1, n2, m2, v2 in zip(self.n, self.mean, self.var, other.n, other.mean, other.var):
            n = n1 + n2
            mean = (n1 * m1 + n2 * m2) / n if n else 0.0
            squares = n1 * (v1 + (m1 - mean) ** 2) + n2 * (v2 + (m2 - mean) ** 2)
            out.n.append(n)
            out.mean.append(mean)
            out.var.append(squares / n if n else 0.0)
        return out


def labelled(df: DataFrame) -> DataFrame:
    """Rows that are fake or real: what models are fitted to and judged by."""
    return df.where(F.col("label").isin(V.LABELS))


def _both(moments: dict, fake: object, real: object) -> tuple[Moments, Moments]:
    for key, name in ((fake, "fake"), (real, "real")):
        if key not in moments:
            raise ValueError(f"both classes are needed, but there is no {name} row to fit to")
    return moments[fake], moments[real]


def column_moments(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> dict[tuple, Moments]:
    """Moments per key, one aggregate. Keys are labels and folds, so there are few."""
    aggregates = []
    for f in features:
        aggregates += [
            F.count(f).alias(f"n_{f}"), F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}")
        ]

    def read(row: Row) -> Moments:
        return Moments(
            [row[f"n_{f}"] for f in features],
            [row[f"m_{f}"] or 0.0 for f in features],
            [row[f"v_{f}"] or 0.0 for f in features],
        )

    rows = df.groupBy(*keys).agg(*aggregates).collect()
    return {tuple(row[k] for k in keys): read(row) for row in rows}


# --- scaling -------------------------------------------------------------------------------


@dataclass
class Scaler:
    """``(x - mean) / std`` with the population std; a std of 0 counts as 1."""

    features: list[str]
    mean: list[float]
    std: list[float]

    @classmethod
    def of(cls, moments: Moments, features: Sequence[str]) -> Scaler:
        return cls(list(features), moments.mean, [math.sqrt(v) or 1.0 for v in moments.var])

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str] = tuple(V.FEATURES)) -> Scaler:
        return cls.of(column_moments(df, [], features)[()], features)

    def columns(self) -> list[Column]:
        return [(F.col(f) - m) / s for f, m, s in zip(self.features, self.mean, self.std)]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(dict(zip(self.features, self.columns())))

    def scale(self, point: Sequence[float]) -> list[float]:
        return [(x - m) / s for x, m, s in zip(point, self.mean, self.std)]


def standardize(df: DataFrame, features: Sequence[str] = tuple(V.FEATURES)) -> DataFrame:
    return Scaler.fit(df, features).transform(df)


# --- centroids -----------------------------------------------------------------------------


def class_centroids(df: DataFrame, features: Sequence[str] = tuple(V.FEATURES)) -> DataFrame:
    """Mean features of the real and the fake class in the original scale."""
    return (
        labelled(df)
        .groupBy("label")
        .agg(*[F.round(F.avg(f), 4).alias(f) for f in features])
    )


@dataclass
class CentroidModel:
    """Centroids of both classes on scaled features; distances are column expressions."""

    scaler: Scaler
    fake: list[float]
    real: list[float]

    @classmethod
    def of(cls, fake: Moments, real: Moments, features: Sequence[str], scaler: Scaler | None = None):
        scaler = scaler or Scaler.of(fake + real, features)
        return cls(scaler, scaler.scale(fake.mean), scaler.scale(real.mean))

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str] = tuple(V.FEATURES)) -> CentroidModel:
        data = labelled(df).select(is_fake(F.col("label")).alias("y"), *features)
        return cls.of(*_both(column_moments(data, ["y"], features), (1,), (0,)), features)

    def distances(self) -> tuple[Column, Column]:
        """Euclidean distance of a row to the fake and to the real centroid."""

        def to(centre: list[float]) -> Column:
            squares = [(x - c) * (x - c) for x, c in zip(self.scaler.columns(), centre)]
            return F.sqrt(sum(squares[1:], squares[0]))

        return to(self.fake), to(self.real)

    def prediction(self) -> Column:
        """1 where the fake centroid is nearer; a tie is real."""
        to_fake, to_real = self.distances()
        return (to_fake < to_real).cast("int")


def nearest_centroid(df: DataFrame, features: Sequence[str] = tuple(V.FEATURES)) -> DataFrame:
    """``article_id, y, pred`` of labelled rows, with centroids of all of them."""
    model = CentroidModel.fit(df, features)
    return labelled(df).select("article_id", is_fake(F.col("label")).alias("y"), model.prediction().alias("pred"))


def affective_distance(df: DataFrame, features: Sequence[str] = tuple(V.FEATURES)) -> DataFrame:
    """Distances of every row to both centroids, the share of the real one, and the nearer class.

    The class is decided before rounding; a tie is real.
    """
    to_fake, to_real = CentroidModel.fit(df, features).distances()
    return df.select("article_id", "label", to_fake.alias("f"), to_real.alias("r")).select(
        "article_id", "label",
        F.round(F.try_divide(F.col("r"), F.col("f") + F.col("r")), 4).alias("affective_score"),
        F.round("f", 4).alias("dist_to_fake"),
        F.round("r", 4).alias("dist_to_real"),
        F.when(F.col("f") < F.col("r"), "fake").otherwise("real").alias("cluster_pred"),
    )


# --- folds ---------------------------------------------------------------------------------


def stratified_folds(
    df: DataFrame, key: str = "article_id", folds: int = FOLDS, seed: int | None = None
) -> DataFrame:
    """Add ``fold`` 0..folds-1, stratified by label: runs of key order, or of a seeded shuffle.

    Fold sizes are those of dealing the rows, sorted by class, round robin to the folds.
    Unlabelled rows belong to no class and are left out.
    Rows are compared with at most ``folds - 1`` cut values per class; none is shuffled.
    """
    df = labelled(df)
    y = is_fake(F.col("label"))
    order = F.col(key).cast("bigint") if seed is None else hash_key(F.col(key), seed)
    data = df.select(y.alias("y"), order.alias("o"), F.col(key).alias("k"))
    classes = data.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).collect()

    ends: dict[int, list[int]] = {}
    start = 0
    for row in sorted(classes, key=lambda r: r["first"]):
        stop = start + row.n
        sizes = [len(range(start + (i - start) % folds, stop, folds)) for i in range(folds)]
        ends[row.y] = [sum(sizes[: i + 1]) for i in range(folds - 1)]
        start = stop

    ranks = {g: sorted(set(r)) for g, r in ends.items()}
    cuts = exact_cuts(data, F.col("y"), F.col("o"), ranks, None if seed is None else HASH_SPAN)
    size = {row.y: row.n for row in classes}
    fold = F.lit(0)
    for g, wanted in ends.items():
        for r in wanted:
            if (g, r) in cuts:
                # Keys are unique; rows that share a hash value stay together below the cut.
                beyond = order > cuts[g, r].value
            else:
                beyond = F.lit(r < size[g])
            fold = fold + ((y == g) & beyond).cast("int")
    return df.withColumn("fold", fold)


def nearest_centroid_cv(
    df: DataFrame,
    features: Sequence[str] = tuple(V.FEATURES),
    folds: int = FOLDS,
    scale: str = "fold",
) -> DataFrame:
    """Weighted F1 and accuracy of nearest centroid per fold, trained on the other folds.

    All training sets come from one aggregate by fold and class. ``scale="global"`` scales
    with all rows, test rows included.
    """
    data = stratified_folds(df, folds=folds).select(
        "article_id", "fold", is_fake(F.col("label")).alias("y"), *features
    )
    parts = column_moments(data, ["fold", "y"], features)

    def total(y: int | None, without: int | None) -> Moments:
        chosen = [m for (f, c), m in parts.items() if f != without and (y is None or c == y)]
        if not chosen:
            raise ValueError("both classes are needed in the training rows of every fold")
        result = chosen[0]
        for m in chosen[1:]:
            result = result + m
        return result

    everything = Scaler.of(total(None, None), features)
    prediction = F.lit(None).cast("int")
    for i in range(folds):
        model = CentroidModel.of(
            total(1, i), total(0, i), features, everything if scale == "global" else None
        )
        prediction = F.when(F.col("fold") == i, model.prediction()).otherwise(prediction)
    scored = data.select("fold", "y", prediction.alias("pred"))
    return weighted_scores(scored, ["fold"])


def cv_summary(fold_scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population std of fold scores, one row per metric."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics]
    return (
        fold_scores.select(F.inline(F.array(*cells)))
        .groupBy("metric")
        .agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    )


# --- reports -------------------------------------------------------------------------------


def _confusion(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    def cell(y: int, pred: int) -> Column:
        return F.count_if((F.col("y") == y) & (F.col("pred") == pred))

    return predictions.groupBy(*keys).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _class_scores(hit: Column, false_hit: Column, missed: Column) -> Column:
    precision, recall = _ratio(hit, hit + false_hit), _ratio(hit, hit + missed)
    return F.struct(
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
        (hit + missed).alias("support"),
    )


def _with_scores(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _confusion(predictions, keys).select(
        *keys,
        _class_scores(tn, fn, fp).alias("real"),
        _class_scores(tp, fp, fn).alias("fake"),
        (tp + fp + fn + tn).alias("n"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def _weighted(metric: str) -> Column:
    total = F.col(f"real.{metric}") * F.col("real.support") + F.col(f"fake.{metric}") * F.col(
        "fake.support"
    )
    return _ratio(total, F.col("n"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support of both classes, accuracy, macro and weighted average."""
    metrics = ["precision", "recall", "f1"]

    def line(name: str, values: list[Column], support: Column) -> Column:
        cells = [v.alias(m) for v, m in zip(values, metrics)]
        return F.struct(F.lit(name).alias("class"), *cells, support.alias("support"))

    lines = [
        line(c, [F.col(f"{c}.{m}") for m in metrics], F.col(f"{c}.support")) for c in ("real", "fake")
    ]
    nothing = F.lit(None).cast("double")
    lines.append(line("accuracy", [nothing, nothing, F.col("accuracy")], F.col("n")))
    macro = [(F.col(f"real.{m}") + F.col(f"fake.{m}")) / 2 for m in metrics]
    lines.append(line("macro avg", macro, F.col("n")))
    lines.append(line("weighted avg", [_weighted(m) for m in metrics], F.col("n")))
    return _with_scores(predictions, []).select(F.inline(F.array(*lines)))


def weighted_scores(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: accuracy and weighted precision, recall and f1."""
    return _with_scores(predictions, keys).select(
        *keys,
        _weighted("f1").alias("f1_weighted"),
        F.col("accuracy"),
        _weighted("precision").alias("precision_weighted"),
        _weighted("recall").alias("recall_weighted"),
    )


def method_summary(predictions: DataFrame) -> DataFrame:
    """Weighted F1 and accuracy per ``method`` of rows ``(method, y, pred)``."""
    return weighted_scores(predictions, ["method"]).select("method", "f1_weighted", "accuracy")


def decode_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label_pred", label_name(F.col("pred")))
