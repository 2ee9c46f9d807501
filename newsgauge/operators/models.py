"""Clustering and classification with Spark ML on scaled affect features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.functions import fixed_values as V
from newsgauge.functions.affect import is_fake, label_name
from newsgauge.operators import one_pass
from newsgauge.operators.classify import (
    FOLDS,
    CentroidModel,
    Scaler,
    column_moments,
    cv_summary,
    labelled,
    stratified_folds,
    weighted_scores,
)

MAX_ITERATIONS = 1000


# --- clustering ----------------------------------------------------------------------------


def _vote(clustered: DataFrame) -> int:
    """The cluster with the larger share of fake articles; a tie is cluster 1."""
    shares = {
        row.cluster: row.share
        for row in labelled(clustered).groupBy("cluster").agg(F.avg(is_fake(F.col("label"))).alias("share")).collect()
    }
    return 0 if shares.get(0, 0.0) > shares.get(1, 0.0) else 1


def kmeans_labels(
    df: DataFrame,
    features: Sequence[str] = tuple(V.FEATURES),
    restarts: int = 20,
    seed: int = V.SEED,
) -> DataFrame:
    """Two clusters, best of several starts: ``article_id, label, cluster, pred``.

    All restarts share their passes over the rows (``one_pass``); cluster 0 has the smaller centre.
    """
    z = list(features)
    scaled = Scaler.fit(df, features).transform(df).select("article_id", "label", *z)
    data = scaled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = one_pass.two_means(data, z, "article_id", restarts, seed)
        if found is None:
            return data.sparkSession.createDataFrame(
                [], f"article_id {data.schema['article_id'].dataType.simpleString()}, label string, "
                "cluster int, pred int",
            )
        cluster = one_pass.nearest_of_two(z, found[0])
        fake_cluster = _vote(data.withColumn("cluster", cluster))
    finally:
        data.unpersist()
    return scaled.select(
        "article_id", "label", cluster.alias("cluster"),
        (cluster == fake_cluster).cast("int").alias("pred"),
    )


def gmm_labels(
    df: DataFrame,
    features: Sequence[str] = tuple(V.FEATURES),
    restarts: int = 10,
    seed: int = V.SEED,
) -> DataFrame:
    """Two Gaussian components, best of several starts, with the probability of each.

    All restarts share their passes over the rows (``one_pass``); component 0 has the smaller mean.
    """
    z = list(features)
    scaled = Scaler.fit(df, features).transform(df).select("article_id", "label", *z)
    data = scaled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = one_pass.two_gaussians(data, z, "article_id", restarts, seed)
        if found is None:
            return data.sparkSession.createDataFrame(
                [], f"article_id {data.schema['article_id'].dataType.simpleString()}, label string, "
                "cluster int, pred int, prob_0 double, prob_1 double",
            )
        lead = found[0][1].score_column(z) - found[0][0].score_column(z)
        cluster = (lead > 0).cast("int")
        fake_component = _vote(data.withColumn("cluster", cluster))
    finally:
        data.unpersist()
    return scaled.select(
        "article_id", "label", cluster.alias("cluster"),
        (cluster == fake_component).cast("int").alias("pred"),
        (1.0 / (1.0 + F.exp(lead))).alias("prob_0"), (1.0 / (1.0 + F.exp(-lead))).alias("prob_1"),
    )


# --- logistic regression -------------------------------------------------------------------


def _classifier(df: DataFrame, features: Sequence[str], c: float) -> PipelineModel:
    """Fill, scale and classify as one model. Needs ``y``; missing scores count as 0.5."""
    filled = df.na.fill(V.MISSING_FEATURE, subset=list(features)).select("y", *features)
    moments = column_moments(filled, [], features)[()]
    scaler = Scaler.of(moments, features)
    scaled = ", ".join(
        f"(coalesce(cast({f} as double), {V.MISSING_FEATURE}D) - ({m!r}D)) / ({s!r}D) AS scaled_{f}"
        for f, m, s in zip(features, scaler.mean, scaler.std)
    )
    names = [f"scaled_{f}" for f in features]
    stages = [
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=names, outputCol="features"),
        LogisticRegression(
            labelCol="y", regParam=1.0 / (c * moments.n[0]), elasticNetParam=0.0, standardization=False,
            maxIter=MAX_ITERATIONS, tol=1e-10,
        ),
    ]
    return Pipeline(stages=stages).fit(filled)


def train_classifier(
    df: DataFrame, features: Sequence[str] = tuple(V.FEATURES), c: float = 1.0
) -> PipelineModel:
    """L2-regularised logistic regression of fake against real on scaled features."""
    data = labelled(df).select(is_fake(F.col("label")).alias("y"), *features)
    return _classifier(data, features, c)


def logreg_weights(
    model: PipelineModel, df: DataFrame, features: Sequence[str] = tuple(V.FEATURES)
) -> DataFrame:
    """Weights sorted by absolute value, with the class each points to."""
    weights = [(f, float(w)) for f, w in zip(features, model.stages[-1].coefficients)]
    table = df.sparkSession.createDataFrame(weights, "feature string, weight double")
    return table.select(
        "feature", "weight", F.when(F.col("weight") > 0, "FAKE").otherwise("REAL").alias("direction")
    ).orderBy(F.desc(F.abs("weight")))


def classify_affect(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``affect_pred`` and ``affect_confidence`` to every row; missing scores count as 0.5."""
    kept = [F.col(c) for c in df.columns]
    scored = model.transform(df)
    return scored.select(
        *kept,
        label_name(F.col("prediction")).alias("affect_pred"),
        F.round(F.array_max(vector_to_array("probability")), 4).alias("affect_confidence"),
    )


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``article_id, y, pred`` of labelled rows."""
    return model.transform(labelled(df)).select(
        "article_id", is_fake(F.col("label")).alias("y"), F.col("prediction").cast("int").alias("pred")
    )


def logreg_cv(
    df: DataFrame,
    features: Sequence[str] = tuple(V.FEATURES),
    folds: int = FOLDS,
    seed: int = V.SEED,
) -> DataFrame:
    """Mean and std of the weighted scores over shuffled stratified folds.

    Each fold's model is fitted, scaler included, on the other folds; all of them share their passes
    over the rows (``one_pass``).
    """
    data = (
        stratified_folds(df, folds=folds, seed=seed)
        .select("fold", is_fake(F.col("label")).alias("y"), *features)
        .na.fill(V.MISSING_FEATURE, subset=list(features))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        models = one_pass.FoldModels.fit(data, features, folds)
        scored = data.select("fold", "y", models.prediction().alias("pred"))
        metrics = ["f1_weighted", "accuracy", "precision_weighted", "recall_weighted"]
        rows = cv_summary(weighted_scores(scored, ["fold"]), metrics).collect()
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "metric string, mean double, std double")


def all_methods(df: DataFrame, restarts: tuple[int, int] = (20, 10)) -> DataFrame:
    """Predictions of the four clustering methods for labelled rows: ``(method, y, pred)``."""
    y = is_fake(F.col("label")).alias("y")
    centroid = labelled(df).select(y, CentroidModel.fit(df).prediction().alias("pred"))
    frames = {
        "KMeans": labelled(kmeans_labels(df, restarts=restarts[0])).select(y, "pred"),
        "Nearest Centroid": centroid,
        "GMM": labelled(gmm_labels(df, restarts=restarts[1])).select(y, "pred"),
        "Affective Distance": centroid,
    }
    result = None
    for name, frame in frames.items():
        frame = frame.select(F.lit(name).alias("method"), "y", "pred")
        result = frame if result is None else result.unionByName(frame)
    return result


# --- saving --------------------------------------------------------------------------------


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
