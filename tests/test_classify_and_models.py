import numpy as np
import pytest

from newsgauge.functions import fixed_values as V
from newsgauge.operators import classify as CL
from newsgauge.operators import models as MO
from newsgauge.operators import one_pass
from newsgauge.session import new_path

SCHEMA = "article_id long, label string, " + ", ".join(f"{f} double" for f in V.FEATURES)


def table(spark, n=180, seed=8, missing=0.0, fake=0.45):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = rng.random() < fake
        x = np.clip(rng.normal(0.45 + 0.12 * y, 0.15, 5), 0, 1)
        cells = [None if rng.random() < missing else float(v) for v in x]
        rows.append((i * 3, "fake" if y else "real", *cells))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def arrays(rows):
    x = np.array([r[2:] for r in rows], float)
    return x, np.array([r[1] == "fake" for r in rows], int)


def test_standardize_uses_population_std(spark):
    rows, df = table(spark)
    x, _ = arrays(rows)
    out = np.array([tuple(r)[2:] for r in CL.standardize(df).orderBy("article_id").collect()])
    assert out == pytest.approx((x - x.mean(0)) / x.std(0))


def test_standardize_constant_and_null(spark):
    rows = [(1, "fake", 0.3, 0.1, None, 0.0, 1.0), (2, "real", 0.3, 0.3, 0.5, 0.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    rows = [tuple(r)[2:] for r in CL.standardize(df).orderBy("article_id").collect()]
    assert rows[0] == pytest.approx((0.0, -1.0, None, 0.0, 1.0))
    assert rows[1] == pytest.approx((0.0, 1.0, 0.0, 0.0, -1.0))


def test_distance_and_nearest_centroid_agree(spark):
    rows, df = table(spark)
    x, y = arrays(rows)
    z = (x - x.mean(0)) / x.std(0)
    to_fake = np.linalg.norm(z - z[y == 1].mean(0), axis=1)
    to_real = np.linalg.norm(z - z[y == 0].mean(0), axis=1)
    out = CL.affective_distance(df).orderBy("article_id").collect()
    assert [r.affective_score for r in out] == pytest.approx(to_real / (to_real + to_fake), abs=5.1e-5)
    assert [r.dist_to_fake for r in out] == pytest.approx(to_fake, abs=5.1e-5)
    near = [r.pred for r in CL.nearest_centroid(df).orderBy("article_id").collect()]
    assert near == [int(r.cluster_pred == "fake") for r in out]
    assert near == (to_fake < to_real).astype(int).tolist()


def test_equal_distances_are_real(spark):
    df = spark.createDataFrame([(1, "fake", *[0.2] * 5), (2, "real", *[0.2] * 5)], SCHEMA)
    rows = CL.affective_distance(df).collect()
    assert {(r.affective_score, r.cluster_pred) for r in rows} == {(None, "real")}


def dealt_folds(labels, folds=5):
    """Fold of each row: rows sorted by class (first seen first) are dealt round robin."""
    order = list(dict.fromkeys(labels))
    codes = [order.index(x) for x in labels]
    ranked = sorted(codes)
    sizes = [[ranked[i::folds].count(c) for i in range(folds)] for c in range(len(order))]
    queues = [[i for i in range(folds) for _ in range(sizes[c][i])] for c in range(len(order))]
    return [queues[c].pop(0) for c in codes]


@pytest.mark.parametrize("n, fake", [(180, 0.45), (23, 0.8), (7, 0.2), (101, 0.0)])
def test_contiguous_folds(spark, n, fake):
    rows, df = table(spark, n=n, fake=fake)
    out = [r.fold for r in CL.stratified_folds(df).orderBy("article_id").collect()]
    assert out == dealt_folds([r[1] for r in rows])


def test_shuffled_folds_partition_each_class(spark):
    rows, df = table(spark)
    out = CL.stratified_folds(df, seed=42).collect()
    assert sorted(r.article_id for r in out) == [r[0] for r in rows]
    for label in V.LABELS:
        sizes = [sum(r.fold == i and r.label == label for r in out) for i in range(5)]
        assert max(sizes) - min(sizes) <= 1
    again = {r.article_id: r.fold for r in CL.stratified_folds(df.repartition(7), seed=42).collect()}
    assert again == {r.article_id: r.fold for r in out}
    assert again != {r.article_id: r.fold for r in CL.stratified_folds(df).collect()}


@pytest.mark.parametrize("scale", ["fold", "global"])
def test_nearest_centroid_cv(spark, scale):
    rows, df = table(spark)
    x, y = arrays(rows)
    fold = np.array(dealt_folds([r[1] for r in rows]))
    expected = {}
    for i in range(5):
        train, test = fold != i, fold == i
        base = x if scale == "global" else x[train]
        z = (x - base.mean(0)) / base.std(0)
        f, r = z[train & (y == 1)].mean(0), z[train & (y == 0)].mean(0)
        pred = np.linalg.norm(z[test] - f, axis=1) < np.linalg.norm(z[test] - r, axis=1)
        expected[i] = (pred == y[test]).mean()
    out = {r.fold: r for r in CL.nearest_centroid_cv(df, scale=scale).collect()}
    assert {i: r.accuracy for i, r in out.items()} == pytest.approx(expected)
    assert {i: r.recall_weighted for i, r in out.items()} == pytest.approx(expected)


def test_report(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 9
    report = CL.classification_report(spark.createDataFrame(pairs, "y int, pred int"))
    out = {r["class"]: r for r in report.collect()}
    assert (out["fake"].precision, out["fake"].recall, out["fake"].support) == (6 / 9, 6 / 8, 8)
    assert (out["real"].precision, out["real"].recall, out["real"].support) == (9 / 11, 9 / 12, 12)
    fake = 2 * (6 / 9) * 0.75 / (6 / 9 + 0.75)
    real = 2 * (9 / 11) * 0.75 / (9 / 11 + 0.75)
    assert out["accuracy"].f1 == 15 / 20 and out["accuracy"].precision is None
    assert out["macro avg"].f1 == pytest.approx((fake + real) / 2)
    assert out["weighted avg"].f1 == pytest.approx((8 * fake + 12 * real) / 20)


def test_report_with_empty_cells(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, pred int")
    out = {r["class"]: r for r in CL.classification_report(df).collect()}
    assert (out["fake"].precision, out["fake"].recall, out["fake"].f1, out["fake"].support) == (0.0, 0.0, 0.0, 1)


def test_cv_summary_has_population_std(spark):
    scores = spark.createDataFrame([(0.5,), (0.7,), (0.9,)], "f1_weighted double")
    row = CL.cv_summary(scores, ["f1_weighted"]).first()
    assert row["mean"] == pytest.approx(0.7) and row["std"] == pytest.approx(np.std([0.5, 0.7, 0.9]))


def newton(x, y, c=1.0):
    """Minimum of |w|^2 / 2 + c * sum of log losses, intercept not penalised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = c * z.T @ (p - y) + penalty @ w
        w -= np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + penalty, gradient)
    return w


def test_logistic_regression_equals_newton(spark):
    rows, df = table(spark, missing=0.1)
    x, y = arrays(rows)
    x = np.where(np.isnan(x), 0.5, x)
    w = newton((x - x.mean(0)) / x.std(0), y)
    model = MO.train_classifier(df)
    out = {r.feature: r for r in MO.logreg_weights(model, df).collect()}
    assert [out[f].weight for f in V.FEATURES] == pytest.approx(w[:-1], abs=1e-5)
    assert all(r.direction == ("FAKE" if r.weight > 0 else "REAL") for r in out.values())
    order = [abs(r.weight) for r in MO.logreg_weights(model, df).collect()]
    assert order == sorted(order, reverse=True)
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-z @ w))
    scored = MO.classify_affect(model, df).orderBy("article_id").collect()
    assert [r.affect_pred for r in scored] == ["fake" if v > 0.5 else "real" for v in p]
    assert [r.affect_confidence for r in scored] == pytest.approx(np.maximum(p, 1 - p), abs=6e-5)


def test_saved_model_gives_the_same_answers(spark):
    _, df = table(spark, missing=0.1)
    model = MO.train_classifier(df)
    path = new_path(spark, "model-test")
    MO.save_model(model, path)
    columns = ["article_id", "affect_pred", "affect_confidence"]
    before = MO.classify_affect(model, df).select(columns).orderBy("article_id").collect()
    assert MO.classify_affect(MO.load_model(path), df).select(columns).orderBy("article_id").collect() == before


def test_single_record(spark):
    _, df = table(spark)
    schema = ", ".join(f"{f} double" for f in V.FEATURES)
    record = spark.createDataFrame([(0.391, 0.458, 0.458, 0.2, 0.421)], schema)
    row = MO.classify_affect(MO.train_classifier(df), record).first()
    assert row.affect_pred in V.LABELS and 0.5 <= row.affect_confidence <= 1.0


def test_logreg_cv(spark):
    _, df = table(spark)
    out = {r.metric: r for r in MO.logreg_cv(df).collect()}
    assert set(out) == {"f1_weighted", "accuracy", "precision_weighted", "recall_weighted"}
    assert out["accuracy"]["mean"] == pytest.approx(out["recall_weighted"]["mean"])
    assert 0.5 < out["f1_weighted"]["mean"] < 1.0


def test_kmeans(spark):
    rows, df = table(spark)
    out = MO.kmeans_labels(df, restarts=3).orderBy("article_id").collect()
    assert out == MO.kmeans_labels(df, restarts=3).orderBy("article_id").collect()
    share = {c: np.mean([r.label == "fake" for r in out if r.cluster == c]) for c in (0, 1)}
    fake_cluster = 0 if share[0] > share[1] else 1
    assert all(r.pred == int(r.cluster == fake_cluster) for r in out)
    x, _ = arrays(rows)
    z = (x - x.mean(0)) / x.std(0)
    clusters = np.array([r.cluster for r in out])
    centres = np.array([z[clusters == c].mean(0) for c in (0, 1)])
    nearest = ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (nearest == clusters).mean() > 0.98


def test_mixture_equals_the_textbook_steps_and_gains_with_restarts(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal([4, 1], [0.5, 2], (200, 2))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double")
    found = {n: one_pass.two_gaussians(df, ["a", "b"], "id", n) for n in (1, 2, 4)}
    assert found[1][1] <= found[2][1] + 1e-6 <= found[4][1] + 2e-6
    (low, high), reached = found[4]
    assert low.weight + high.weight == pytest.approx(1.0)
    assert low.mean == pytest.approx([0, 0], abs=0.3) and high.mean == pytest.approx([4, 1], abs=0.5)

    def density(g):
        covariance = np.linalg.inv(g.factor.T @ g.factor)
        off = x - g.mean
        far = np.einsum("ij,jk,ik->i", off, np.linalg.inv(covariance), off)
        return g.weight * np.exp(-far / 2) / (2 * np.pi * np.sqrt(np.linalg.det(covariance)))

    both = np.array([density(low), density(high)])
    assert np.log(both.sum(0)).mean() == pytest.approx(reached)
    share = both[1] / both.sum(0)
    (_, after) = one_pass._mixture_sums(df, ["a", "b"], {0: (low, high)})[0]
    assert after[1].weight == pytest.approx(share.mean())
    mean = (share[:, None] * x).sum(0) / share.sum()
    assert after[1].mean == pytest.approx(mean)
    covariance = ((x - mean).T * share) @ (x - mean) / share.sum() + 1e-6 * np.eye(2)
    assert np.linalg.inv(after[1].factor.T @ after[1].factor) == pytest.approx(covariance)


def test_mixture_of_equal_rows_and_of_none(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(9)], "id long, a double, b double")
    (low, high), _ = one_pass.two_gaussians(df, ["a", "b"], "id", 2)
    assert sorted([low.weight, high.weight]) == pytest.approx([0, 1], abs=1e-9)
    assert one_pass.two_gaussians(df.limit(0), ["a", "b"], "id", 2) is None


def test_gmm(spark):
    _, df = table(spark)
    out = MO.gmm_labels(df, restarts=2).collect()
    assert all(r.prob_0 + r.prob_1 == pytest.approx(1.0) for r in out)
    assert all(r.cluster == int(r.prob_1 > r.prob_0) for r in out)


def test_vote_tie_goes_to_cluster_one(spark):
    df = spark.createDataFrame([(0, "fake"), (0, "real"), (1, "fake"), (1, "real")], "cluster int, label string")
    assert MO._vote(df) == 1
    df = spark.createDataFrame([(0, "fake"), (1, "real")], "cluster int, label string")
    assert MO._vote(df) == 0


def test_method_summary(spark):
    pairs = [("a", 1, 1), ("a", 0, 0), ("b", 1, 0), ("b", 0, 0)]
    predictions = spark.createDataFrame(pairs, "method string, y int, pred int")
    out = {r.method: r for r in CL.method_summary(predictions).collect()}
    assert (out["a"].f1_weighted, out["a"].accuracy) == (1.0, 1.0)
    assert out["b"].accuracy == 0.5 and out["b"].f1_weighted == pytest.approx((2 / 3) / 2)


def test_unlabelled_rows_are_scored_but_not_learnt_from(spark):
    rows, df = table(spark)
    extra = [(10_000 + i, label, *[1.0] * 5) for i, label in enumerate([None, None, "other", ""])]
    more = df.unionByName(spark.createDataFrame(extra, SCHEMA))

    centroids = {r.label: tuple(r)[1:] for r in CL.class_centroids(more).collect()}
    model = CL.CentroidModel.fit(more)
    for label, centre in (("fake", model.fake), ("real", model.real)):
        original = [c * s + m for c, s, m in zip(centre, model.scaler.std, model.scaler.mean)]
        assert original == pytest.approx(centroids[label], abs=1e-4)
    assert CL.nearest_centroid(more).count() == len(rows)
    assert CL.affective_distance(more).count() == len(rows) + len(extra)

    def same(f):
        assert sorted(map(tuple, f(more).collect())) == sorted(map(tuple, f(df).collect()))

    same(lambda d: CL.stratified_folds(d).select("article_id", "fold"))
    same(lambda d: CL.nearest_centroid_cv(d))
    weights = lambda d: [r.weight for r in MO.logreg_weights(MO.train_classifier(d), d).collect()]
    assert weights(more) == pytest.approx(weights(df))
    assert MO.predict(MO.train_classifier(df), more).count() == len(rows)
    assert MO.kmeans_labels(more, restarts=2).count() == len(rows) + len(extra)


@pytest.mark.parametrize("only", ["fake", "real"])
def test_one_class_is_a_clear_error(spark, only):
    _, df = table(spark)
    one = df.where(f"label = '{only}'")
    with pytest.raises(ValueError, match="both classes"):
        CL.CentroidModel.fit(one)
    with pytest.raises(ValueError, match="both classes"):
        CL.nearest_centroid_cv(one)
