import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgauge.functions import affect as AF
from newsgauge.functions import fixed_values as V
from newsgauge.functions.ttest import two_sided_p
from newsgauge.operators import stats as ST

SCHEMA = (
    "article_id long, source string, label string, vreg double, voc int, "
    "eireg_anger double, eireg_fear double, eireg_joy double, eireg_sadness double"
)


def make(spark, rows):
    return spark.createDataFrame(
        [(i, r.get("source", "s"), r.get("label"), r.get("vreg"), r.get("voc"), r.get("anger"),
          r.get("fear"), r.get("joy"), r.get("sadness")) for i, r in enumerate(rows)],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def random_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        row = {"label": "fake" if rng.random() < 0.4 else "real", "source": f"s{i % 3}"}
        for c in ("vreg", "anger", "fear", "joy", "sadness"):
            row[c] = None if rng.random() < 0.05 else float(np.round(rng.random(), 2))
        row["voc"] = int(rng.integers(-3, 4))
        rows.append(row)
    return rows


def test_p_values_of_published_results():
    # t of the published tables; their p to the rounding of t.
    assert two_sided_p(-4.58, 420) == pytest.approx(6.14e-06, rel=2e-3)
    assert two_sided_p(-2.51, 420) == pytest.approx(0.0124, abs=5e-5)


@pytest.mark.parametrize("df", [1, 2, 5, 30, 420, 99_999, 999_999, 1_000_001, 10**11])
@pytest.mark.parametrize("t", [0.0, 0.3, 1.0, 1.96, 3.5])
def test_p_value_against_integral(t, df):
    x = np.linspace(0.0, t, 20_001)
    a = df / 2.0
    # Stirling difference of log-gammas, exact enough for large df.
    front = math.lgamma(a + 0.5) - math.lgamma(a) if a < 1e3 else 0.5 * math.log(a) - 1 / (8 * a)
    density = np.exp(front - 0.5 * math.log(df * math.pi) - (a + 0.5) * np.log1p(x * x / df))
    step = t / 20_000
    area = step / 3 * (density[0] + density[-1] + 4 * density[1:-1:2].sum() + 2 * density[2:-1:2].sum())
    assert two_sided_p(t, df) == pytest.approx(1 - 2 * area, abs=1e-9)


@pytest.mark.parametrize("df", [1e6 - 1, 1e6, 1e6 + 1, 1e7, 1e9])
@pytest.mark.parametrize("t", [0.3, 1.7, 2.0, 10.0, 30.0])
def test_p_value_of_large_samples(t, df):
    """One formula at every size: against a Simpson integral of the density."""
    x = np.linspace(t, t + 40, 400_001)
    half = 1 / (8 * df / 2) - 1 / (192 * (df / 2) ** 3)
    log_norm = 0.5 * math.log(df / 2) - half - 0.5 * math.log(math.pi * df)
    y = np.exp(log_norm - (df + 1) / 2 * np.log1p(x * x / df))
    area = (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    assert two_sided_p(t, df) == pytest.approx(2 * area, rel=1e-6)


def test_p_value_edges():
    assert two_sided_p(math.inf, 5) == 0.0
    assert two_sided_p(float("nan"), 5) is None
    assert two_sided_p(1.0, 0) is None


def test_ttest(spark, random_rows):
    out = {r.dimension: r for r in ST.ttest_by_label(make(spark, random_rows)).collect()}
    assert set(out) == set(V.AFFECT_COLUMNS)
    real = [r["anger"] for r in random_rows if r["label"] == "real" and r["anger"] is not None]
    fake = [r["anger"] for r in random_rows if r["label"] == "fake" and r["anger"] is not None]
    n1, n2 = len(real), len(fake)
    v1, v2 = np.var(real, ddof=1), np.var(fake, ddof=1)
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    t = (np.mean(real) - np.mean(fake)) / math.sqrt(pooled * (1 / n1 + 1 / n2))
    row = out["eireg_anger"]
    assert row.t == pytest.approx(t)
    assert row.real_var == pytest.approx(v1) and row.fake_var == pytest.approx(v2)
    assert row.p == pytest.approx(two_sided_p(t, n1 + n2 - 2))
    assert row.significant == (row.p < 0.05)


def test_ttest_of_tiny_and_constant_classes(spark):
    one = make(spark, [{"label": "fake", "anger": 0.1}, {"label": "real", "anger": 0.2}])
    row = ST.ttest_by_label(one, ["eireg_anger"]).first()
    assert row.t is None and row.p is None and row.significant is False
    constant = make(spark, [{"label": x, "anger": 0.3} for x in ("fake", "fake", "real", "real")])
    assert ST.ttest_by_label(constant, ["eireg_anger"]).first().t is None


def test_dominant_emotion(spark):
    rows = [
        {"anger": 0.4, "fear": 0.4, "joy": 0.1, "sadness": 0.4},
        {"fear": 0.2, "sadness": 0.2},
        {},
        {"anger": 0.1, "joy": 0.9},
    ]
    out = make(spark, rows).orderBy("article_id").select(AF.dominant_emotion()).collect()
    assert [r[0] for r in out] == ["anger", "fear", None, "joy"]


def test_vreg_bucket(spark):
    rows = [{"vreg": x} for x in (0.0, 0.39999, 0.4, 0.59999, 0.6, 1.0, None)]
    out = make(spark, rows).orderBy("article_id").select(AF.vreg_bucket(F.col("vreg"))).collect()
    assert [r[0] for r in out] == ["negative"] * 2 + ["neutral"] * 2 + ["positive"] * 3


def test_label_counts_drop_nulls(spark):
    df = make(spark, [{"label": "fake"}, {"label": None}, {"label": "real"}, {"label": "real"}])
    assert [tuple(r) for r in ST.label_counts(df).collect()] == [("real", 2), ("fake", 1)]


def test_high_emotion_counts_nulls_in_denominator(spark):
    rows = [{"label": "fake", "anger": x} for x in (0.5, 0.6, None, 0.9)]
    out = {r.emotion: r for r in ST.high_emotion_counts(make(spark, rows)).collect()}
    row = out["eireg_anger"]
    assert (row.high, row.low, row.high_pct, row.low_pct) == (2, 1, 50.0, 50.0)
    assert (out["eireg_joy"].high, out["eireg_joy"].low, out["eireg_joy"].low_pct) == (0, 0, 100.0)


def test_high_emotion_share(spark):
    rows = [{"label": "fake", "fear": x} for x in (0.9, 0.1)] + [{"label": "real", "fear": 0.2}]
    out = {r.emotion: r for r in ST.high_emotion_share(make(spark, rows)).collect()}
    assert (out["eireg_fear"].fake_pct, out["eireg_fear"].real_pct, out["eireg_fear"].lift) == (50.0, 0.0, None)


def test_crosstabs_sum_to_labels(spark, random_rows):
    df = make(spark, random_rows)
    counts = {r.label: r.n for r in ST.label_counts(df).collect()}
    for row in ST.bucket_crosstab(df).collect():
        assert row.negative + row.neutral + row.positive == counts[row.label]
    for table, values in ((ST.dominant_pct(df), V.INTENSITY_EMOTIONS), (ST.bucket_pct(df), V.VREG_BUCKETS)):
        for row in table.collect():
            assert sum(row[v] for v in values) == pytest.approx(100.0, abs=0.2)


def test_means(spark, random_rows):
    for row in ST.mean_affect(make(spark, random_rows), ["source", "label"], digits=9).collect():
        group = [r for r in random_rows if (r["source"], r["label"]) == (row.source, row.label)]
        xs = [r["joy"] for r in group if r["joy"] is not None]
        assert row.eireg_joy == pytest.approx(np.mean(xs))


@pytest.mark.parametrize("column, name", [("anger", "eireg_anger"), ("vreg", "vreg")])
def test_histogram_equals_numpy(spark, random_rows, column, name):
    out = ST.affect_histogram(make(spark, random_rows)).where(F.col("dimension") == name).collect()
    for label in V.LABELS:
        xs = [r[column] for r in random_rows if r["label"] == label and r[column] is not None]
        counts, edges = np.histogram(xs, bins=20)
        rows = sorted((r for r in out if r.label == label), key=lambda r: r.bin)
        assert [r.n for r in rows] == counts.tolist()
        assert [r.bin_start for r in rows] + [rows[-1].bin_end] == pytest.approx(edges.tolist())


def test_histogram_of_constant_group(spark):
    df = make(spark, [{"label": "fake", "anger": 0.3}] * 4)
    out = ST.affect_histogram(df, ["eireg_anger"]).orderBy("bin").collect()
    counts, _ = np.histogram([0.3] * 4, bins=20)
    assert [r.n for r in out] == counts.tolist()
