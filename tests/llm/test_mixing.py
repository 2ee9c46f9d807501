"""op2: rates against plain projected gradient, the classifier on held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgauge.llm import mixing as M
from tests.llm.helpers import documents, edge_documents, no_documents

SF = "/root/testdata/sf0.01"


def labels_of(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def projected_gradient(p, tokens, goal, ridge, rounds=4000):
    share = tokens / tokens.sum()
    rates = ahead = np.ones(len(tokens))
    a = 1.0
    for _ in range(rounds):
        off = (ahead * share) @ p - goal
        after = np.maximum(0, ahead - (p @ off + ridge * (ahead - 1)) / (1 + ridge))
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        ahead, rates, a = after + (a - 1) / b * (after - rates), after, b
    return rates


def test_rates_are_the_least_squares_solution(spark):
    rnd = np.random.default_rng(4)
    p = rnd.dirichlet((2, 0.5, 0.3), 400)
    tokens = rnd.integers(1, 2000, 400)
    rows = [(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p))]
    scored = spark.createDataFrame(
        rows, "doc_id long, n_tokens long, p_high double, p_low double, p_toxic double"
    )
    for weights in ({"high": 0.5, "low": 0.5, "toxic": 0}, {"high": 2.0, "low": 0.1, "toxic": 0.3}):
        y = M.solve(scored, weights=weights, ridge=1e-2)
        got = [r.r for r in scored.orderBy("doc_id").select(M.rate(y).alias("r")).collect()]
        goal = np.array([weights[d] for d in M.DOMAINS])
        want = projected_gradient(p, tokens, goal, 1e-2)
        assert np.abs(np.array(got) - want).max() < 1e-5 and min(got) == 0


def test_totals_meet_the_weights(spark):
    rows = M.mixing_rates(documents(spark, SF), labels_of(spark)).toPandas()
    total = rows.n_tokens.sum()
    for d in M.DOMAINS:
        assert (rows.rate * rows.n_tokens * rows[f"p_{d}"]).sum() / total == pytest.approx(
            M.WEIGHTS[d], abs=5e-3
        )
    assert len(rows) == 1000 and (rows.rate >= 0).all()
    sums = rows[[f"p_{d}" for d in M.DOMAINS]].sum(axis=1)
    assert np.allclose(sums, 1)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = M.fit(docs, labels.where(~held))
    truth = M.labelled_domains(labels.where(held))
    some = docs.join(F.broadcast(truth), "doc_id")
    rows = M.posteriors(some, model, ["doc_id", "domain"]).toPandas()
    mean = rows.groupby("domain")[["p_high", "p_low", "p_toxic"]].mean()
    assert mean.loc["toxic", "p_toxic"] > 0.75 and mean.loc["high", "p_toxic"] < 0.03
    assert mean.loc["high", "p_high"] > 0.9


def test_edges(spark):
    docs = edge_documents(spark, "p_high", "_words", "n_tokens", "domain")
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (5, 1, 0), (6, 0, 0), (6, None, None), (None, 1, 1), (77, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    for table in (labels, labels.where("false")):
        rows = M.mixing_rates(docs, table).collect()
        assert len(rows) == docs.count()
        assert all(abs(r.p_high + r.p_low + r.p_toxic - 1) < 1e-9 and r.rate >= 0 for r in rows)
        assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert M.mixing_rates(no_documents(spark), labels).collect() == []
    # Of several labels the worst counts.
    worst = {r.doc_id: r.domain for r in M.labelled_domains(labels).collect()}
    assert worst == {1: "toxic", 5: "high", 6: "low", 77: "toxic"}


def test_mix_drops_toxic_and_keeps_the_rest(spark):
    docs = documents(spark, SF).withColumn("_in_0", F.lit("x"))
    kept = M.mix(docs, labels_of(spark))
    assert kept.dtypes == docs.dtypes
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    domains = {r.doc_id: r.domain for r in M.labelled_domains(labels_of(spark)).collect()}
    share = lambda d: np.mean([i in set(ids) for i, e in domains.items() if e == d])
    assert share("high") > 0.98 and share("toxic") < 0.5
    same = M.mix(edge_documents(spark), labels_of(spark).where("false"))
    assert same.count() == edge_documents(spark).count()
    assert M.mix(no_documents(spark), labels_of(spark)).collect() == []


@pytest.mark.parametrize("share", [0.3, 0.01, 0.001, 1e-6, 1e-11])
def test_rates_without_a_domain_do_not_depend_on_its_share(spark, share):
    """Certain documents of the domain go and others stay, whatever share of the tokens it has."""
    rnd = np.random.default_rng(5)
    clean = 1_000_000_000_000
    rows = [(i, clean // 1000, 0.95 - t, 0.05, t) for i, t in enumerate(rnd.uniform(0, 0.02, 1000).tolist())]
    toxic = max(1, round(clean * share / (1 - share) / 4))
    rows += [(2000 + i, toxic, 0.98 - p, 0.02, p) for i, p in enumerate((0.98, 0.97, 0.9, 0.7))]
    rows += [(3000, 1, 0.0, 0.0, 1.0), (3001, 1, 0.65, 0.0, 0.35), (3002, 1, 0.85, 0.0, 0.15)]
    scored = spark.createDataFrame(
        rows, "doc_id long, n_tokens long, p_high double, p_low double, p_toxic double"
    )
    y = M.solve_without(scored, ("toxic",))
    rates = {r.doc_id: r.r for r in scored.select("doc_id", M.rate(y).alias("r")).collect()}
    assert all(rates[i] < 0.4 for i in (2000, 2001, 2002, 2003)) and rates[3000] < 0.05
    assert all(rates[i] > 0.6 for i in [*range(1000), 3001, 3002])


def test_mix_drops_few_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = M.fit(docs, labels)
    scored = M.posteriors(docs, model, ["doc_id"]).toPandas()
    certain = sorted(scored[scored.p_toxic > 0.9].doc_id)
    clean = docs.join(
        spark.createDataFrame([(i,) for i in scored[scored.p_toxic > 0.3].doc_id], "doc_id long"),
        "doc_id", "left_anti",
    ).select(docs.columns)
    n = clean.count()
    assert n > 9000 and len(certain) > n // 100
    for some in (certain[: n // 100], certain[: n // 1000], certain[:1]):
        few = clean.unionByName(docs.where(F.col("doc_id").isin(some)))
        left = {r.doc_id for r in M.mix(few, labels, model=model).select("doc_id").collect()}
        assert not left & set(some) and len(left) == n
