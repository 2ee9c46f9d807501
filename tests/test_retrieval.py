import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgauge.functions import vectors as VE
from newsgauge.operators import grid as GR
from newsgauge.operators import retrieval as RE

SCHEMA = "article_id long, domain string, embedding array<float>"


def brute_force(rows, k):
    out = set()
    units = {i: np.float32(v).astype(float) for i, _, v in rows}
    units = {i: v / np.sqrt((v * v).sum()) for i, v in units.items() if (v * v).sum() > 0}
    domain = {i: d for i, d, _ in rows}
    for i, v in units.items():
        scored = [(-round(float(v @ w), 9), j) for j, w in units.items() if domain[j] != domain[i]]
        for rank, (score, j) in enumerate(sorted(scored)[:k], 1):
            out.add((i, j, round(-score, 6), rank))
    return out


def clustered(n=240, dims=8, seed=1):
    """A third of the rows are copies of one vector, the rest lie around a few centres."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = np.ones(dims) if i % 3 == 0 else centres[i % 6] + 0.05 * rng.normal(size=dims)
        rows.append((i, f"d{rng.integers(3)}", [float(x) for x in np.float32(v)]))
    rows.append((n, "d0", [0.0] * dims))
    rows.append((n + 1, "d9", [float(x) for x in np.float32(rng.normal(size=dims))]))
    return rows


def answers(df):
    return {(r.article_id, r.neighbour_id, round(r.cosine, 6), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_top_k_equals_brute_force(spark, block_rows):
    rows = clustered()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert answers(RE.retrieve_top_k(df, 4, block_rows=block_rows)) == brute_force(rows, 4)


def test_long_vectors_make_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(GR, "BLOCK_UNITS", 100)
    rows = clustered()
    df = spark.createDataFrame(rows, SCHEMA)
    assert answers(RE.retrieve_top_k(df, 4)) == brute_force(rows, 4)


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_targets_and_source(spark, block_rows):
    rows = clustered()
    targets, source = [r for r in rows if r[0] % 4], [r for r in rows if r[0] % 4 == 0]
    out = RE.retrieve_top_k(
        spark.createDataFrame(targets, SCHEMA), 3,
        source=spark.createDataFrame(source, SCHEMA), block_rows=block_rows,
    )
    asked, offered = {r[0] for r in targets}, {r[0] for r in source}
    units = {i: np.float32(v).astype(float) for i, _, v in rows}
    units = {i: v / np.sqrt((v * v).sum()) for i, v in units.items() if (v * v).sum() > 0}
    domain = {i: d for i, d, _ in rows}
    want = set()
    for i in asked & set(units):
        scored = sorted((-round(float(units[i] @ units[j]), 9), j)
                        for j in offered & set(units) if domain[i] != domain[j])[:3]
        want |= {(i, j, round(-s, 6), n) for n, (s, j) in enumerate(scored, 1)}
    assert answers(out) == want


def test_fewer_candidates_than_k(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "b", [0.5, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert answers(RE.retrieve_top_k(df, 4)) == brute_force(rows, 4)


def test_unusable_vectors_take_no_part(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.1]), (3, "b", [float("nan"), 1.0])]
    rows += [(4, "b", [0.0, 0.0]), (5, "b", None), (6, None, [1.0, 0.0])]
    out = RE.retrieve_top_k(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert sorted((r.article_id, r.neighbour_id) for r in out) == [(1, 2), (2, 1)]


def test_one_domain_has_no_neighbours(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [2.0])], SCHEMA)
    assert RE.retrieve_top_k(df, 4).count() == 0


def recall(found, exact):
    return len({r[:2] for r in found} & {r[:2] for r in exact}) / len(exact)


def test_lists_find_most_neighbours(spark):
    """Recall against brute force, over the given vectors and over a table with a hot vector."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr(
        "vec_id as article_id", "label as domain", "embedding"
    )
    exact = answers(RE.retrieve_top_k(vectors, 4))
    found = answers(RE.retrieve_by_lists(vectors, 4))
    assert recall(found, exact) >= 0.9
    assert {r[0] for r in found} == {r[0] for r in exact}
    rows = clustered(900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert recall(answers(RE.retrieve_by_lists(df, 4)), brute_force(rows, 4)) >= 0.9


def test_all_lists_probed_is_exact(spark):
    rows = clustered()
    df = spark.createDataFrame(rows, SCHEMA)
    found = answers(RE.retrieve_by_lists(df, 4, lists=5, probes=5, sample_values=400))
    assert found == brute_force(rows, 4)
    targets, source = [r for r in rows if r[0] % 4], [r for r in rows if r[0] % 4 == 0]
    both = [spark.createDataFrame(r, SCHEMA) for r in (targets, source)]
    assert answers(RE.retrieve_by_lists(both[0], 3, both[1], lists=4, probes=4)) == answers(
        RE.retrieve_top_k(both[0], 3, both[1])
    )


def test_lists_of_nothing(spark):
    assert RE.retrieve_by_lists(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [2.0])], SCHEMA)
    assert RE.retrieve_by_lists(one).collect() == []


def test_invariants(spark, sf_dir):
    from newsgauge.plans import views

    vectors = views.vectors(spark, sf_dir)
    out = RE.retrieve_top_k(vectors, 4)
    per_article = out.groupBy("article_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    assert {tuple(r.ranks) for r in per_article.collect()} == {(1, 2, 3, 4)}
    assert per_article.count() == vectors.count()
    domain = vectors.select("article_id", "domain")
    other = domain.select(F.col("article_id").alias("neighbour_id"), F.col("domain").alias("other"))
    assert out.join(domain, "article_id").join(other, "neighbour_id").where("domain = other").count() == 0


def test_vector_functions(spark):
    pairs = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(VE.norm(a).alias("n"), VE.cosine(a, b).alias("c"), VE.unit(a).alias("u")).collect()
    assert [r.n for r in rows] == [5.0, 0.0]
    assert rows[0].c == pytest.approx(0.96) and rows[1].c is None
    assert rows[0].u == pytest.approx([0.6, 0.8]) and rows[1].u is None


def test_mean_pool(spark):
    tokens = [[1.0, 2.0], [3.0, 4.0], [5.0, 9.0]]
    schema = "t array<array<float>>, s array<array<array<float>>>"
    df = spark.createDataFrame([(tokens, [tokens, tokens])], schema)
    t, s = VE.mean_pool(F.col("t")), VE.mean_pool_nested(F.col("s"))
    row = df.select(t.alias("t"), s.alias("s")).first()
    assert row.t == [3.0, 5.0] and row.s == [3.0, 5.0]


def test_routes_are_bounded_and_name_a_row_once_per_block(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(RE, "ROUTE_VALUES", 400)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    blocks = (np.arange(20) // 7).astype("int32")
    batch = pd.DataFrame({"left_id": range(100), "domain": "a", "embedding": list(rng.normal(size=(100, 8)))})
    made = list(RE._routes(centres, 10, blocks, {}, [])(iter([batch])))
    assert max(len(m) for m in made) * 8 <= 400
    routes = pd.concat(made)
    assert not routes.duplicated(["left_id", "block"]).any()
    assert routes.groupby("left_id")["lists"].apply(lambda x: sum(map(len, x))).eq(10).all()
    assert all((blocks[x] == b).all() for x, b in zip(routes["lists"], routes["block"]))


def test_list_search_is_the_same_in_small_cells(spark, monkeypatch):
    rows = clustered()
    df = spark.createDataFrame(rows, SCHEMA)
    whole = answers(RE.retrieve_by_lists(df, 4, lists=12, probes=5))
    monkeypatch.setattr(RE, "CELL_ROWS", 16)
    monkeypatch.setattr(RE, "CHUNK_PAIRS", 64)
    assert answers(RE.retrieve_by_lists(df, 4, lists=12, probes=5)) == whole
