"""op10 and the near-duplicate stage against all pairs."""

import random
from collections import defaultdict
from math import comb

import numpy as np

from newsgauge.llm import jaccard_join as J
from newsgauge.llm.components import components, forest
from tests.llm.helpers import documents, edge_documents, no_documents, shingles


def brute(rows):
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[text or ""].append(doc_id)
    keys = list(texts)
    sets = [shingles(t) for t in keys]
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    links, parent = defaultdict(int), list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, t in enumerate(keys):
        groups[find(k)] += texts[t]
    return sorted(
        ((i, least(texts[t]), len(texts[t]) - 1, links[k], least(groups[find(k)]))
         for k, t in enumerate(keys) for i in texts[t]),
        key=str,
    )


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert sorted(map(tuple, J.jaccard_join(docs).collect()), key=str) == want
    return want


def near_copies(copies, edits, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for base in range(4):
        text = [word() for _ in range(150)]
        for i in range(copies):
            edited = list(text)
            for _ in range(rnd.randint(0, edits)):
                edited[rnd.randrange(150)] = word()
            rows.append((1000 * base + i, " ".join(edited)))
    rows += [(9000 + i, rows[i][1]) for i in range(0, 40, 3)]
    rnd.shuffle(rows)
    return rows


def test_links_on_the_given_documents(spark, sf_dir):
    check(documents(spark, sf_dir).select("doc_id", "text"))


def test_near_copies_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_TEXTS", 16)
    docs = spark.createDataFrame(near_copies(60, 8), "doc_id long, text string")
    want = check(docs)
    assert sum(r[3] for r in want) > 1000 and any(r[3] == 0 for r in want)


def test_edges(spark):
    check(edge_documents(spark, "node", "bucket").select("doc_id", "text", "node", "bucket"))
    assert J.jaccard_join(no_documents(spark)).collect() == []


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame(near_copies(20, 5), "doc_id long, text string").selectExpr(
        "*", "'x' as _node", "doc_id as group_id"
    )
    kept = J.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    want = {r[4] for r in brute([(r.doc_id, r.text) for r in docs.collect()])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    edges = edge_documents(spark)
    assert sorted(str(r.doc_id) for r in J.keep_one(edges).collect()) == sorted(
        {str(r[4]) for r in brute([(r.doc_id, r.text) for r in edges.collect()])}
    )
    assert J.keep_one(no_documents(spark)).collect() == []


def test_near_copy_without_an_id_leads_no_group(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(7, " ".join(words)), (None, " ".join([*words[:99], "x"])), (5, " ".join(["y", *words[1:]])),
            (None, " ".join([*words[:99], "x"])), (None, "alone without an id or a copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[4] for r in check(docs)} == {5, None}
    assert sorted(str(r.doc_id) for r in J.keep_one(docs).collect()) == ["5", "None"]


def test_pruning_bound_is_the_posterior():
    least = J.least_matches(0.8, 1e-9)
    for n, m in least.items():
        grid = (np.arange(200_000) + 0.5) / 200_000
        for k, kept in ((m, True), (m - 1, False)):
            density = comb(n, k) * (n + 1) * grid**k * (1 - grid) ** (n - k)
            assert (density[grid >= 0.8].mean() * 0.2 >= 1e-9) == kept


def test_intersections():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 500, 200).astype(np.uint64)) for _ in range(9)]
    left, right = np.triu_indices(9, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right)]
    assert J.intersections(sets, left, right, columns=64).tolist() == want


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    edges = spark.createDataFrame(
        [*chain, *hub, (5, 5), (None, 7), (2000, 2001)], "u long, v long"
    )
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(301))
    assert all(got[1000 + i] == 1000 for i in range(400)) and got[2001] == 2000
    assert len(got) == 301 + 400 + 2
    assert components(edges.where("false")).collect() == []


def test_forest():
    label = forest(np.array([0, 1, 4]), np.array([1, 2, 3]), 6)
    assert label.tolist() == [0, 0, 0, 3, 3, 5]
