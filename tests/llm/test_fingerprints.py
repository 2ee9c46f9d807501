"""op1: fingerprints against whole shingle sets, neighbours against a plain loop."""

import hashlib

import numpy as np
import pytest

from newsgauge.llm import minhash
from newsgauge.llm.blocks import Block
from newsgauge.llm.blocks import shingles as hashed
from tests.llm.helpers import documents, edge_documents, no_documents, shingles


def brute(rows):
    """doc_id, length, edited text and next text, from all rows in descending order."""
    key = lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or "")
    rows = sorted(rows, key=key)
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        yield doc_id, text, text[: len(text) - cut] + after[:cut], after


def check(df, rows):
    got = sorted(map(tuple, df.select("doc_id", "n_chars", "edited_sha256").collect()), key=str)
    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in brute(rows)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edited_texts_and_likeness(spark, sf_dir, ranges):
    docs = documents(spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = minhash.fingerprints(docs, ranges)
    check(df, rows)
    found = {r.doc_id: r for r in df.collect()}
    errors = []
    for doc_id, text, edited, after in brute(rows):
        for got, other in ((found[doc_id].near_edited, edited), (found[doc_id].near_next, after)):
            a, b = shingles(text), shingles(other)
            errors.append(got - (len(a & b) / max(1, len(a | b))))
    assert abs(np.mean(errors)) < 0.01 and max(map(abs, errors)) < 0.25


def test_edges(spark):
    docs = edge_documents(spark, "fingerprint", "range", "key")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = minhash.fingerprints(docs)
    check(df, rows)
    found = df.collect()
    by_text = {}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in found:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert len(r.fingerprint) == 4 * minhash.PERMUTATIONS
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(prints) == 1 for prints in by_text.values())
    assert minhash.fingerprints(no_documents(spark)).collect() == []


def test_single_document_is_its_own_next(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    (row,) = minhash.fingerprints(df).collect()
    assert row.near_next == 1.0


def test_signature_does_not_depend_on_the_block():
    texts = ["a b c d e f g", "", "x " * 9000, "a b c d e f g", "one"]
    whole = minhash.signatures(*hashed(Block.of(texts), 5))
    for i, text in enumerate(texts):
        alone = minhash.signatures(*hashed(Block.of([text]), 5))
        assert (alone[0] == whole[i]).all()
    assert (whole[1] == 0xFFFF).all()


def test_near_leaders_are_verified(spark):
    from tests.llm.test_jaccard_join import near_copies

    rows = near_copies(25, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = minhash.near_leaders(docs).collect()
    assert len(found) > 50
    for r in found:
        a, b = shingles(texts[r.doc_id]), shingles(texts[r.leader_id])
        assert r.leader_id < r.doc_id
        assert r.jaccard == pytest.approx(len(a & b) / len(a | b)) and r.jaccard >= 0.8
    # Every exact copy finds a document it equals.
    exact = {r.doc_id for r in found if r.jaccard == 1}
    assert all(i in exact for i in texts if i >= 9000)
    assert minhash.near_leaders(edge_documents(spark)).count() >= 1
    assert minhash.near_leaders(no_documents(spark)).collect() == []


def test_near_leaders_of_a_large_family(spark):
    """Texts that share a passage are at 0.79, pairs of them above 0.8."""
    core = " ".join(f"c{i}" for i in range(1000))
    rows = [(0, core + "".join(f" z{i}" for i in range(132)))]
    for k in range(60):
        both = "".join(f" p{k}.{i}" for i in range(16))
        for side in (0, 1):
            own = "".join(f" q{k}.{side}.{i}" for i in range(116))
            rows.append((1 + 2 * k + side, core + both + own))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t) for _, t in sorted(rows)]
    want = set()
    for i, a in enumerate(sets):
        near = [(len(a & b) / len(a | b), j) for j, b in enumerate(sets) if j != i]
        near = [(s, j) for s, j in near if s >= 0.8]
        if any(j < i for _, j in near):
            best, leader = min((-s, j) for s, j in near if j < i)
            want.add((i, leader, round(-best, 9), len(near)))
    assert len(want) == 60
    got = [(r.doc_id, r.leader_id, round(r.jaccard, 9), r.n_links) for r in minhash.near_leaders(docs).collect()]
    assert sorted(got) == sorted(want)
