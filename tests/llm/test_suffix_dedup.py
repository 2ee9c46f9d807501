"""op6 against all 50-byte strings, and the merge it rests on."""

import random

import numpy as np
import pytest

from newsgauge.llm import chunks, suffix_dedup
from newsgauge.llm.anchors import GRAM, LENGTH, Spans, sliding_minimum
from newsgauge.llm.blocks import Block
from newsgauge.llm.merge import common_prefix, front_code, front_decode, merge_runs
from tests.llm.helpers import documents, edge_documents, no_documents


def brute(rows, length=LENGTH):
    order = lambda i: -(1 << 63) if i is None else i
    encoded = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in encoded:
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, b in encoded:
        gone = np.zeros(len(b), dtype=bool)
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < order(i):
                gone[j : j + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
        spans = tuple(map(tuple, edges.reshape(-1, 2).tolist()))
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def check(docs):
    got = [
        (r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.removed), bytes(r.kept))
        for r in suffix_dedup.remove_repeats(docs).collect()
    ]
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(got, key=str) == want
    return want


def repeats():
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("abcde é") for _ in range(n))
    base = [some(rnd.randint(0, 300)) for _ in range(12)]
    rows = []
    for i in range(200):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randint(0, 150)
            parts.append(rnd.choice(base)[at : at + rnd.randint(10, 160)] + some(rnd.randint(0, 5)))
        rows.append((i, "".join(parts)))
    # One passage in different surroundings, loops, borders of the window, repeated ids.
    rows += [(300 + i, some(20) + base[0][:70] + some(20)) for i in range(150)]
    rows += [(600, "a" * 500), (601, "a" * 300), (602, "ab" * 200), (603, "ba" * 100),
             (604, "x De " * 100), (605, "a" * 49), (606, "a" * 50), (5, rows[7][1]),
             (5, rows[5][1]), (607, "x" * 49 + "é"), (608, "x" * 49 + "è")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [2000, 1 << 20])
def test_planted_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(chunks.write_chunks, "__defaults__", (limit,))
    want = check(spark.createDataFrame(repeats(), "doc_id long, text string").repartition(5))
    assert sum(len(r[2]) for r in want) > 100


def test_given_documents(spark, sf_dir):
    assert any(r[2] for r in check(documents(spark, sf_dir)))


def test_edges(spark):
    docs = edge_documents(spark, "chunk", "file", "removed").where("doc_id is null or doc_id <> 8")
    check(docs.union(docs.where("doc_id < 0").selectExpr("12", "text", "lang", "chunk", "file", "removed")))
    assert suffix_dedup.remove_repeats(no_documents(spark)).collect() == []


def test_anchors_depend_on_the_window_alone():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    block = Block.of(texts)
    spans = Spans(block)
    seen = {}
    windows = 0
    for k in range(len(spans)):
        for j in range(spans.first[k], spans.last[k] + 1):
            w = block.data[j : j + LENGTH].tobytes()
            assert seen.setdefault(w, spans.anchor[k] - j) == spans.anchor[k] - j
            assert 0 <= spans.anchor[k] - j <= LENGTH - GRAM
            windows += 1
    assert windows == sum(max(0, len(t) - LENGTH + 1) for t in texts)


def test_sliding_minimum():
    values = np.random.default_rng(1).integers(0, 50, 100)
    for width in (1, 2, 7, 31, 32):
        want = [values[i : i + width].min() for i in range(100 - width + 1)]
        assert sliding_minimum(values, width).tolist() == want


def test_merge_of_front_coded_runs():
    rnd = random.Random(1)
    for _ in range(300):
        runs = []
        for _ in range(rnd.randint(0, 9)):
            strings = sorted(
                bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 6)))
                for _ in range(rnd.randint(0, 12))
            )
            shared, rests = front_code(strings)
            assert front_decode(shared, rests) == strings
            runs.append((strings, shared))
        out = []
        for run, place, known in merge_runs(runs):
            string = runs[run][0][place]
            if out:
                assert known == common_prefix(out[-1], string, 0)
            out.append(string)
        assert out == sorted(s for strings, _ in runs for s in strings)


def test_merge_never_compares_a_known_prefix(monkeypatch):
    """The bytes looked at stay near the bytes that tell strings apart."""
    import newsgauge.llm.merge as merge

    looked = []
    real = merge.common_prefix

    def counting(a, b, known):
        h = real(a, b, known)
        looked.append(h - known + 1)
        return h

    strings = sorted(b"p" * 40 + bytes(c) for c in ([i, j] for i in range(20) for j in range(20)))
    runs = [(strings[k::8], merge.front_code(strings[k::8])[0]) for k in range(8)]
    monkeypatch.setattr(merge, "common_prefix", counting)
    assert len(list(merge.merge_runs(runs))) == 400
    # Only the first tournament sees the common prefix of 40 bytes.
    assert sum(looked) < 8 * 42 + 400 * 3 * 3
