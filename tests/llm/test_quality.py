"""op9: counts against regular expressions, distances against a plain formula, held-out labels."""

import re
from collections import Counter

import numpy as np

from newsgauge.llm import quality
from newsgauge.llm.blocks import Block
from tests.llm.helpers import documents, edge_documents, no_documents


def brute(text):
    text = text or ""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    words = [text[a:b] for a, b in spans]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)
    )


def check(docs):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    rows = quality.judge(docs).collect()
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (r.kept and failed)
    return rows


def test_counts(spark, sf_dir):
    rows = check(documents(spark, sf_dir))
    assert any(r.n_dup_lines for r in rows) and any(r.n_repeat_words for r in rows)


def test_edges(spark):
    docs = edge_documents(spark, "kept", "n_words")
    assert len(check(docs)) == docs.count()
    assert quality.judge(no_documents(spark)).collect() == []
    kept = quality.keep(docs.drop("kept", "n_words"))
    assert kept.schema == docs.drop("kept", "n_words").schema and kept.count() == 0


def test_distance():
    p, q = np.array([[3, 1, 0]]), np.array([[1, 1, 2]])
    a, b = p[0] / 4, q[0] / 4
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v)
    assert np.isclose(quality.js_distance(p, q)[0], np.sqrt((kl(a) + kl(b)) / 2))
    assert quality.js_distance(p, p)[0] < 1e-6
    assert quality.js_distance(np.zeros((1, 3)), q)[0] == 0


def test_rejects_low_and_keeps_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in quality.judge(documents(spark, sf_dir)).collect() if not r.base_failed]
    share = lambda q: np.mean(
        [r.kept for r in rows if r.doc_id in labels and labels[r.doc_id].quality == q]
    )
    assert share(1) > 0.99 and share(0) < 0.2


def test_common_words_are_recognised():
    counts = quality.measure(Block.of(["the The of zebra", ""]))
    assert counts["words"].sum() == 4 and counts["words"][0][-1] == 1
