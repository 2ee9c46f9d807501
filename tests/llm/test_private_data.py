"""op3: base spans against regular expressions, the learning against planted labelers."""

import hashlib
import random
import re

import pytest

from newsgauge.llm import private_data as P
from tests.llm.helpers import documents, edge_documents, no_documents


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m)) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def check(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = P.private_spans(docs).collect()
    for r in rows:
        want = brute(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id][:200]
        counts = (r.n_email, r.n_ip, r.n_card, r.n_phone)
        assert counts == tuple(sum(w[1] == k for w in want) for k in range(4))
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(spans)
        order = [(int(s.split(":")[1]), P.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order) and len(spans) == len(set(spans))
    return rows


def test_given_documents(spark, sf_dir):
    rows = check(documents(spark, sf_dir))
    assert len(rows) == documents(spark, sf_dir).count()


def test_odd_texts(spark):
    rnd = random.Random(5)
    parts = list("aZ09.@-+_% ()") + [
        "é", "😀", "\n", "a@b.c", "1.2.3.4", "255", "256", "4111 1111 1111 1111", "..", "@@",
        "4111111111111111", "+1 (415) 555-0123", "call 415-555-0123", "joe (at) x.com", "000",
    ]
    rows = [
        (i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(1500)
    ]
    rows += [(5000, "a@b" + ".c" * 5000), (5001, "12," * 5000), (5002, "a." * 20000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_edges(spark):
    docs = edge_documents(spark, "_text", "_found", "_spans", "spans")
    assert len(check(docs)) == docs.count()
    assert P.private_spans(no_documents(spark)).collect() == []


def test_patterns_are_searched_once(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = P.private_spans(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(P.PATTERNS) + len(P.LOOSE)


def test_mask(spark):
    docs = spark.createDataFrame(
        [
            (1, "mail joe@x.com or +1 (415) 555-0123, 4111 1111 1111 1111.", 99, "k"),
            (2, None, 7, "k"),
            (3, "😀 1.2.3.4", 3, "k"),
            (4, "", 0, "k"),
        ],
        "doc_id long, text string, n_chars long, _spans string",
    )
    rows = {r.doc_id: r for r in P.mask(docs).collect()}
    assert rows[1].text == "mail <EMAIL> or <PHONE>, <CARD>." and rows[1].n_chars == 32
    assert rows[2].text is None and rows[2].n_chars == 7
    assert rows[3].text == "😀 <IP>" and rows[4].text == "" and rows[4]._spans == "k"
    assert P.mask(docs).dtypes == docs.dtypes


def test_reliabilities_of_planted_labelers():
    rnd = random.Random(3)
    right = (0.95, 0.9, 0.7, 0.6)
    counts, truths = {}, {}
    for _ in range(20_000):
        truth = rnd.random() < 0.4
        votes = "".join(str(int(truth == (rnd.random() < p))) for p in right)
        counts["card", votes] = counts.get(("card", votes), 0) + 1
        truths.setdefault(votes, []).append(truth)
    posterior = P.reliabilities(counts)
    for votes, seen in truths.items():
        if len(seen) > 500:
            assert posterior["card", votes] == pytest.approx(sum(seen) / len(seen), abs=0.08)
    weights = P.span_classifier(counts, posterior)["card"]
    assert weights[1] > weights[3] > 0 and weights[2] > weights[4] > 0
    assert P.reliabilities({}) == {} and P.span_classifier({}, {}) == {}
