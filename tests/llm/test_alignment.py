"""op11: merge paths against loops over tokens, whole results against a plain version."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newsgauge.llm import alignment
from tests.llm.helpers import documents, edge_documents, no_documents

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_path(a, b):
    """Links and groups from the byte ranges of every token."""
    ranges = [list(zip([0, *ends[:-1]], ends)) for ends in (a, b)]
    links = [
        (i, j) for i, (s, e) in enumerate(ranges[0]) for j, (t, f) in enumerate(ranges[1])
        if s < f and t < e
    ]
    both = sorted(set(a) & set(b))
    groups = [[sum(x < e for x in both) for e in ends] for ends in (a, b)]
    return links, *groups


def ends_of(rnd, total, share):
    return sorted({*(x for x in range(1, total) if rnd.random() < share), total}) if total else []


@pytest.mark.parametrize("work", [1, 2, 7, 64])
def test_merge_path(work):
    rnd = random.Random(work)
    for total in [0, 1, 2, 3, 60, 60, 200, 200]:
        a, b = ends_of(rnd, total, rnd.random()), ends_of(rnd, total, rnd.random())
        path = alignment.MergePath(np.array(a, np.int64), np.array(b, np.int64), work)
        links, group_a, group_b = plain_path(a, b)
        assert list(zip(path.link_a.tolist(), path.link_b.tolist())) == links
        assert path.group_a.tolist() == group_a and path.group_b.tolist() == group_b


def test_diagonal_cuts():
    a, b = np.array([2, 4, 4, 9]), np.array([1, 4, 5, 9, 10])
    order = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    taken = [sum(side == 0 for _, side in order[:d]) for d in range(10)]
    assert alignment.diagonal_cuts(a, b, np.arange(10)).tolist() == taken


def plain_alignment(rows):
    """Per document its tokens' bytes by the libraries, groups and links by loops."""
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = alignment._byte_characters()

    def piece(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()

    found, corpus = [], collections.Counter()
    for doc_id, text in rows:
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False) if text else None
        a = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(a.ids, a.tokens)] if a else []
        b = [(i, piece(i)) for i in model.encode(text or "")]
        whole = f" {text}".encode() if text else b""
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            a, b = [], []
        ends = [np.cumsum([len(t) for _, t in x]).tolist() for x in (a, b)]
        links, parts, x, y = [], [], 0, 0
        for i, (end_a, (id_a, t)) in enumerate(zip(ends[0], a)):
            while y < len(b) and ends[1][y] <= end_a - len(t):
                y += 1
            k = y
            while k < len(b) and ends[1][k] - len(b[k][1]) < end_a:
                links.append((id_a, b[k][0]))
                k += 1
        both = sorted(set(ends[0]) & set(ends[1]))
        lo = 0
        for hi in both:
            sides = [[str(i) for end, (i, _) in zip(e, x) if lo < end <= hi] for e, x in zip(ends, (a, b))]
            parts.append("|".join(",".join(s) for s in sides))
            lo = hi
        corpus.update(links)
        found.append((doc_id, len(a), len(b), len(both), links, ";".join(parts)))
    best = collections.Counter()
    for (_, b), n in corpus.items():
        best[b] = max(best[b], n)
    for doc_id, n_a, n_b, n_groups, links, groups in found:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        yield (
            doc_id, n_a, n_b, n_groups, len(links), sum(corpus[p] == best[p[1]] for p in links),
            sum(corpus[p] for p in links), digest,
        )


def check(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    aligned = alignment.Alignment(docs, BYTES, PIECES, **options)
    got = aligned.documents().collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(plain_alignment(rows), key=str)
    return aligned, got


def test_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).where("n_chars < 4000")
    aligned, got = check(docs, chunk_bytes=40_000, with_groups=True)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got)
    pairs = aligned.pairs().collect()
    assert sum(r.total for r in pairs) == sum(r.n_links for r in got)
    assert len({(r.a_id, r.b_id) for r in pairs}) == len(pairs)


def test_edges(spark):
    check(edge_documents(spark, "chunk", "pair", "links").where("doc_id is null or doc_id <> 8"))
    odd = ["  two  spaces ", "▁mark", "<s> </s> <unk>", "<|endoftext|>", "<0x0A>\n\x00", "é ﬁ ́", "中文😀", "\t"]
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate(odd)], "doc_id long, text string")
    _, got = check(docs)
    assert sum(r.n_a == 0 for r in got) == 1  # the text that holds the mark itself
    assert alignment.Alignment(no_documents(spark), BYTES, PIECES).documents().collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    _, got = check(nothing)
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_a_chunk_takes_little_memory():
    """What a chunk of the default size needs beside its texts, in a process of two per 3 GB executor."""
    import random
    import tracemalloc

    import public_tokenizers

    from newsgauge.llm import alignment

    rng = random.Random(1)
    words = ["river", "stone", "window", "quiet", "the", "of", "morning", "letter42", "zebra"]
    texts = [" ".join(rng.choices(words, k=800)) for _ in range(alignment.CHUNK_BYTES // 4000)]
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    chunk = alignment.Chunk(*paths)
    chunk.add(list(range(len(texts))), texts)
    tracemalloc.start()
    rows = list(chunk.rows(0, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows[0].num_rows == len(texts)
    assert peak < 100 << 20
