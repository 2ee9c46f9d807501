"""op5, op7 and op8: ids and counts against the tokenizers library, packing and files against loops."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from newsgauge.llm import packing, token_counts, token_files, tokens
from tests.llm.helpers import documents, edge_documents, no_documents

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n=3000):
    rnd = random.Random(3)
    parts = ["'", "'s", "'re", "'ll", "'x", " ", "  ", "\n", "\t", "a", "B", "é", "É", "ß", "Σ",
             "1", "2½", "!", "!!", "<|endoftext|>", "<|startoftext|>", "中文", " ", "\u0085",
             "İ", "é", "😀", "‍", "ⅷ", "s", "t", "re", "don't", "can't've", "\x1c",
             "\x00", "_", "٣", "हिन्दी", "͸", "▁", "<0x0A>", "<s>", "the", "ing"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def reference(path, texts):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_equal_the_library(spark, sf_dir, path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5000)
    texts = odd_texts() + [r.text for r in documents(spark, sf_dir).collect()]
    encoder = tokens.Encoder(path)
    got = [i.tolist() for at in range(0, len(texts), 100) for i in encoder.encode(texts[at : at + 100])]
    assert got == reference(path, texts)


def unigram():
    pieces = token_counts.vocabulary(PIECES)
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(
        replacement="▁", prepend_scheme="always", split=False
    )
    return pieces, tokenizer


def test_counts_equal_the_library(spark, sf_dir):
    pieces, tokenizer = unigram()
    counter = token_counts.Counter(pieces)
    texts = odd_texts() + [r.text for r in documents(spark, sf_dir).collect()]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t)[1] for t in texts] == want


def test_runs_of_spaces_take_their_pieces():
    pieces, tokenizer = unigram()
    counter = token_counts.Counter(pieces)
    texts = ["a" + " " * 10 + "b", "x = 1\n        return  y", " " * 40, "  a", "a  ", "▁▁ ▁", " " * 5000 + "end"]
    for text in texts:
        assert counter.count(text)[1] == len(tokenizer.encode(text, add_special_tokens=False).ids), text
    assert counter.count("a" + " " * 10 + "b") == (2, 3)


@pytest.mark.parametrize("crossing", [False, True])
def test_fractional_scores(crossing):
    """Scores whose sums round, over a small alphabet; with and without pieces across words."""
    rnd = random.Random(crossing)
    alphabet = ["a", "b", "c", "é", "▁"]
    found = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 5))) for _ in range(300)} | set(alphabet)
    if not crossing:
        found = {p for p in found if "▁" not in p.lstrip("▁")}
    pieces = [("<unk>", -9.5)] + [(p, -round(rnd.uniform(0.1, 3), 2)) for p in sorted(found)]
    counter = token_counts.Counter(pieces)
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    for _ in range(400):
        text = "".join(rnd.choice("abcé   ") for _ in range(rnd.randint(1, 60)))
        assert counter.count(text)[1] == len(library.encode(text).ids), text


def test_ties_go_to_the_piece_that_starts_first():
    pieces = [("<unk>", -9.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)]
    counter = token_counts.Counter(pieces)
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    for word in ("▁ab", "▁aab", "▁b", "▁abab", "▁c"):
        want = library.encode(word).tokens
        assert counter.best(word)[1] == len(want), (word, want)


def test_count_query(spark):
    docs = edge_documents(spark, "n_tokens", "n_words")
    _, tokenizer = unigram()
    rows = token_counts.token_counts(docs, PIECES).collect()
    want = sorted(len(tokenizer.encode(r.text or "").ids) for r in docs.collect())
    assert sorted(r.n_tokens for r in rows) == want
    assert token_counts.token_counts(no_documents(spark), PIECES).collect() == []


def expected_pieces(rows, size=1024, end=2):
    for (doc_id, _), ids in zip(rows, reference(BYTES, [t or "" for _, t in rows])):
        ids = [*ids, end]
        first = (len(ids) - 1) % size + 1
        for k, (lo, hi) in enumerate([(0, first)] + [(a, a + size) for a in range(first, len(ids), size)]):
            data = np.array(ids[lo:hi], "<u4").tobytes()
            yield doc_id, k, lo, hi - lo, zlib.crc32(data)


def check_packing(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.packed_documents(docs, BYTES).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    plain = [tuple(None if v != v else v for v in r) for r in got[columns].itertuples(index=False)]
    assert sorted(plain, key=str) == sorted(expected_pieces(rows), key=str)
    ordered = got.sort_values(["sequence_id", "offset"])
    ends = ordered.offset + ordered.length
    before = ends.groupby(ordered.sequence_id).shift().fillna(0)
    assert (before == ordered.offset).all() and (ends <= 1024).all()
    return ordered.sequence_id.nunique(), -(-int(got.length.sum()) // 1024)


def test_packing(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    used, bound = check_packing(documents(spark, sf_dir))
    assert used <= 1.05 * bound
    check_packing(edge_documents(spark, "length", "salt", "piece"))
    assert packing.packed_documents(no_documents(spark), BYTES).collect() == []


def test_plan_places_every_piece():
    rnd = random.Random(1)
    for size in (8, 64, 1024):
        lengths = [rnd.randint(1, size) for _ in range(500)]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        taken = packing.plan(dict(histogram), size)
        placed = {}
        for members, n in taken:
            assert sum(members) <= size and n > 0
            for m in members:
                placed[m] = placed.get(m, 0) + n
        assert placed == histogram
        assert sum(n for _, n in taken) <= 1.05 * sum(lengths) / size + 2
    assert packing.plan({512: 3}, 1024) == [((512, 512), 1), ((512,), 1)]
    # An exact triple where best fit would take 13 first: 1000 + (12 + 6 + 6).
    assert ((1000, 12, 6, 6), 1) in packing.plan({1000: 1, 13: 1, 12: 1, 6: 2, 1011: 1}, 1024)
    assert packing.plan({}) == []


def test_packed_ids(spark, sf_dir):
    docs = documents(spark, sf_dir).where("doc_id < 20")
    cut = packing.pieces(docs, BYTES)
    rows = packing.sequences(packing.pack(cut)).collect()
    held = sorted(i for r in rows for i in r.ids)
    texts = [r.text or "" for r in docs.collect()]
    assert held == sorted(i for ids in reference(BYTES, texts) for i in [*ids, 2])


def test_token_files(spark, sf_dir):
    for docs in (documents(spark, sf_dir), edge_documents(spark, "first", "part")):
        key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
        rows = sorted(docs.collect(), key=key)
        manifest = token_files.write_token_files(docs, WORDS)
        got = sorted(map(tuple, token_files.read_documents(spark, manifest).collect()), key=lambda r: r[1])
        at, want = 0, []
        ids = [[*i, 1] for i in reference(WORDS, [r.text or "" for r in rows])]
        for r, i in zip(rows, ids):
            want.append((r.doc_id, at, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
            at += len(i)
        assert got == want
        stream = [x for i in ids for x in i]
        for entry in manifest.collect():
            file = token_files.TokenFile(entry.file)
            for row in {0, (entry.tokens - 1) // token_files.LENGTH}:
                values, mask = file.sequence(row)
                size = min(token_files.LENGTH, entry.tokens - row * token_files.LENGTH)
                lo = entry.base + row * token_files.LENGTH
                assert values[:size].tolist() == stream[lo : lo + size]
                assert sum(mask.to_pylist()) == size and len(values) == token_files.LENGTH
    empty = token_files.write_token_files(no_documents(spark), WORDS)
    assert empty.collect() == [] and token_files.read_documents(spark, empty).collect() == []


def test_a_block_is_looked_up_by_its_distinct_pieces(monkeypatch):
    import numpy as np
    import public_tokenizers

    from newsgauge.llm import tokens

    asked = []
    find = tokens.Encoder._find
    monkeypatch.setattr(tokens.Encoder, "_find", lambda self, h: asked.append(len(h)) or find(self, h))
    coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one two three " * 500, "", " ", "two zebra99 " * 200]
    found = coder.encode(texts)
    assert max(asked) <= 10
    for text, ids in zip(texts, found):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    # Also when the cache is emptied in between, and for blocks without any piece.
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    for a, b in zip(found, coder.encode(texts)):
        assert np.array_equal(a, b)
    assert [len(i) for i in coder.encode([" ", ""])] == [0, 0]
