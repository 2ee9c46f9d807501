"""op13: the tree against a plain first fit, sequences without padding, ids against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from newsgauge.llm import packing, tree_packing
from tests.llm.helpers import documents, edge_documents, no_documents

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain_first_fit(lengths, size):
    bins, room = [], []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((k for k, r in enumerate(room) if r >= lengths[item]), len(bins))
        if at == len(bins):
            bins.append([])
            room.append(size)
        bins[at].append(item)
        room[at] -= lengths[item]
    return bins


def test_tree_finds_the_first_bin_with_room():
    rnd = random.Random(1)
    for size, n in ((8, 0), (8, 1), (16, 37), (2048, 400)):
        lengths = [rnd.randint(1, size) for _ in range(n)]
        assert tree_packing.first_fit_decreasing(lengths, size) == plain_first_fit(lengths, size)
    assert tree_packing.first_fit_decreasing([3, 3, 3], 9) == [[0, 1, 2]]


def test_groups_are_packed_without_padding():
    rnd = random.Random(2)
    for size, n in ((8, 1), (64, 50), (2048, 300)):
        tokens = [rnd.randint(1, 3 * size) for _ in range(n)]
        sequences = tree_packing.pack_group(tokens, size)
        held = [sum(length for _, _, length in s) for s in sequences]
        assert sum(h < size for h in held) < size.bit_length()
        assert all(h == size or h & (h - 1) == 0 for h in held)
        covered = sorted((i, at) for s in sequences for i, start, m in s for at in range(start, start + m))
        assert covered == [(i, at) for i, n in enumerate(tokens) for at in range(n)]
        # A gap is closed by one cut at most.
        assert sum(len(s) for s in sequences) <= sum(-(-n // size) for n in tokens) + 2 * len(held)


def check(docs, **options):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    got = tree_packing.packed_pieces(docs, BYTES, **options).toPandas()
    want = []
    for (doc_id, _), e in zip(rows, tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False)):
        want.append((str(doc_id), np.array([*e.ids, 1], "<u4").tobytes()))
    assert (got.ids.map(zlib.crc32) == got.ids_crc32).all()
    assert (got.ids.map(len) == 4 * got.length).all()
    # Documents of one id and text are told apart by nothing, so whole documents are counted.
    found = {}
    for r in got.sort_values("start").itertuples():
        key = "None" if r.doc_id != r.doc_id else str(int(r.doc_id))
        found.setdefault((key, r.doc_tokens), []).append((r.start, r.ids))
    for (doc_id, tokens), parts in found.items():
        mine = [data for i, data in want if i == doc_id and len(data) == 4 * tokens]
        assert sum(len(d) for _, d in parts) == sum(map(len, mine))
        for start, data in parts:
            assert any(w[4 * start : 4 * start + len(data)] == data for w in mine)
    assert len({(i, len(d)) for i, d in want}) == len(found)
    ordered = got.sort_values(["sequence_id", "offset"])
    ends = ordered.offset + ordered.length
    assert (ends.groupby(ordered.sequence_id).shift().fillna(0) == ordered.offset).all()
    held = ordered.groupby("sequence_id").length.sum()
    assert ((held == 2048) | ((held < 2048) & (held & (held - 1) == 0))).all()
    return got


def test_packed_pieces(spark, sf_dir):
    got = check(documents(spark, sf_dir), group_bytes=100_000)
    assert (got.sequence_id // tree_packing.SEQUENCES_PER_GROUP).nunique() > 3
    check(edge_documents(spark, "start", "group", "ids"))
    assert tree_packing.packed_pieces(no_documents(spark), BYTES).collect() == []


def test_null_text_is_the_end_id_alone(spark):
    docs = spark.createDataFrame([(7, None)], "doc_id long, text string")
    row = tree_packing.packed_pieces(docs, BYTES, with_ids=False).collect()[0]
    crc = zlib.crc32(np.array([1], "<u4").tobytes())
    assert tuple(row)[:5] == (7, 0, 1, crc, 1) and row.offset == 0


def test_sequences(spark, sf_dir):
    docs = documents(spark, sf_dir).where("doc_id < 20")
    packed = tree_packing.packed_pieces(docs, BYTES)
    sizes = [len(r.ids) for r in packing.sequences(packed).collect()]
    assert sum(sizes) == packed.agg({"length": "sum"}).first()[0] and max(sizes) == 2048
