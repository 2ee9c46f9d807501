"""op12: alignments against all edit sequences, whole conversations against a plain version."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
import xxhash

from newsgauge.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_alignment(turns):
    """Least (cost, audit) of (initial, must go, truncated) against every target string."""
    n = len(turns)
    found = []
    for target in ["", *(lead + "ua" * k for k in range(1, 2 * n + 2) for lead in ("", "s"))]:

        @lru_cache(None)
        def best(i, j, target=target):
            if i == n and j == len(target):
                return 0, ""
            options = []
            if i < n:
                cost, audit = best(i + 1, j)
                options.append((cost + 4, "D" + audit))
            if j < len(target) and target[j] != "s":
                cost, audit = best(i, j + 1)
                options.append((cost + 3, "I" + audit))
            if i < n and j < len(target) and not turns[i][1]:
                cost, audit = best(i + 1, j + 1)
                cost += 3 * turns[i][2]
                if turns[i][0] == target[j]:
                    options.append((cost, "K" + audit))
                if target[j] != "s":
                    options.append((cost + 3, "R" + audit))
            return min(options, default=(10**9, ""))

        found.append(best(0, 0))
    return min(found)


def coded(turns):
    return bytes(
        ("uas".find(r) if r and r in "uas" else 3) | (T._BLANK if gone else T._CUT if cut else 0)
        for r, gone, cut in turns
    )


def test_alignment_is_the_least_of_all():
    rnd = random.Random(5)
    for _ in range(3000):
        n = rnd.randint(0, 7)
        turns = tuple((rnd.choice("uasx"), rnd.random() < 0.15, rnd.random() < 0.2) for _ in range(n))
        want = plain_alignment(turns)
        assert T.aligned(coded(turns)) == want, turns
        assert T.aligned(coded(turns), cells=0) == want, turns


def test_folded_table_equals_the_banded_one():
    rnd = random.Random(6)
    for n in (40, 300, 900):
        codes = bytes((i % 2) ^ (rnd.random() < 0.1) | rnd.choice([0] * 9 + [4, 8]) for i in range(n))
        assert T.aligned(codes, cells=1 << 40) == T.aligned(codes, cells=0)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def spark_hashes(text):
    """xxhash64 of Spark: seed 42; further columns take the hash before them as their seed."""
    data = text.encode()
    second = xxhash.xxh64_intdigest(b"second", 42)
    return signed(xxhash.xxh64_intdigest(data, 42)), signed(xxhash.xxh64_intdigest(data, second))


def plain_repairs(rows):
    """conv_id: (gaps, ..., repaired_sha256), by loops over damaged rows."""
    result = {}
    damaged = {}
    for conv_id, turn, role, text in rows:
        damaged.setdefault(conv_id, [])
        shown = [" " if v is None else str(v) for v in (conv_id, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        damaged[conv_id] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv_id, turns in damaged.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), spark_hashes(t[2])))
        faults, seen = [], set()
        for _, role, text in turns:
            ends = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            if not ends:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("" if ends[-1] in ".!?" else "truncated")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        pattern = tuple(
            (r or "?", f in ("blank", "duplicate"), f == "truncated") for r, f in zip(initials, faults)
        )
        cost, audit = plain_alignment(pattern)
        lines, left = [], list(turns)
        for edit in audit:
            role, text = ("", "") if edit == "I" else left.pop(0)[1:]
            if edit in "IR":
                role = "assistant" if lines and lines[-1].startswith("u") else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result[conv_id] = (gaps, *counts, illegal, cost, audit, digest)
    return result


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(conversations):
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in T.repaired_conversations(conversations).collect()}
    assert got == plain_repairs(rows)
    return got


def test_query_over_the_table(spark, sf_dir):
    got = check(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    assert len({audit for *_, audit, _ in got.values()}) > 3


def test_odd_conversations(spark):
    rnd = random.Random(8)
    texts = ["Yes.", "No", "", " \t", None, "Why?\n", "é!", "Yes. "]
    roles = ["user", "assistant", "system", "tool", "", None, "umpire"]
    rows = [
        (rnd.choice([None, 1, 2, 3, -4, 5]), rnd.choice([None, 0, 1, 2, 3, 4, 9, 10**12]),
         rnd.choice(roles), rnd.choice(texts))
        for _ in range(30)
    ]
    # Conversations of which nothing is left: the damage drops these keys.
    dropped = [c for c in range(100, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    rows += [(c, 0, "user", "Gone.") for c in dropped]
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", "x" * 200_000 + ".") for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as code", "'x' as part", "2 as h1")
    got = check(df)
    assert got[dropped[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    empty = spark.createDataFrame([], SCHEMA)
    assert T.repaired_conversations(empty).collect() == []


@pytest.mark.parametrize("cells", [0, T.CELLS])
def test_a_long_conversation(spark, monkeypatch, cells):
    monkeypatch.setattr(T, "PART", 50)
    rows = [(1, t, "user" if t % 3 else "assistant", f"{t}.") for t in range(400)]
    turns = spark.createDataFrame(rows, SCHEMA)
    found = T.repairs(turns).collect()[0]
    codes = bytes("ua".find(r[2][0]) for r in rows)
    assert (found.cost, found.audit) == T.aligned(codes, cells)
    lines = T.repaired_turns(turns).orderBy("place").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in lines)
    assert hashlib.sha256(text.encode()).hexdigest() == found.repaired_sha256
    assert re.fullmatch("(ua)+", "".join(r.role[0] for r in lines))
    assert [r.place for r in lines] == list(range(len(lines)))
