"""Conversation structure repair: turns aligned with the alternating grammar ``(s?(ua)+)?``.

A turn is blank, a duplicate (role and text seen before in its conversation), truncated (its last
character other than white space is no ``.!?``), or sound; the first of these faults counts. Blank
and duplicate turns have to be deleted. Edits are Keep (0), Rerole to user or assistant (3), Delete
(4) and Insert of an empty user or assistant turn (3); a truncated turn that stays costs 3 more.

Every feasible target, the alternating string of each length with and without a leading system
turn, is aligned with the turns by a Wagner-Fischer table. Targets of one family are the ends of the
longest one, so that one table has a column for each length. It is confined to Ukkonen's band: a cell
is left out if the inserts or deletes that lead from its diagonal to the corners cost more than the
incumbent, a repair found in one pass. Optimal targets are traced, and of their audits (initials of
the edits in order) the least in ASCII order counts. Equal patterns of turns are aligned once per
worker. Tables above ``CELLS`` cells (conversations of thousands of faulty turns) are folded instead:
columns of one parity share a cell, which gives the same cost and audit in time linear in the turns.

Turns are ordered by turn (nulls first); ties go by role, then by a hash of the text, 128 bits of which
stand for it in comparisons. Sorts may spill, and a task holds a byte or two per turn of a conversation,
never its texts: they stream by, behind the audit of their conversation, and are shuffled once.

Defined results: a null role or text is a space, as is a null part of the damage key; rows of a null
conv_id are one conversation; repeated rows are duplicates; an empty role has no initial and cannot
be kept; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newsgauge.llm.blocks import kept

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
CELLS = 1 << 22
CACHE_PATTERNS = 100_000
LONGEST_CACHED = 64
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"
PART = 1 << 20  # edits in a row on their way to the texts

# A turn is one byte: the place of its initial in "uas?", and its first fault.
_INITIALS = "uas?"
_CUT, _BLANK, _REPEATED = 4, 8, 16
_GONE = _BLANK | _REPEATED
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_FAR = 1 << 30


# --- alignment -----------------------------------------------------------------------------


def _stay(code: int, letter: str) -> int:
    """Cost of a turn that becomes ``letter`` by Keep or Rerole."""
    if code & _GONE:
        return _FAR
    change = 0 if _INITIALS[code & 3] == letter else REROLE if letter in ROLES else _FAR
    return change + (TRUNCATED if code & _CUT else 0)


def _letter(left: int) -> str:
    """The first of the last ``left`` letters of the alternating string."""
    return "ua"[left % 2]


def _edit(code: int, letter: str) -> str:
    return "K" if _INITIALS[code & 3] == letter else "R"


def _skew(more: int) -> int:
    """The least cost of ``more`` target letters than turns (negative: fewer)."""
    return INSERT * more if more > 0 else -DELETE * more


class Folded:
    """Least costs with columns of one parity folded: of turns from ``i`` to an even or odd rest."""

    def __init__(self, codes: bytes):
        n = len(codes)
        even, odd, after = [0] * (n + 1), [INSERT] * (n + 1), [2 * INSERT] * (n + 1)
        for i in range(n - 1, -1, -1):
            u, a = _stay(codes[i], "u"), _stay(codes[i], "a")
            e = min(DELETE + even[i + 1], u + odd[i + 1])
            o = min(DELETE + odd[i + 1], a + even[i + 1])
            even[i], odd[i] = min(e, INSERT + o), min(o, INSERT + e)
            # After the system turn at least one pair has to follow.
            after[i] = min(DELETE + after[i + 1], u + odd[i + 1], INSERT + odd[i])
        self.codes, self.even, self.odd, self.after = codes, even, odd, after
        start = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            start[i] = min(even[i], DELETE + start[i + 1], _stay(codes[i], "s") + after[i + 1])
        self.start = start

    def audit(self) -> str:
        """The least audit of least cost: an audit fixes the path, so each step takes the least."""
        tables = {"start": self.start, "even": self.even, "odd": self.odd, "after": self.after}
        following = {"start": "odd", "even": "odd", "odd": "even", "after": "odd"}
        i, state, edits = 0, "start", []
        n = len(self.codes)
        while i < n or tables[state][i]:
            left = tables[state][i]
            letter = "a" if state == "odd" else "u"
            after = tables[following[state]]
            if i < n and DELETE + tables[state][i + 1] == left:
                edits.append("D")
                i += 1
            elif INSERT + after[i] == left:
                edits.append("I")
                state = following[state]
            elif state == "start" and _stay(self.codes[i], "s") + self.after[i + 1] == left:
                edits.append("K")
                state, i = "after", i + 1
            else:
                edits.append(_edit(self.codes[i], letter))
                state, i = following[state], i + 1
        return "".join(edits)


class Band:
    """The table of least costs of turns ``i:`` against the last ``r`` letters of a target."""

    def __init__(self, codes: bytes, incumbent: int):
        n = len(codes)
        self.codes = codes
        # Columns a row keeps: rests r whose difference to the turns left is affordable.
        self.more, self.fewer = incumbent // INSERT, incumbent // DELETE
        self.width = self.more + self.fewer + 1
        self.rows = np.full((n + 1, self.width), _FAR, dtype=np.int64)
        drift = INSERT * np.arange(self.width)
        for i in range(n, -1, -1):
            row = np.full(self.width, _FAR, dtype=np.int64)
            first = self._first(i)
            if i == n:
                if first <= 0:
                    row[-first] = 0
            else:
                # The same rest lies one column further right in the row below.
                below = self.rows[i + 1]
                row[:-1] = below[1:] + DELETE
                even = first % 2
                for parity, letter in ((0, "u"), (1, "a")):
                    mine = slice((even + parity) % 2, None, 2)
                    row[mine] = np.minimum(row[mine], below[mine] + _stay(codes[i], letter))
                if first < 0:
                    row[:-first] = _FAR
            row = np.minimum.accumulate(row - drift) + drift
            self.rows[i] = np.minimum(row, _FAR)

    def _first(self, i: int) -> int:
        """The rest in the first column of row i."""
        return len(self.codes) - i - self.fewer

    def cost(self, i: int, r: int) -> int:
        at = r - self._first(i)
        return int(self.rows[i, at]) if 0 <= at < self.width else _FAR

    def trace(self, i: int, r: int) -> str:
        """The least audit among the cheapest edits."""
        edits = []
        n = len(self.codes)
        while i < n or r:
            left = self.cost(i, r)
            letter = _letter(r)
            if i < n and DELETE + self.cost(i + 1, r) == left:
                edits.append("D")
                i += 1
            elif r and INSERT + self.cost(i, r - 1) == left:
                edits.append("I")
                r -= 1
            else:
                edits.append(_edit(self.codes[i], letter))
                i, r = i + 1, r - 1
        return "".join(edits)


def aligned(codes: bytes, cells: int = CELLS) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation; of equals the least audit."""
    folded = Folded(codes)
    incumbent, n = folded.start[0], len(codes)
    if (n + 1) * (incumbent // INSERT + incumbent // DELETE + 1) > cells:
        return incumbent, folded.audit()
    table = Band(codes, incumbent)
    best, targets = _FAR, []
    longest = n + incumbent // INSERT
    # A target is a rest of even length, after turns the last of which is kept as system.
    for r in range(0, longest + 1, 2):
        if _skew(r - n) <= incumbent:
            targets.append((table.cost(0, r), "", 0, r))
    for i, code in enumerate(codes):
        lead = DELETE * i + _stay(code, "s")
        if lead <= incumbent:
            for r in range(2, longest + 1, 2):
                targets.append((lead + table.cost(i + 1, r), "D" * i + "K", i + 1, r))
    best = min(cost for cost, *_ in targets)
    return best, min(lead + table.trace(i, r) for cost, lead, i, r in targets if cost == best)


def _cached(codes: bytes) -> tuple[int, str]:
    if len(codes) > LONGEST_CACHED:
        return aligned(codes)
    cache = kept("turn patterns", dict)
    if codes not in cache:
        if len(cache) >= CACHE_PATTERNS:
            cache.clear()
        cache[codes] = aligned(codes)
    return cache[codes]


# --- turns ---------------------------------------------------------------------------------


def _plain(turns: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("second"), text).alias("h2"),
    )


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.col("role"), F.col("h1"), F.col("h2")]


def _codes(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, code`` in the order of the turns; only hashes of the texts are shuffled."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = turns.select(
        "conv_id", "turn", "role", "h1", "h2",
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).repartition("conv_id")
    copies = Window.partitionBy("conv_id", "role", "h1", "h2").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(F.col("blank"), _BLANK)
        .when(F.row_number().over(copies) > 1, _REPEATED)
        .when(F.col("cut"), _CUT)
        .otherwise(0)
    )
    place = F.instr(F.lit(_INITIALS[:3]), F.substring("role", 1, 1))
    # An empty initial is found at the start of any string.
    initial = F.when((F.col("role") != "") & (place > 0), place - 1).otherwise(3)
    return (
        narrow.withColumn("code", (initial + fault).cast("int"))
        .sortWithinPartitions("conv_id", *_order())
        .select("conv_id", "turn", "code")
    )


NOTES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Conversation:
    """What is known of one conversation while its turns stream by."""

    def __init__(self):
        self.codes = bytearray()
        self.first = self.last = None
        self.distinct = 0

    def add(self, turn: int | None, code: int) -> None:
        self.codes.append(code)
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1

    def notes(self, cost: int) -> tuple[int, ...]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        faults = [sum(1 for c in self.codes if c & f) for f in (_BLANK, _REPEATED, _CUT)]
        roles = [_INITIALS[c & 3] for c in self.codes]
        illegal = sum(pair not in _LEGAL for pair in zip(roles, roles[1:]))
        return gaps, *faults, illegal, cost


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number of characters."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held), schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= PART:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _audit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Audits, cut into parts of a bounded length, from rows of ``conv_id, turn, code`` in order."""
    for conv_id, turns in groupby(_rows(batches), key=lambda row: row[0]):
        known = _Conversation()
        for _, turn, code in turns:
            known.add(turn, code)
        cost, audit = _cached(bytes(known.codes))
        notes = known.notes(cost)
        for part in range(0, len(audit), PART):
            yield (conv_id, part, audit[part : part + PART], *notes)


class _Lines:
    """The repaired turns of one conversation, from its audit and the turns in order."""

    def __init__(self, audit: str):
        self.edits = iter(audit)
        self.next = "u"

    def _made(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        if edit != "K":
            role = ROLES[self.next]
        self.next = "a" if role[:1] == "u" else "u"
        return edit, role, text

    def upto(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of what is inserted before a turn, and of the turn if it stays."""
        for edit in self.edits:
            if edit == "I":
                yield self._made("I", "", "")
                continue
            if edit != "D":
                yield self._made(edit, role, text)
            return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for _ in self.edits:
            yield self._made("I", "", "")


def _repaired_lines(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``conv_id, audit, notes, lines`` from audit parts and then turns of each conversation.

    The lines have to be used up before the next conversation.
    """
    for conv_id, members in groupby(rows, key=lambda row: row[0]):
        parts = []
        first = next(members)
        notes = first[5:]
        row = first
        while row is not None and row[1] is not None:
            parts.append(row[2])
            row = next(members, None)
        audit = "".join(parts)
        repaired = _Lines(audit)

        def lines(row=row, members=members, repaired=repaired):
            while row is not None:
                yield from repaired.upto(row[3], row[4])
                row = next(members, None)
            yield from repaired.rest()

        yield conv_id, audit, notes, lines()


def _summaries(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv_id, audit, notes, lines in _repaired_lines(rows):
        digest = hashlib.sha256()
        for number, (_, role, text) in enumerate(lines):
            digest.update(("\n" if number else "").encode())
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield (conv_id, *notes, audit, digest.hexdigest())


def _turn_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv_id, _, _, lines in _repaired_lines(rows):
        for number, (edit, role, text) in enumerate(lines):
            yield conv_id, number, edit, role, text


def _stream(turns: DataFrame, make, columns: str) -> DataFrame:
    """Run ``make`` over the audit and then the turns of each conversation, in order."""
    key = turns.schema["conv_id"].dataType
    plain = _plain(turns)

    def mapped(table: DataFrame, function, names: str) -> DataFrame:
        fields = f"conv_id {key.simpleString()}, {names}"
        schema = to_arrow_schema(StructType.fromDDL(fields))
        return table.mapInArrow(lambda batches: _batches(function(batches), schema), fields)

    notes = ", ".join(f"{n} long" for n in NOTES)
    audits = mapped(_codes(plain), _audit_rows, f"part long, audit string, {notes}")
    both = audits.unionByName(plain, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_last("part"), *_order()
    )
    ready = ordered.select("conv_id", "part", "audit", "role", "text", *NOTES)
    return mapped(ready, lambda batches: make(_rows(batches)), columns)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text`` of the turns of every repaired conversation."""
    return _stream(turns, _turn_rows, "place long, edit string, role string, text string")


def repairs(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, and the cost, audit and hash of its repair.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``; gaps are
    the turn numbers missing between the least and the greatest.
    """
    notes = ", ".join(f"{n} long" for n in NOTES)
    return _stream(turns, _summaries, f"{notes}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by a checksum of conversation and turn: a test bed for repairs."""
    space = F.lit(" ")
    plain = turns.select(
        "conv_id", "turn",
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    parts = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(parts[0], F.lit(":"), parts[1])) % 20
    once, twice = F.array(F.lit(0)), F.array(F.lit(0), F.lit(1))
    copies = F.when(kind == 3, twice).when(kind != 0, once)
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return plain.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """``repairs`` of damaged conversations, for every conversation there was before."""
    found = repairs(damaged(conversations)).withColumnRenamed("conv_id", "found_id")
    nothing = hashlib.sha256().hexdigest()
    every = conversations.select("conv_id").distinct()
    return every.join(found, every["conv_id"].eqNullSafe(found["found_id"]), "left").select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in NOTES],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
