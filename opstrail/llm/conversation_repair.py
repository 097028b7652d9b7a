"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation in order has role initials ``(s?(ua)+)?``. Node (i, state) of the lattice
says that the first i rows are dealt with and what the repaired rows end in. Edges are
edits: Keep (0), Rerole to user or assistant (2), Delete (3; the only edit of blank and
duplicate rows), Insert an empty user or assistant turn (2); a truncated row that stays
costs 1 more. One heap grows from the start, one from the end. They go on until no open
pair of nodes can be as cheap as the best crossing, so that all crossings of that cost
are known, and the least audit (the edits' initials) over all of them is taken. The
grammar is deterministic, so an audit fixes the repaired roles, and no audit of one cost
is a prefix of another: least prefix and least suffix make the least concatenation, which
one walk over the tight edges of both sides reads off.

What is found depends on a conversation's row kinds alone (``kinds``), so answers for short
conversations are remembered. Rows meet by conversation in one shuffle; Spark sorts them,
on disk where need be, and they stream through the task. What a task holds of a
conversation is one letter a row, the search, and the texts in a spool that goes to disk
beyond ``SPOOL`` bytes. The contract's SHA-256 of a whole repaired conversation is one
chain, so a conversation can be told to one task only; it is streamed there, never held.

Null roles and texts are one space: such a text is blank, such a role must be changed.
Null ids are one conversation, null turns come first; equal turns are ordered by role and
text. Repeated rows are duplicates. Empty tables give no rows, very long texts are read
whole, other columns are not carried and may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opstrail.llm.common import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
SPOOL = 32 << 20
#: Rows an Arrow batch of results holds, and bytes of text after which it is sent earlier.
ROWS, BYTES = 5_000, 8 << 20
REMEMBERED, SHORT = 20_000, 64

#: States: nothing yet, after the system turn, after a user, after an assistant; and where a role leads.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STEP = {NONE: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTED = (NONE, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}


def edits(kind: str) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, initial) of the edits of a row; of insertions for kind ""."""
    out = []
    for state, roles in STEP.items():
        if not kind:
            out += [(state, to, INSERT, "I") for r, to in roles.items() if r in NAMES]
            continue
        out.append((state, state, DELETE, "D"))
        if kind == "-":
            continue
        extra, own = TRUNCATED * kind.isupper(), kind.lower()
        for r, to in roles.items():
            if r == own:
                out.append((state, to, KEEP + extra, "K"))
            elif r in NAMES:
                out.append((state, to, REROLE + extra, "R"))
    return out


#: By kind and state: the edits out of a node, and into one.
OUT = {k: [[e for e in edits(k) if e[0] == s] for s in range(4)] for k in ["", *"suax", *"SUAX", "-"]}
INTO = {k: [[e for e in edits(k) if e[1] == s] for s in range(4)] for k in OUT}


def _out(kinds: str, node: int) -> Iterator[tuple[int, int, str]]:
    i, s = divmod(node, 4)
    for _, to, cost, letter in OUT[""][s]:
        yield 4 * i + to, cost, letter
    if i < len(kinds):
        for _, to, cost, letter in OUT[kinds[i]][s]:
            yield 4 * i + 4 + to, cost, letter


def _into(kinds: str, node: int) -> Iterator[tuple[int, int, str]]:
    i, s = divmod(node, 4)
    for was, _, cost, letter in INTO[""][s]:
        yield 4 * i + was, cost, letter
    if i:
        for was, _, cost, letter in INTO[kinds[i - 1]][s]:
            yield 4 * i - 4 + was, cost, letter


def search(kinds: str) -> tuple[int, str]:
    """Cost and least audit of the cheapest edits of rows of these kinds.

    A kind is the row's role initial, s, u, a or x for any other, in capitals if the row is
    truncated, or "-" if it must go. Nodes are numbered 4 * i + state."""
    ends = [4 * len(kinds) + s for s in ACCEPTED]
    reach = ({0: 0}, dict.fromkeys(ends, 0))
    heaps = ([(0, 0)], [(0, -x) for x in ends])  # of equal costs the node further on its way comes last
    heapq.heapify(heaps[1])
    closed: tuple[set, set] = (set(), set())
    sign, steps = (1, -1), (_out, _into)
    best = min((reach[0][x] for x in ends if x in reach[0]), default=1 << 60)
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        far, node = heapq.heappop(heaps[side])
        node *= sign[side]
        if node in closed[side]:
            continue
        closed[side].add(node)
        own, other = reach[side], reach[1 - side]
        for to, cost, _ in steps[side](kinds, node):
            if far + cost < own.get(to, 1 << 60):
                own[to] = far + cost
                heapq.heappush(heaps[side], (far + cost, to * sign[side]))
                if to in other:
                    best = min(best, far + cost + other[to])
    forward, reverse = reach
    crossings = [x for x, far in forward.items() if x in reverse and far + reverse[x] == best]
    # The edges of cheapest ways on both sides of the crossings.
    tight: dict[int, dict[str, int]] = {}
    seen, todo = set(crossings), list(crossings)
    while todo:
        x = todo.pop()
        for was, cost, letter in _into(kinds, x):
            if was in forward and forward[was] + cost == forward[x]:
                tight.setdefault(was, {})[letter] = x
                if was not in seen:
                    seen.add(was)
                    todo.append(was)
    seen, todo = set(crossings), list(crossings)
    while todo:
        x = todo.pop()
        for to, cost, letter in _out(kinds, x):
            if to in reverse and reverse[to] + cost == reverse[x]:
                tight.setdefault(x, {})[letter] = to
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
    audit, node = [], 0
    while node in tight:
        letter = min(tight[node])
        audit.append(letter)
        node = tight[node][letter]
    return best, "".join(audit)


def fault_of(text: str, repeated: bool) -> str | None:
    """The first fault of a row."""
    body = text.rstrip(SPACE)
    return "blank" if not body else "duplicate" if repeated else None if body[-1] in ".!?" else "truncated"


def kind_of(role: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return "-"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return kind.upper() if fault else kind


class Rows:
    """The rows of one conversation in order, texts spooled to disk beyond ``SPOOL`` bytes."""

    def __init__(self):
        self.kinds, self.n = [], 0
        self.spool = tempfile.SpooledTemporaryFile(SPOOL)

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        fault = fault_of(text, repeated)
        self.kinds.append(kind_of(role, fault))
        parts = [x.encode() for x in (role, text, fault or "")]
        self.spool.write(struct.pack("<q?III", turn or 0, turn is None, *map(len, parts)) + b"".join(parts))

    def __iter__(self) -> Iterator[tuple[int | None, str, str, str | None]]:
        self.spool.seek(0)
        while head := self.spool.read(21):
            turn, no_turn, *sizes = struct.unpack("<q?III", head)
            role, text, fault = (self.spool.read(n).decode() for n in sizes)
            yield None if no_turn else turn, role, text, fault or None


FIELDS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("step", pa.int64()),
        ("edit", pa.string()),
        ("fault", pa.string()),
        ("turn", pa.int64()),
        ("old_role", pa.string()),
        ("role", pa.string()),
        ("text", pa.string()),
    ]
)
EDITS = "conv_id bigint, step bigint, edit string, fault string, turn bigint, old_role string, role string, text string"


def _edited(conv_id: int | None, rows: Rows, remembered: Callable) -> Iterator[tuple]:
    """The edits of a conversation in order; a single row without edit if it has no rows."""
    kinds = "".join(rows.kinds)
    audit = (remembered if len(kinds) <= SHORT else search)(kinds)[1]
    if not audit:
        yield conv_id, 0, None, None, None, None, None, None
    state, left = NONE, iter(rows)
    for step, edit in enumerate(audit):
        turn, old, text, fault = (None, None, "", None) if edit == "I" else next(left)
        role = old
        if edit in "IR":
            initial = next(r for r in STEP[state] if r in NAMES)
            role = NAMES[initial]
        if edit == "D":
            role = text = None
        else:
            state = STEP[state][role[:1]]
        yield conv_id, step, edit, fault, turn, old, role, text


def _repaired(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remembered = lru_cache(REMEMBERED)(search)  # one per task
    out, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FIELDS, strict=True)], schema=FIELDS)

    now, rows, begun = None, None, False
    for part in parts:
        for conv_id, turn, role, text, present, repeated in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if not begun or conv_id != now:
                if begun:
                    for x in _edited(now, rows, remembered):
                        out.append(x)
                        size += len(x[-1] or "")
                        if len(out) >= ROWS or size >= BYTES:
                            yield batch()
                            out, size = [], 0
                now, rows, begun = conv_id, Rows(), True
            if present:
                rows.add(turn, role, text, repeated)
    if begun:
        for x in _edited(now, rows, remembered):
            out.append(x)
            if len(out) >= ROWS:
                yield batch()
                out = []
    if out:
        yield batch()


def repair(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The edits of every conversation of ``rows`` (conv_id, turn, role, text), in order.

    One row per edit: conv_id, step, edit (K, R, D or I), fault (blank, duplicate, truncated),
    turn and old_role of the row it is about, role and text after it (null if deleted). A
    conversation whose rows are not ``present`` has one row without edit. Conversations
    are contiguous and in order of step within a partition.
    """
    order = F.col("turn").asc_nulls_first(), "role", "text"
    table_ = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else present).alias("present"),
    ).repartition("conv_id")
    # The exchange by conversation serves this window too: a second sort, no second shuffle.
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.col("turn").asc_nulls_first())
    marked = table_.withColumn("repeated", F.row_number().over(same) > 1)
    return marked.sortWithinPartitions("conv_id", *order).mapInArrow(_repaired, EDITS)


REPORT = pa.schema(
    [("conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


class Report:
    """What is counted of one conversation while its edits go by."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.turns = 0
        self.first = self.last = self.before = None
        self.audit, self.digest, self.begun = [], hashlib.sha256(), False

    def add(self, edit: str | None, fault: str | None, turn: int | None, old: str | None, role: str | None, text: str | None) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            self.cost += TRUNCATED * (fault == "truncated" and edit != "D")
            if self.before is not None:
                self.illegal += self.before + old[:1] not in LEGAL
            self.before = old[:1]
            if turn is not None and turn != self.last:  # turns come in order
                self.turns, self.last = self.turns + 1, turn
                self.first = turn if self.first is None else self.first
        if edit != "D":
            self.digest.update(("\n" * self.begun + f"{role}:{text}").encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _reported(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Report | None = None
    for part in parts:
        out = []
        for conv_id, step, *rest in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if now is None or not step:  # every conversation begins with step 0
                if now is not None:
                    out.append(now.row())
                now = Report(conv_id)
            now.add(*rest)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), REPORT, strict=True)], schema=REPORT)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.row(), REPORT, strict=True)], schema=REPORT)


def report(edits_: DataFrame) -> DataFrame:
    """One row per conversation from the edits that ``repair`` gives, read in its own order."""
    schema = (
        "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
        "cost bigint, audit string, repaired_sha256 string"
    )
    return edits_.mapInArrow(_reported, schema)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by a checksum of conversation and turn; dropped rows are not ``present``."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.pmod(F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")), F.lit(20))
    made = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return made.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("fault") != 0).alias("present"),
        copies.alias("copy"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation of the damaged table."""
    return report(repair(damage(table(spark, sf_dir, "conversations")), F.col("present")))
