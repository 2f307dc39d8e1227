"""Repair of conversation structure by iterative-deepening A*.

Rows (conv_id, turn, role, text) of a conversation are read by turn (nulls first; ties by role,
then by the MD5 of the text). A row's first fault counts: blank (no word), duplicate (role and
text seen earlier), truncated (the last character of the last word is none of . ! ?). Edits, row
by row: K keeps a row (0), R gives it the role user or assistant (3), D deletes it (4; blank and
duplicate rows must go), I inserts an empty user or assistant row (3); a truncated row that stays
costs 3 more. A conversation is well formed if the initials of its roles read (s?(ua)+)?.

Search: depth first in ASCII order of the edits (D, I, K, R) below a bound on the cost, which
rises to the least cost that exceeded it until a path is accepted. The first accepted path is the
cheapest, and of equally cheap ones the first in ASCII order. States are (row, role before);
those that failed with a remaining budget are not entered again with as little. The bound on the
cost still to come is that of a smaller problem, in which only user and assistant alternate: a
system row has to go or change its role there, so that before the first row is placed one
deletion (4) is taken off where a system row follows.

On Spark: one shuffle by conversation. Each row is sent twice, once without its text (what the
search needs) and once with it, sorted so that all bare rows of a conversation come first. A
task streams them in Arrow batches: it holds some 100 bytes a row of the conversation at hand,
never its texts. A conversation is not split further, because its audit is one value
and its hash is one SHA-256 over all its texts in order.

Null role and null text are one space, so such a role is changed or deleted, such a text
blank. A null conv_id is a conversation of its own. An empty role has no initial and is never
kept. Other columns are ignored. No rows give no conversations.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {USER: "u", ASSISTANT: "a", SYSTEM: "s"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A row as the search sees it: its initial (x: none of the three) or d, which must go; capital
#: if it is truncated.
GONE, OTHER = "d", "x"
#: Conversations of at most so many rows share their search with equal ones.
SHORT = 64
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
BLANKS = r"[^\x20\x09-\x0D]"


def bounds(rows: str) -> tuple[list[int], list[int]]:
    """Least cost of rows[i:] in the smaller problem where a user or an assistant comes next."""
    user, assistant = [0] * (len(rows) + 1), [0] * (len(rows) + 1)
    assistant[-1] = INSERT
    for i in range(len(rows) - 1, -1, -1):
        u, a, row = user[i + 1], assistant[i + 1], rows[i]
        if row == GONE:
            user[i], assistant[i] = u + DELETE, a + DELETE
            continue
        stay = TRUNCATED if row.isupper() else 0
        as_user = stay + (KEEP if row in "uU" else REROLE)
        as_assistant = stay + (KEEP if row in "aA" else REROLE)
        user[i] = min(u + DELETE, a + as_user, u + INSERT + as_assistant)
        assistant[i] = min(a + DELETE, u + as_assistant, a + INSERT + as_user)
    return user, assistant


def following(state: int) -> int:
    """The role that may come next: a user, but an assistant after a user."""
    return ASSISTANT if state == USER else USER


def cheapest(rows: str) -> tuple[int, str]:
    """Cost and edits of the cheapest repair, the first in ASCII order among equals."""
    n, (user, assistant) = len(rows), bounds(rows)
    system = max(rows.rfind("s"), rows.rfind("S"))

    def ahead(i: int, state: int) -> int:
        if state == USER:
            return assistant[i]
        slack = DELETE if state == START and i <= system else 0
        return max(0, user[i] - slack)

    limit = ahead(0, START)
    while True:
        failed, beyond = array("q", [-1]) * (4 * (n + 1)), None
        path, stack = [], [[0, START, 0, 0]]  # row, role before, spent, edits tried
        while stack:
            top = stack[-1]
            i, state, spent, tried = top
            if i == n and state in (START, ASSISTANT):
                return spent, "".join(path)
            if tried == 4:
                failed[4 * i + state] = limit - spent
                stack.pop()
                if path:
                    path.pop()
                continue
            top[3] += 1
            edit, to, at = "DIKR"[tried], following(state), i
            if edit == "I":
                spent += INSERT
            elif i == n:
                continue
            else:
                row, at = rows[i], i + 1
                if edit == "D":
                    spent, to = spent + DELETE, state
                elif row == GONE:
                    continue
                else:
                    spent += TRUNCATED if row.isupper() else 0
                    if edit == "R":
                        spent += REROLE
                    elif row in "sS" and state == START:
                        to = SYSTEM
                    elif row.lower() != INITIAL[to]:
                        continue
            least = spent + ahead(at, to)
            if least > limit:
                beyond = least if beyond is None else min(beyond, least)
            elif failed[4 * at + to] < limit - spent:
                path.append(edit)
                stack.append([at, to, spent, 0])
        limit = beyond


class Conversation:
    """What a task holds of the conversation at hand: first the rows without text, then, once
    the edits are known, the repaired rows one by one."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.seen = conv_id, [], set()
        self.turns, self.first, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before, self.audit = None, None

    def bare(self, turn, role, digest, fault) -> None:
        """A row without its text, in order; fault is blank, truncated or null."""
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        symbol = initial if initial and initial in "sua" else OTHER
        again = (role, digest) in self.seen
        if fault == "blank":
            self.blank += 1
            symbol = GONE
        elif again:
            self.duplicate += 1
            symbol = GONE
        elif fault == "truncated":
            self.truncated += 1
            symbol = symbol.upper()
        if not again:
            self.seen.add((role, digest))
        self.rows.append(symbol)

    def decide(self, remembered) -> None:
        rows = "".join(self.rows)
        self.cost, self.audit = (remembered if len(rows) <= SHORT else cheapest)(rows)
        self.seen, self.rows = None, None
        self.at, self.state, self.kept = 0, START, 0

    def placed(self, role: str) -> int:
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        self.kept += 1
        return self.kept - 1

    def inserted(self) -> Iterator[tuple]:
        """(place, edit, turn, role, text) of the rows inserted at this point."""
        while self.audit[self.at : self.at + 1] == "I":
            role = ROLE[following(self.state)]
            self.at += 1
            yield self.placed(role), "I", None, role, ""

    def whole(self, turn, role, text) -> Iterator[tuple]:
        """The same for the next row with its text, and what is inserted before it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = ROLE[following(self.state)] if edit == "R" else role
            yield self.placed(role), edit, turn, role, text

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


def ordered(rows: DataFrame) -> DataFrame:
    """Rows bare and whole, together by conversation and in the order that tasks read."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text = filled("text")
    last = F.regexp_extract(text, rf"({BLANKS})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(~last.rlike("[.!?]"), "truncated")
    made = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        filled("role").alias("role"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        fault.alias("fault"),
        text.alias("text"),
    )
    bare = F.struct(F.lit(False).alias("whole"), "fault", F.lit(None).cast("string").alias("text"))
    whole = F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("fault"), "text")
    sent = made.select("conv_id", "turn", "role", "digest", F.explode(F.array(bare, whole)).alias("r"))
    return (
        sent.select("conv_id", "r.whole", "turn", "role", "digest", "r.fault", "r.text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "whole", F.col("turn").asc_nulls_first(), "role", "digest")
    )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, tuple | None]]:
    """(conversation, repaired row) in order; None behind the last row of a conversation."""
    now, remembered = None, lru_cache(1 << 14)(cheapest)
    for batch in batches:
        for conv_id, whole, turn, role, digest, fault, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield from ((now, row) for row in now.inserted())
                    yield now, None
                now = Conversation(conv_id)
            if whole:
                if now.audit is None:
                    now.decide(remembered)
                yield from ((now, row) for row in now.whole(turn, role, text))
            else:
                now.bare(turn, role, digest, fault)
    if now is not None:
        yield from ((now, row) for row in now.inserted())
        yield now, None


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    part, held = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*part)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )

    for row in rows:
        part.append(row)
        held += len(row[-1])
        if len(part) == most or held > 1 << 22:
            yield batch()
            part, held = [], 0
    if part:
        yield batch()


def _id(rows: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations, row by row: conv_id, place (from 0), edit (K, R or I), turn
    (null for inserted rows), role and text."""
    name, kind = _id(rows)
    schema = pa.schema(
        [("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
         ("role", pa.string()), ("text", pa.string())]
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c.conv_id, *row) for c, row in _streamed(batches) if row is not None)
        return _batches(rows, schema)

    return ordered(rows).mapInArrow(
        rewrite, f"conv_id {name}, place long, edit string, turn long, role string, text string"
    )


def reports(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts of its faults, cost and edits of its repair, the number
    of rows left and the SHA-256 of the repaired rows as `role:text` lines."""
    name, kind = _id(rows)
    schema = pa.schema(
        [("conv_id", kind), *((c, pa.int64()) for c in COUNTS), ("kept_rows", pa.int64()),
         ("repaired_sha256", pa.string()), ("audit", pa.string())]
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest = hashlib.sha256()
        for c, row in _streamed(batches):
            if row is None:
                counts = (getattr(c, n) for n in COUNTS)
                yield (c.conv_id, *counts, c.kept, digest.hexdigest(), c.audit)
                digest = hashlib.sha256()
            else:
                place, _, _, role, text = row
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())

    fields = ", ".join(f"{c} long" for c in (*COUNTS, "kept_rows"))
    return ordered(rows).mapInArrow(
        lambda batches: _batches(digests(batches), schema),
        f"conv_id {name}, {fields}, repaired_sha256 string, audit string",
    )


def well_formed(initials: Column) -> Column:
    return initials.rlike("^(s?(ua)+)?$")
