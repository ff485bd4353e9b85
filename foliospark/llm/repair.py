"""Repair of damaged conversations by a square-root checkpointed dynamic program.

A conversation is in order if its role initials read ``(s?(ua)+)?``. Edits bring it
there: a row is kept, gets another role, or is deleted, and empty rows are inserted.
The cost left before each row is a vector over the four states of that pattern. Going
backward, the vectors are stored only at every k-th row, k the root of the number of
rows. Going forward, the block before the next stored vector is computed again, and
every edit on a cheapest way is tight: it costs what the vectors differ by. The first
tight one in ASCII order is taken.

Spark deals rows by conversation and sorts them twice, first backward without texts,
then forward with them. A task streams both in a row: of a conversation it holds the
stored vectors, one block of rows and the edits' initials, never all its texts. One
conversation is walked by one task, since its digest runs over all rows in order.

Defined results: a null role or text is one space, as is a null id or turn where it
is hashed. Rows of one turn are taken by role, then text, then copy. Rows of a null
conversation id form one conversation. A role whose first letter is not s, u or a, or
an empty one, fits nowhere as it is. Repeated rows are rows of their own, so the later
ones are duplicates. Texts of any length are read whole. An empty table gives no
rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED_COST = 0, 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
WHITE = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = ("su", "ua", "au")

# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
END = (0, FAR, FAR, 0)
# A user row is due in all states but after one; it is the row an edit can put there.
DUE = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))

Vector = tuple[int, int, int, int]


def follow(state: int, initial: str) -> int | None:
    """The state after a row of that initial, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    return DUE[state][0] if initial and initial == DUE[state][1][0] else None


def with_inserts(vector: list[int]) -> Vector:
    """Costs before a gap where rows may be inserted; two of them return to a state."""
    for _ in range(2):
        vector = [min(cost, INSERT + vector[DUE[q][0]]) for q, cost in enumerate(vector)]
    return tuple(vector)


def before_row(after: Vector, initial: str, fault: int) -> Vector:
    """Costs before a row, given those after it."""
    found = []
    for q in range(4):
        cost = DELETE + after[q]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            cost = min(cost, REROLE + extra + after[DUE[q][0]])
            kept = follow(q, initial)
            if kept is not None:
                cost = min(cost, KEEP + extra + after[kept])
        found.append(cost)
    return with_inserts(found)


class Conversation:
    """One conversation, its rows taken backward and then forward."""

    def __init__(self) -> None:
        self.stored: dict[int, Vector] = {}
        self.vector = with_inserts(list(END))
        self.rows = 0
        self.step = 1
        self.block: list[tuple[str, str, int]] = []
        self.done = 0
        self.state = START
        self.cost: int | None = None
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.last_initial: str | None = None
        self.turns: list[int] | None = None  # least, greatest and how many

    def backward(self, place: int, initial: str, fault: int) -> None:
        """A row, its place counted from 1; the last row comes first."""
        if not self.rows:
            self.rows, self.step = place, max(1, isqrt(place))
            self.stored[place] = self.vector
        self.vector = before_row(self.vector, initial, fault)
        if (place - 1) % self.step == 0:
            self.stored[place - 1] = self.vector

    def forward(self, turn: int | None, role: str, text: str, fault: int) -> None:
        """A row in order, after all have been taken backward."""
        initial = role[:1]
        self.faults[fault] += 1
        if self.last_initial is not None and self.last_initial + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.last_initial = initial
        if turn is not None:
            if self.turns is None:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1] = turn
                self.turns[2] += 1
        self.block.append((role, text, fault))
        if self.done + len(self.block) in self.stored:
            self._walk()

    def _walk(self) -> None:
        """Compute the block's vectors again and follow the tight edits through it."""
        last = self.done + len(self.block)
        vectors = [self.stored.pop(last)]
        for role, _, fault in reversed(self.block):
            vectors.append(before_row(vectors[-1], role[:1], fault))
        vectors.reverse()
        if self.cost is None:
            self.cost = vectors[0][START]
        for at, (role, text, fault) in enumerate(self.block):
            here, after = vectors[at], vectors[at + 1]
            while True:
                left = here[self.state]
                due, name = DUE[self.state]
                if DELETE + after[self.state] == left:
                    self.audit.append("D")
                    break
                if INSERT + here[due] == left:
                    self._put("I", due, name, "")
                    continue
                extra = TRUNCATED_COST if fault == TRUNCATED else 0
                kept = follow(self.state, role[:1])
                if kept is not None and KEEP + extra + after[kept] == left:
                    self._put("K", kept, role, text)
                else:
                    self._put("R", due, name, text)
                break
        if last == self.rows:
            while vectors[-1][self.state]:
                self._put("I", *DUE[self.state], "")
        self.done, self.block = last, []

    def _put(self, edit: str, state: int, role: str, text: str) -> None:
        if self.state != START:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.audit.append(edit)
        self.state = state

    def result(self) -> tuple:
        least, greatest, distinct = self.turns or (0, -1, 0)
        return (
            greatest - least + 1 - distinct,
            *self.faults[1:],
            self.illegal,
            self.cost or 0,
            "".join(self.audit),
            self.digest.hexdigest(),
        )


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def fault_of(role: Column, text: Column, earlier: Column) -> Column:
    """The first fault of a row; ``earlier`` says that an equal row came before."""
    trimmed = F.rtrim(text, F.lit(WHITE))
    ended = F.substring(trimmed, -1, 1).isin(".", "!", "?")
    return (
        F.when(trimmed == "", F.lit(BLANK))
        .when(earlier, F.lit(DUPLICATE))
        .when(~ended, F.lit(TRUNCATED))
        .otherwise(F.lit(0))
    )


def damage(df: DataFrame) -> DataFrame:
    """Rows of ``conv_id``, ``turn``, ``role``, ``text`` with faults put in by a hash.

    ``dropped`` marks rows that are gone; ``copy`` numbers repeated ones.
    """
    hashed = F.concat_ws(
        ":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    )
    kind = F.crc32(hashed.cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit(""))
        .when(kind == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def repair(df: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation.

    ``df`` has ``conv_id``, ``turn``, ``role`` and ``text``, and may have ``dropped``:
    such rows only name their conversation. Result: ``conv_id``, the longs ``COUNTS``,
    ``audit`` and ``repaired_sha256``.
    """
    if "dropped" not in df.columns:
        df = df.withColumn("dropped", F.lit(False))
    if "copy" not in df.columns:
        df = df.withColumn("copy", F.lit(0))
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        "dropped",
        "copy",
    )
    in_order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    placed = rows.repartition("conv_id").withColumn(
        "place", F.row_number().over(Window.partitionBy("conv_id", "dropped").orderBy(*in_order))
    )
    equal = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("place")
    judged = placed.withColumn(
        "fault", fault_of(F.col("role"), F.col("text"), F.row_number().over(equal) > 1)
    )
    # Backward rows, forward rows, and for dropped ones just the conversation.
    phases = F.when(F.col("dropped"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    both = judged.withColumn("phase", F.explode(phases)).select(
        "conv_id",
        "phase",
        F.when(F.col("phase") == 0, -F.col("place")).otherwise(F.col("place")).alias("place"),
        "turn",
        F.when(F.col("phase") == 0, F.substring("role", 1, 1)).otherwise(F.col("role")).alias("role"),
        F.when(F.col("phase") == 1, F.col("text")).alias("text"),
        "fault",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, found = None, None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for conv_id, phase, place, turn, role, text, fault in zip(*columns):
                if held is None or conv_id != name:
                    if held is not None:
                        found.append((name, *held.result()))
                    name, held = conv_id, Conversation()
                if phase == 0:
                    held.backward(-place, role, fault)
                elif phase == 1:
                    held.forward(turn, role, text, fault)
            if len(found) > 1000:
                yield table(found)
                found = []
        if held is not None:
            found.append((name, *held.result()))
        yield table(found)

    def table(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 9
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns[:7]]
            + [pa.array(c, pa.string()) for c in columns[7:]],
            ["conv_id", *COUNTS, "audit", "repaired_sha256"],
        )

    longs = ", ".join(f"{c} long" for c in COUNTS)
    return both.sortWithinPartitions("conv_id", "phase", "place").mapInArrow(
        run, f"conv_id long, {longs}, audit string, repaired_sha256 string"
    )
