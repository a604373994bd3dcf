"""Conversation structure repair by iterative-deepening A*.

A conversation is well formed if the initials of its roles are (s?(ua)+)?. Each of its rows has a fault at most: it is blank, or repeats role and
text of an earlier row, or doesn't end a sentence. A row is deleted (cost 2), kept (0), or given the role that must come next (1); blank
and repeated rows must go, and a row that ends in the middle of a sentence costs 5 more if it stays; an empty row of the role that must come
next may be put in anywhere (5).

A depth-first search takes the edits in the order of their initials, D, I, K, R, under a bound on the cost, which begins at a lower
bound of the whole cost and grows to the least cost that the last search cut off. A state is a row and the role that came last. The table of
states that failed holds what their rest costs at least, so that no state is entered again with too little left. The first path that is accepted is
the cheapest and, of those, the least by its initials. In long conversations the states at every 64th row are searched first, from
the end on, so that searches meet states whose rest is known.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import runs

FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
EDITS = "DIKR"
DELETE, INSERT, REROLE, UNENDED = 2, 5, 1, 5
#: States: before any role, after system, after user, after assistant. The next one, by the initial that follows.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The role that may always come next, and the state after it.
WANTED = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
ACCEPTED = (True, False, False, True)
STRETCH = 64
REPAIRED = "conv_id long, n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


class Search:
    """The edits of one conversation, given the initials and faults of its rows."""

    def __init__(self, initials: Sequence[str], faults: Sequence[int]):
        self.initials, self.faults, self.n = initials, faults, len(initials)
        # What a state's rest costs at least: first by its rows alone, then by what failed.
        self.least = array("q", bytes(32 * (self.n + 1)))
        self.least[4 * self.n + 1], self.least[4 * self.n + 2] = 2 * INSERT, INSERT
        start = later = 0
        for i in range(self.n - 1, -1, -1):
            faulty = faults[i] != FINE
            start += DELETE if faulty else initials[i] not in ("s", "u", "a")
            later += DELETE if faulty else initials[i] not in ("u", "a")
            self.least[4 * i] = start
            for q in (1, 2, 3):
                self.least[4 * i + q] = later
        self.known = bytearray(4 * (self.n + 1))

    def edits(self, i: int, q: int) -> list[tuple[str, int, int]]:
        """The edits that a state allows, by their initials: (initial, cost, place of the next state)."""
        to = WANTED[q][1]
        insert = ("I", INSERT, 4 * i + to)
        if i == self.n:
            return [insert]
        out = [("D", DELETE, 4 * (i + 1) + q), insert]
        fault = self.faults[i]
        if fault in (FINE, TRUNCATED):
            more = UNENDED if fault == TRUNCATED else 0
            kept = NEXT[q].get(self.initials[i])
            if kept is not None:
                out.append(("K", more, 4 * (i + 1) + kept))
            out.append(("R", more + REROLE, 4 * (i + 1) + to))
        return out

    def deepen(self, root: int, whole: bool) -> str:
        """Raises the bound until a path from a state is accepted, and returns its initials; unless whole, a state whose rest is known ends it."""
        while True:
            path = self._dive(root, self.least[root], whole)
            if path is not None:
                self.known[root] = 1
                return path

    def _dive(self, root: int, bound: int, whole: bool) -> str | None:
        """Depth first from a state; None where no path is accepted within the bound, and then the state's rest costs more."""
        least = self.least
        stack = [[root, bound, self.edits(root >> 2, root & 3), 0]]
        path: list[str] = []
        while stack:
            frame = stack[-1]
            place, left, edits, k = frame
            if k == 0 and place >> 2 == self.n and ACCEPTED[place & 3]:
                return "".join(path)
            if not whole and k == 0 and len(stack) > 1 and self.known[place]:
                return "".join(path)
            while k < len(edits):
                initial, cost, to = edits[k]
                k += 1
                if cost + least[to] <= left:
                    frame[3] = k
                    path.append(initial)
                    stack.append([to, left - cost, self.edits(to >> 2, to & 3), 0])
                    break
            else:
                least[place] = max(least[place], min(cost + least[to] for _, cost, to in edits))
                stack.pop()
                if path:
                    path.pop()
        return None

    def run(self) -> tuple[int, str]:
        """The least cost, and the audit of the path that has it."""
        rows = self.least[:]
        for end in range(self.n - STRETCH, STRETCH, -STRETCH):
            for q in range(4):
                self.deepen(4 * end + q, False)
            # Whatever comes before passes one of these states; its rows up to there cost what they cost by themselves.
            passed = min(self.least[4 * end : 4 * end + 4])
            for place in range(4 * max(0, end - STRETCH), 4 * end):
                own = rows[place] - rows[4 * end + (place & 3)]
                self.least[place] = max(self.least[place], passed + own)
        audit = self.deepen(0, True)
        return self.least[0], audit


def faults_of(rows: Sequence[tuple[str, str]]) -> list[int]:
    """The first fault of each (role, text), in their order."""
    seen, out = set(), []
    for row in rows:
        said = row[1].rstrip(" \t\n\v\f\r")
        out.append(BLANK if not said else DUPLICATE if row in seen else TRUNCATED if said[-1] not in ".!?" else FINE)
        seen.add(row)
    return out


def apply(rows: Sequence[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows after the edits of an audit."""
    out, q, at = [], 0, 0
    for edit in audit:
        role, to = WANTED[q]
        if edit == "I":
            out.append((role, ""))
        elif edit == "R":
            out.append((role, rows[at][1]))
        elif edit == "K":
            out.append(rows[at])
            to = NEXT[q][rows[at][0][:1]]
        if edit != "D":
            q = to
        at += edit != "I"
    return out


def _one(turns: list, rows: list[tuple[str, str]]) -> tuple:
    faults = faults_of(rows)
    initials = [role[:1] for role, _ in rows]
    numbers = {t for t in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = Search(initials, faults).run()
    return len(rows), gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit, apply(rows, audit)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, what is wrong with it, the cost and audit of its cheapest repair, and the repaired rows.

    gaps are turns missing between the first and the last; illegal counts neighbours whose initials are not su, ua or au; the audit has an initial for each
    edit: Delete, Insert, Keep, Rerole. Rows are ordered by turn (null first), equal turns by role and text, so that repeated rows are
    neighbours. Null roles and texts are one space. Rows of a null conv_id are one conversation. Rows where `absent` is true are none, but their conversation has
    a row: zeros, an empty audit and nothing repaired. Other columns are not read. An empty table gives an empty table. Conversations are
    sorted in their partition and read as a stream; the largest single one, a row of the result, must fit into a task.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("key"), F.col(turn_col).cast("long").alias("turn"),
        space(role_col).alias("role"), space(text_col).alias("text"), F.coalesce(absent if absent is not None else F.lit(False), F.lit(False)).alias("absent"),
    )
    rows = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in REPAIRED.rsplit(", ", 1)[0].split(", ")]
        types = [*[pa.int64()] * 8, pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
        out, held = [], 0
        for table in runs(batches, "key"):
            there = [not x for x in table.column("absent").to_pylist()]
            pick = lambda c: [v for v, ok in zip(table.column(c).to_pylist(), there) if ok]  # noqa: E731, B023
            row = _one(pick("turn"), list(zip(pick("role"), pick("text"))))
            out.append((table.column("conv_id")[0].as_py(), *row[:-1], [{"role": r, "text": t} for r, t in row[-1]]))
            held += table.nbytes
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*names, "repaired"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*names, "repaired"])

    return rows.mapInArrow(run, REPAIRED)


def damage(turns: DataFrame) -> DataFrame:
    """conversations with planted faults, by crc32 of "conv_id:turn" modulo 20, and `gone` for the rows that are dropped.

    0 drops a row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes its role user. Nulls are one space, a null turn stays null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = turns.withColumn("kind", kind).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"))
