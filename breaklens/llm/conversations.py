"""Repair of damaged conversations by Knuth's lightest derivations.

A repaired conversation's roles read ``(s?(ua)+)?``: maybe a system turn, then
user and assistant by turns. Its cheapest repair is the lightest derivation of
a goal item in a weighted deduction system: prefix items ("the rows up to here
are settled, the roles read so far end in this state") and row items ("this
row is there", "this row may stay"), combined by deductions that keep, rerole,
delete or insert a turn. A value is (cost, audit), compared in that order; a
deduction adds its cost and writes its letter behind the audits of its
antecedents, so its value is never below theirs (Knuth's superior functions),
and an item popped from the agenda is final.

Rows of a conversation are worked off in order, in blocks: the final prefix
items at the end of a block are the axioms of the next one. So a conversation
of any length needs the memory of a block and its audit.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breaklens.session import ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Role states: nothing yet, after system, after user, after assistant.
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ACCEPTED = ("", "a")
#: The goal: all rows are settled and the roles read as they should.
GOAL = (1 << 62, "goal")
NAMES = {"u": "user", "a": "assistant"}
#: Rows of a block, and characters of text that close one early.
BLOCK_ROWS, BLOCK_CHARS = 64, 1 << 20
#: From any state all completions of any other are reached by at most two inserts and a deletion
#: (3 + 3 + 4), so a prefix item that costs more than that above the lightest is in no lightest derivation.
SLACK = 2 * INSERT + DELETE
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Marks of a row: may stay, must go, stays at the cost of a truncation.
STAYS, GOES, CUT = "+", "-", "!"


def _deductions(item, rows):
    """Deductions with ``item`` among their antecedents: (antecedents, conclusion, cost, letter).

    Prefix items are (row, state), row items (row, "there") and (row, "may stay").
    """
    at, what = item
    if what in ("there", "may stay"):
        for state in ("", "s", "u", "a"):
            yield from _with_row(at, state, rows, what)
        return
    for role in "ua":
        if (what, role) in NEXT:
            yield ((at, what),), (at, NEXT[what, role]), INSERT, "I"
    if at < len(rows):
        yield from _with_row(at, what, rows, None)
    elif what in ACCEPTED:
        yield ((at, what),), GOAL, 0, ""


def _with_row(at, state, rows, only):
    initial, mark = rows[at]
    if only != "may stay":
        yield ((at, state), (at, "there")), (at + 1, state), DELETE, "D"
    if only != "there":
        extra = TRUNCATED if mark == CUT else 0
        pair = ((at, state), (at, "may stay"))
        if (state, initial) in NEXT:
            yield pair, (at + 1, NEXT[state, initial]), KEEP + extra, "K"
        for role in "ua":
            if (state, role) in NEXT:
                yield pair, (at + 1, NEXT[state, role]), REROLE + extra, "R"


@functools.lru_cache(maxsize=1 << 15)
def lightest(axioms: tuple, rows: tuple, last: bool) -> tuple:
    """The lightest derivations of a block of rows.

    ``axioms`` are (state, cost, audit) of prefix items before the rows,
    ``rows`` (role initial, mark) each. Returns (state, cost, audit, state of
    the axiom it comes from) of all prefix items behind the rows that may still
    be part of a lightest derivation, or, if these are the ``last`` rows, of
    the goal alone (state "goal").
    """
    agenda = [(cost, audit, (0, state), state) for state, cost, audit in axioms]
    for i, (_, mark) in enumerate(rows):
        agenda.append((0, "", (i, "there"), ""))
        if mark != GOES:
            agenda.append((0, "", (i, "may stay"), ""))
    heapq.heapify(agenda)
    final, wanted = {}, {GOAL} if last else {(len(rows), s) for s in ("", "s", "u", "a")}
    limit = None
    while agenda and wanted:
        cost, audit, item, origin = heapq.heappop(agenda)
        if item in final:
            continue
        if limit is not None and cost > limit:
            break
        final[item] = (cost, audit, origin)
        wanted.discard(item)
        if item == GOAL:
            break
        if limit is None and not last and item[0] == len(rows) and item[1] in ("", "s", "u", "a"):
            limit = cost + SLACK
        for antecedents, conclusion, weight, letter in _deductions(item, rows):
            if conclusion == GOAL and not last:
                continue
            if conclusion not in final and all(a in final for a in antecedents):
                values = [final[a] for a in antecedents]  # the prefix item first: its origin is kept
                heapq.heappush(agenda, (sum(v[0] for v in values) + weight,
                                        "".join(v[1] for v in values) + letter, conclusion, values[0][2]))
    if last:
        cost, audit, origin = final[GOAL]
        return (("goal", cost, audit, origin),)
    return tuple((s, *final[len(rows), s]) for s in ("", "s", "u", "a") if (len(rows), s) in final)


def apply_edits(state: str, edits: str, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that edits make of rows, from a role state on."""
    left = iter(rows)
    for e in edits:
        if e == "D":
            next(left)
            continue
        if e == "K":
            role, text = next(left)
            state = NEXT[state, role[:1]]
        else:
            text = next(left)[1] if e == "R" else ""
            state = "a" if state == "u" else "u"
            role = NAMES[state]
        yield role, text


class _Conversation:
    """Counts, and the live prefix items with their audits and hashes, of a conversation read row by row."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.role = None
        self.rows: list[tuple[str, str]] = []
        self.marks: list[tuple[str, str]] = []
        self.chars = self.cost = 0
        self.audit: list[str] = []  # what all live items share
        self.live = {"": (0, "", hashlib.sha256(), False)}  # cost above self.cost, rest of the audit, hash, any turn

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        initial = role[:1]
        if self.role is not None and self.role + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = initial
        said = text.rstrip(BLANK_CHARS)
        mark = STAYS
        if not said:
            self.blank, mark = self.blank + 1, GOES
        elif repeated:
            self.duplicate, mark = self.duplicate + 1, GOES
        elif said[-1] not in ".!?":
            self.truncated, mark = self.truncated + 1, CUT
        self.rows.append((role, text))
        self.marks.append((initial if initial in ("s", "u", "a") else "", mark))
        self.chars += len(text) + len(role)
        if len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS:
            self._settle(False)

    def _settle(self, last: bool) -> None:
        axioms = tuple((s, c, a) for s, (c, a, _, _) in self.live.items())
        found = lightest(axioms, tuple(self.marks), last)
        live = {}
        for state, cost, audit, origin in found:
            _, rest, digest, begun = self.live[origin]
            digest = digest.copy()
            for role, text in apply_edits(origin, audit[len(rest):], self.rows):
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                begun = True
            live[state] = (cost, audit, digest, begun)
        least = min(v[0] for v in live.values())
        shared = os.path.commonprefix([v[1] for v in live.values()])
        self.cost += least
        self.audit.append(shared)
        self.live = {s: (c - least, a[len(shared):], h, b) for s, (c, a, h, b) in live.items()}
        self.rows, self.marks, self.chars = [], [], 0

    def report(self) -> tuple:
        self._settle(True)
        _, _, digest, _ = self.live["goal"]
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit),
                digest.hexdigest())


REPORT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text, repeated, gone) in order of conversation and turn; a report each."""
    nobody = object()
    now, state = nobody, None
    names = ["conv_id", *(f.split()[0] for f in REPORT.split(", "))]
    done, kind = [], None

    def batch():
        cols = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7]),
             *(pa.array(c, pa.string()) for c in cols[7:])], names=names)

    for b in batches:
        kind = b.schema.field(0).type
        for conv, turn, role, text, repeated, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is nobody or conv != now:
                if state is not None:
                    done.append((now, *state.report()))
                now, state = conv, _Conversation()
            if not gone:
                state.add(turn, role, text, repeated)
        if done:
            yield batch()
            done = []
    if state is not None:
        done.append((now, *state.report()))
        yield batch()


def _ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
             gone: Column | None) -> DataFrame:
    """Rows by conversation in their order, with what they repeat: one exchange, by conversation."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    earlier = Window.partitionBy("conv_id", "gone", "said").orderBy(F.col("turn").asc_nulls_first())
    return (rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
                        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
                        (F.lit(False) if gone is None else gone).alias("gone"))
            .repartition("conv_id").withColumn("said", F.sha2(said, 256))
            .withColumn("repeated", F.row_number().over(earlier) > 1))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """Faults and the cheapest repair of every conversation, one row each.

    Rows of a conversation stand by turn (a whole number), null first, rows of
    one turn by role and text. A null role or text is one blank; rows where
    ``gone`` holds don't exist, but their conversation does. Returns
    ``conv_col`` and: gaps (turns missing between least and greatest),
    blank, duplicate, truncated (rows, each by its first fault), illegal
    (neighbours out of turn; a turn with an empty role can't be kept as it is), cost and audit of the cheapest repair, equal
    costs by the least audit, and repaired_sha256 of its lines ``role:text``.
    A conversation without rows has zeros, an empty audit and the hash of
    nothing. A null conversation id is a conversation, too. An empty table
    stays empty; other columns aren't looked at.

    Rows move once, by conversation. Since one digest covers all turns of a
    conversation in order, they stream through one task, sorted by Spark and
    read in blocks; nothing but the audit grows with the conversation.
    """
    ship_package(rows.sparkSession)
    kind = rows.schema[conv_col].dataType.simpleString()
    return (_ordered(rows, conv_col, turn_col, role_col, text_col, gone)
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")
            .select("conv_id", "turn", "role", "text", "repeated", "gone")
            .mapInArrow(_reports, f"conv_id {kind}, {REPORT}").withColumnRenamed("conv_id", conv_col))


def repaired_turns(rows: DataFrame, reports: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """The repaired conversations: ``conv_col``, line (from 0), role, text and edit (K, R or I) of every turn.

    ``reports`` are those of :func:`repair_conversations` of the same rows. Its
    audits are cut into one piece a row (the row's letter and inserts before
    it), which are joined to the rows; an insert has an empty text.
    """
    own = _ordered(rows, conv_col, turn_col, role_col, text_col, gone).where("not gone")
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "repeated")
    own = own.withColumn("at", F.row_number().over(in_order))
    pieces = reports.select(F.col(f"`{conv_col}`").alias("conv"), F.posexplode(
        F.regexp_extract_all("audit", F.lit("(I*[DKR]|I+$)"))).alias("piece", "edits"))
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("at") == F.col("piece") + 1)
    edits = pieces.join(own, same, "left").select(
        "conv", "piece", "role", "text", F.posexplode(F.split("edits", "")).alias("place", "edit"))
    by_line = Window.partitionBy("conv").orderBy("piece", "place")
    lines = (edits.where("edit <> 'D'")
             .withColumn("line", (F.row_number().over(by_line) - 1).cast("bigint"))
             .withColumn("system", F.first(F.when((F.col("edit") == "K") & F.col("role").startswith("s"), 1)
                                           .otherwise(0)).over(by_line)))
    name = F.when((F.col("line") - F.col("system")) % 2 == 0, NAMES["u"]).otherwise(NAMES["a"])
    return lines.select(F.col("conv").alias(conv_col), "line",
                        F.when(F.col("edit") == "K", F.col("role")).otherwise(name).alias("role"),
                        F.when(F.col("edit") == "I", F.lit("")).otherwise(F.col("text")).alias("text"), "edit")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> tuple[DataFrame, Column]:
    """Rows with faults planted by crc32 of ``conv_id:turn`` modulo 20, and the column that tells which are gone.

    0 drops a row, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats
    it, 4 makes its role user. Nulls count as one blank.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = (F.when(F.col("kind") == 1, F.lit(""))
            .when(F.col("kind") == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col)))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = (rows.select(conv_col, turn_col, role_col, text_col, kind.alias("kind"))
           .select(F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`"),
                   F.when(F.col("kind") == 4, F.lit("user")).otherwise(blank(role_col)).alias(role_col),
                   text.alias(text_col), "kind", F.explode(copies).alias("copy")))
    return out, F.col("kind") == 0
