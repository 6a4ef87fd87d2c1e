"""Conversation structure repair: the lightest derivation of a well-formed conversation, by Knuth's agenda."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscope.llm.common import small_batches

# The contract's costs.
RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# The grammar (s?(ua)+)? of role initials as an automaton: from a state, by an initial, to a state.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {
    (BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
INTO = {state: [(p, c) for (p, c), q in STEPS.items() if q == state] for state in range(4)}
FINAL = (BEGIN, ASSISTANT)
NEEDED = {BEGIN: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}  # the role that a rerole or insertion gives

BLOCK = 256  # rows whose derivations are found at once
BLANKS = "' \\t\\n\\u000B\\f\\r'"


# A plain table: functions wrapped by a cache would reach executors by their module's name, which is not there.
KNOWN: dict[tuple, dict[int, tuple[int, str]]] = {}


def derive(rows: str, finals: tuple[int, ...], start: int | None = None) -> dict[int, tuple[int, str]]:
    """``lightest`` with a bounded memory: conversations of the same shape are common."""
    found = KNOWN.get((rows, finals, start))
    if found is None:
        if len(KNOWN) >= 1 << 15:
            KNOWN.clear()
        found = KNOWN[rows, finals, start] = lightest(rows, finals, start)
    return found


def lightest(rows: str, finals: tuple[int, ...], start: int | None = None) -> dict[int, tuple[int, str]]:
    """Cost and audit of the lightest way from each state (or from ``start`` alone) over the rows to one of ``finals``.

    A row is the initial of its role, ``x`` if it has none of the grammar's, as a capital if the row is truncated; a
    ``-`` must be deleted. An item (rows from i on, state) says that they can be brought from the state to the end.
    Each edit is a weighted deduction: it puts its initial before the audit of an item and adds its cost. Items are
    popped by (cost, rows covered, audit). No deduction lowers the first two, and of one item's derivations the audits
    compare as their remainders do, so an item is final when it is popped.
    """
    n = len(rows)
    agenda = [(0, 0, "", state) for state in finals]
    heapq.heapify(agenda)
    done: set[tuple[int, int]] = set()
    goals: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, covered, audit, state = heapq.heappop(agenda)
        if (covered, state) in done:
            continue
        done.add((covered, state))
        if covered == n:
            goals[state] = (cost, audit)
            if state == start:
                break
        for before, initial in INTO[state]:
            if initial != "s" and (covered, before) not in done:
                heapq.heappush(agenda, (cost + INSERT, covered, "I" + audit, before))
        if covered < n:
            row = rows[n - covered - 1]
            heapq.heappush(agenda, (cost + DELETE, covered + 1, "D" + audit, state))
            if row != "-":
                own, held = row.lower(), cost + (TRUNCATED if row.isupper() else 0)
                for before, initial in INTO[state]:
                    if initial == own:
                        heapq.heappush(agenda, (held, covered + 1, "K" + audit, before))
                    if initial != "s":
                        heapq.heappush(agenda, (held + RETAG, covered + 1, "R" + audit, before))
    return goals


def realise(rows: list[tuple[str, str, str]], state: int, audit: str) -> list[tuple[str, str, str]]:
    """(edit, role, text) of each edit; ``rows`` are (symbol, role, text), ``state`` is that before the first."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            role, text = NEEDED[state], ""
        else:
            _, role, text = rows[at]
            at += 1
            if edit == "R":
                role = NEEDED[state]
        if edit != "D":
            state = STEPS[state, role[:1]]
        out.append((edit, role, text))
    return out


class Repair:
    """The repair of one conversation whose rows come in order, a block at a time.

    Of every state that the rows so far can end in, the lightest way is held. Two ways of equal cost over the same
    rows never are one the beginning of the other (it would have more insertions), so the lesser stays the lesser
    whatever follows. What all ways share is final; only the rest is held.
    """

    def __init__(self):
        self.ways = {BEGIN: (0, "", [])}  # cost, and audit and edits since the last shared part
        self.rows: list[tuple[str, str, str]] = []

    def add(self, symbol: str, role: str, text: str) -> list[tuple[str, str, str]]:
        self.rows.append((symbol, role, text))
        return self._block() if len(self.rows) >= BLOCK else []

    def _block(self) -> list[tuple[str, str, str]]:
        rows, symbols = self.rows, "".join(r[0] for r in self.rows)
        self.rows = []
        chosen = {}
        for end in range(4):
            found = derive(symbols, (end,))
            every = [
                (cost + found[state][0], audit + found[state][1], state) for state, (cost, audit, _) in self.ways.items() if state in found
            ]
            if every:
                chosen[end] = min(every)
        sources = {state for _, _, state in chosen.values()}
        shared, cut = [], 0
        if len(sources) == 1:
            _, audit, shared = self.ways[next(iter(sources))]
            cut = len(audit)
        ways = {}
        for end, (cost, audit, state) in chosen.items():
            _, before, held = self.ways[state]
            edits = realise(rows, state, audit[len(before):])
            ways[end] = (cost, audit[cut:], edits if len(sources) == 1 else held + edits)
        self.ways = ways
        return shared

    def finish(self) -> tuple[int, list[tuple[str, str, str]]]:
        """Cost of the whole, and the edits not given yet."""
        symbols = "".join(r[0] for r in self.rows)
        every = []
        for state, (cost, audit, held) in self.ways.items():
            found = derive(symbols, FINAL, state).get(state)
            if found:
                every.append((cost + found[0], audit + found[1], state, len(audit)))
        cost, audit, state, cut = min(every)
        return cost, self.ways[state][2] + realise(self.rows, state, audit[cut:])


def damage(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) with the contract's damage by crc32(conv_id:turn) % 20.

    ``dropped`` marks the rows that 0 drops; 1 empties the text, 2 takes out ``.!?``, 3 repeats the row, 4 makes the
    role ``user``. NULLs are one space.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), (code == 0).alias("dropped"),
        F.when(code == 4, "user").otherwise(filled("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text")).alias("text"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (B, D, T or empty) and symbol, the rows of a conversation together and in order.

    Duplicates are found among the rows that agree in conversation, role and text, not among all of a conversation.
    """
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    same = Window.partitionBy("conv_id", "dropped", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    end = F.expr(f"right(trim(TRAILING {BLANKS} FROM text), 1)")
    fault = (
        F.when(F.col("dropped"), "-").when(end == "", "B").when(F.col("again"), "D").when(~end.isin(".", "!", "?"), "T").otherwise("")
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("fault").isin("B", "D"), "-").when(F.col("fault") == "T", F.upper(letter)).otherwise(letter)
    marked = rows.withColumn("again", F.row_number().over(same) > 1)
    return marked.withColumn("fault", fault).withColumn("symbol", symbol).select(
        "conv_id", "turn", "role", "text", "fault", "symbol"
    ).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


class Report:
    """Counts over one conversation, row by row."""

    def __init__(self):
        self.repair, self.hash, self.audit, self.lines = Repair(), hashlib.sha256(), [], 0
        self.faults = {"B": 0, "D": 0, "T": 0}
        self.illegal, self.initial = 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: str, symbol: str) -> list[tuple[str, str, str]]:
        if fault == "-":
            return []
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = (turn if self.first is None else self.first), turn
        return self.note(self.repair.add(symbol, role, text))

    def note(self, edits: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
        for edit, role, text in edits:
            self.audit.append(edit)
            if edit != "D":
                self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
                self.lines += 1
        return edits

    def finish(self) -> tuple[list[tuple[str, str, str]], tuple]:
        cost, edits = self.repair.finish()
        self.note(edits)
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return edits, (
            gaps, self.faults["B"], self.faults["D"], self.faults["T"], self.illegal, cost, "".join(self.audit), self.hash.hexdigest(),
        )


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each row in turn: conversation, edits that are final now, report (None but at the conversation's end)."""
    report, name = None, None
    for batch in batches:
        for conv_id, *row in zip(*(column.to_pylist() for column in batch.columns)):
            if report is None or conv_id != name:
                if report is not None:
                    yield name, *report.finish()
                report, name = Report(), conv_id
            edits = report.add(*row)
            if edits:
                yield name, edits, None
    if report is not None:
        yield name, *report.finish()


def conversation_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn (long), role and text without NULLs, as ``damage`` gives them, and perhaps ``dropped``:
    such rows count for nothing, but their conversation is reported. Rows are taken by turn, NULL turns first; rows of
    one turn by role, then text. NULL is a conversation like others. Each row's first fault counts. A conversation
    passes through one task row by row, as its digest is of its whole text, but no more than a few blocks of it are
    held. An empty table gives no rows; further columns are not read.
    """
    small_batches(rows.sparkSession, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def ship() -> pa.RecordBatch:
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7]),
                 pa.array(columns[7], pa.string()), pa.array(columns[8], pa.string())],
                names=["conv_id", *COUNTS, "audit", "repaired_sha256"],
            )

        for name, _, report in _conversations(batches):
            if report is not None:
                held.append((name, *report))
                if len(held) >= 4096 or len(report[6]) > 1 << 20:
                    yield ship()
                    held = []
        if held:
            yield ship()

    id_field = rows.schema["conv_id"]
    id_type = to_arrow_type(id_field.dataType)
    schema = T.StructType([id_field, *T.StructType.fromDDL(
        ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string").fields])
    return _marked(rows).mapInArrow(run, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The edits of each conversation in order: conv_id, position, edit (K, R, D or I), role, text.

    Rows as for ``conversation_report``; without the D rows these are the repaired conversations.
    """
    small_batches(rows.sparkSession, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = 0
        for name, edits, report in _conversations(batches):
            if edits:
                kinds, roles, texts = zip(*edits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(edits), id_type), pa.array(range(position, position + len(edits)), pa.int64()),
                     pa.array(kinds), pa.array(roles), pa.array(texts)], names=["conv_id", "position", "edit", "role", "text"],
                )
            position = 0 if report is not None else position + len(edits)

    id_field = rows.schema["conv_id"]
    id_type = to_arrow_type(id_field.dataType)
    schema = T.StructType([id_field, *T.StructType.fromDDL("position long, edit string, role string, text string").fields])
    return _marked(rows).mapInArrow(run, schema)
