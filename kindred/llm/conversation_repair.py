"""Conversation repair as the lightest derivation of a weighted deduction system.

An item ``(k, state)`` says that the first ``k`` rows of a conversation are dealt
with and that the roles so far end in ``state`` of ``(s?(ua)+)?``. A deduction
joins an item and an edit of the next row (or a span of rows that is derived
already) into a later item; its weight is the pair of added costs and joined
audits. Knuth's agenda pops the lightest item that is not final, by cost, rows
and audit; joining never makes an item lighter, and of two audits for the same
rows at the same cost none begins the other, so a popped item is final. The
search ends when the goal item is popped.

Only a short symbol per row takes part. Rows are sorted over all tasks, so a long
conversation becomes many spans that are derived in parallel, each from every
state to every state, and are then joined by the same agenda.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import materialise

SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system row, after a user row, after an assistant row.
STATES = range(4)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The state behind the one role that may be put in, and that role.
PUT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
COMPLETE = (0, 3)
LEGAL = ("su", "ua", "au")
DELETE, INSERT, REROLE = 3, 2, 2
#: Rows of a span that is derived at once and remembered, and spans that are joined at once.
LEAF, FAN = 32, 64
LONGEST = 2**63 - 1

#: From each state the states that can be reached: state, cost, audit.
Table = tuple[tuple[tuple[int, int, str], ...], ...]


def agenda(steps: Sequence[Table], start: int, goal: bool, insert: bool):
    """Final items behind all steps as ``(state, cost, audit)``; with ``goal`` the cost and audit of the lightest complete one."""
    n, final, queue = len(steps), {}, [(0, 0, "", start)]
    while queue:
        cost, k, audit, state = heapq.heappop(queue)
        if (k, state) in final:
            continue
        final[k, state] = (state, cost, audit)
        if goal and k == n and state in COMPLETE:
            return cost, audit
        if insert and (k, PUT[state]) not in final:
            heapq.heappush(queue, (cost + INSERT, k, audit + "I", PUT[state]))
        if k < n:
            for reached, more, letters in steps[k][state]:
                if (k + 1, reached) not in final:
                    heapq.heappush(queue, (cost + more, k + 1, audit + letters, reached))
    return tuple(final[n, state] for state in STATES if (n, state) in final)


@lru_cache(64)
def edits(symbol: str) -> Table:
    """What may be done with one row: ``-`` must go; else its initial, a capital if its text is truncated."""
    out = []
    for state in STATES:
        found = [(state, DELETE, "D")]
        if symbol != "-":
            late, initial = int(symbol.isupper()), symbol.lower()
            found.append((PUT[state], REROLE + late, "R"))
            if (state, initial) in AFTER:
                found.append((AFTER[state, initial], late, "K"))
        out.append(tuple(found))
    return tuple(out)


@lru_cache(1 << 14)
def leaf(symbols: str) -> Table:
    steps = [edits(s) for s in symbols]
    return tuple(agenda(steps, state, goal=False, insert=True) for state in STATES)


@lru_cache(1 << 16)
def short(symbols: str) -> tuple[int, str]:
    return agenda([edits(s) for s in symbols], 0, goal=True, insert=True)


def joined(tables: list[Table]) -> list[Table]:
    """At most ``FAN`` tables for the same rows."""
    while len(tables) > FAN:
        parts = (tables[i : i + FAN] for i in range(0, len(tables), FAN))
        tables = [tuple(agenda(part, state, goal=False, insert=False) for state in STATES) for part in parts]
    return tables


def leaves(symbols: str) -> list[Table]:
    return joined([leaf(symbols[i : i + LEAF]) for i in range(0, len(symbols), LEAF)])


def span(symbols: str) -> Table:
    tables = leaves(symbols)
    return tables[0] if len(tables) == 1 else tuple(agenda(tables, state, goal=False, insert=False) for state in STATES)


def lightest(symbols: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a whole conversation, the least audit of several."""
    if len(symbols) <= LEAF:
        return short(symbols)
    return agenda(leaves(symbols), 0, goal=True, insert=False)


def plain_role(role: Column) -> Column:
    return F.coalesce(role, F.lit(" "))


def _digest(role: Column, text: Column) -> Column:
    """Equal for equal roles and texts, and orders rows of one turn and role."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _spelled(rows: DataFrame) -> DataFrame:
    role, text = plain_role(F.col("role")), F.coalesce("text", F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn(
        "same", _digest(F.col("role"), F.col("text"))
    )


def _marked(rows: DataFrame) -> DataFrame:
    """One row per different row, without its text: how often it occurs, its role's initial, what its text is like, and whether it is the first alike.

    Equal rows are counted before they are shuffled. The first of its kind is
    found by conversation and digest, and joined back by the turn as well, so a
    row that is said again and again is no hot key.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    seen = _spelled(rows).select(
        "conv_id", "turn", "role", "same", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    rows = seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias("copies"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min(F.struct("turn"))["turn"].alias("t"))
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")) & F.col("turn").eqNullSafe(F.col("t"))
    return rows.join(first, here, "left").select(*rows.columns, F.col("s").isNotNull().alias("first"))


STATS = "conv_id long, part long, whole boolean, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, opens string, closes string, cost long, audit string, spans array<array<struct<state: int, cost: long, audit: string>>>"
_SPANS = pa.list_(pa.list_(pa.struct({"state": pa.int32(), "cost": pa.int64(), "audit": pa.string()})))


def _deriving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of the conversations of sorted rows; one that touches an end of a batch may go on elsewhere, and gets spans instead of a cost."""
    task = TaskContext.get().partitionId() << 32
    for number, batch in enumerate(batches):
        if not len(batch):
            continue
        ids, turns, initials = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial"))
        blank, cut, first = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("blank", "truncated", "first"))
        copies = batch.column("copies").to_numpy()
        good = ~blank & first
        symbols = [
            "-" * n if not g else (i.upper() if t else i) + "-" * (n - 1) for n, g, i, t in zip(copies.tolist(), good.tolist(), initials, cut.tolist())
        ]
        begins = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
        ends = [*begins[1:], len(ids)]
        rows = []
        for a, b in zip(begins, ends):
            known = [t for t in turns[a:b] if t is not None]
            # copies of a row follow each other, and no role may follow itself
            illegal = int(copies[a:b].sum()) - (b - a) + sum(initials[i] + initials[i + 1] not in LEGAL for i in range(a, b - 1))
            row = {
                "conv_id": ids[a], "part": task | number, "whole": 0 < a and b < len(ids), "turns": len(set(known)),
                "low": known[0] if known else None, "high": known[-1] if known else None, "blank": int(copies[a:b][blank[a:b]].sum()),
                "duplicate": int(copies[a:b][~blank[a:b]].sum() - good[a:b].sum()), "truncated": int((good[a:b] & cut[a:b]).sum()), "illegal": illegal,
                "opens": initials[a], "closes": initials[b - 1], "cost": None, "audit": None, "spans": None,
            }
            word = "".join(symbols[a:b])
            if row["whole"]:
                row["cost"], row["audit"] = lightest(word)
            else:
                row["spans"] = [[{"state": s, "cost": c, "audit": x} for s, c, x in reached] for reached in span(word)]
            rows.append(row)
        yield _summaries(rows)


_KINDS = {
    "conv_id": pa.int64(), "part": pa.int64(), "whole": pa.bool_(), "turns": pa.int64(), "low": pa.int64(), "high": pa.int64(), "blank": pa.int64(),
    "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "opens": pa.string(), "closes": pa.string(), "cost": pa.int64(),
    "audit": pa.string(), "spans": _SPANS,
}


def _summaries(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in _KINDS.items()], list(_KINDS))


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a conversation, which follow each other, as one whole."""
    row, tables = None, []

    def done() -> pa.RecordBatch:
        cost, audit = agenda(joined(tables), 0, goal=True, insert=False)
        return _summaries([row | {"whole": True, "cost": cost, "audit": audit, "spans": None}])

    for batch in batches:
        for i in range(len(batch)):
            new = {k: batch.column(k)[i].as_py() for k in _KINDS}
            table = tuple(tuple((x["state"], x["cost"], x["audit"]) for x in reached) for reached in new["spans"])
            if row is not None and new["conv_id"] == row["conv_id"]:
                for k in ("turns", "blank", "duplicate", "truncated", "illegal"):
                    row[k] += new[k]
                row["turns"] -= new["low"] is not None and new["low"] == row["high"]
                row["illegal"] += row["closes"] + new["opens"] not in LEGAL
                row["low"] = new["low"] if row["low"] is None else row["low"]
                row["high"] = row["high"] if new["high"] is None else new["high"]
                row["closes"] = new["closes"]
                tables = joined([*tables, table])
            else:
                if row is not None:
                    yield done()
                row, tables = new, [table]
    if row is not None:
        yield done()


def plan(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation of ``conv_id, turn, role, text``.

    Rows count by turn, those without one first; rows of one turn by role, then by
    a digest of their text. A row's first fault counts: blank (nothing but white
    space), duplicate (role and text occur before), truncated (its last other
    character is none of ``.!?``). ``illegal`` counts neighbours whose initials
    are not su, ua or au, ``gaps`` the turns missing between the least and the
    greatest (at most the largest long).

    ``audit`` has the initials of the cheapest edits, in order: Keep, Rerole,
    Delete, Insert; the ASCII-least of several. A null role or text is one blank,
    a role with another initial (or none) fits nowhere. Equal rows follow each other. Rows
    without an id are one conversation. An empty table gives none; other columns
    are ignored. A conversation's audit is one value, so it has less than 2^31 edits.
    """
    order = ["conv_id", "turn", "role", "same"]
    marked = _marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(marked.select("conv_id", "turn", "initial", "blank", "truncated", "copies", "first").mapInArrow(_deriving, STATS), "conversations")
    parts = found.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_joining, STATS)
    # the difference of two turns may be too large for a long
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.least(wide("high") - wide("low") + 1 - wide("turns"), F.lit(LONGEST).cast("decimal(20,0)")).cast("long")
    return found.where("whole").unionByName(parts).select(
        "conv_id", F.when(F.col("turns") > 0, gaps).otherwise(F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )


def _applying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "position", "turn", "role", "text", "edit"]
    conv, audit, at, state, position, out = None, "", 0, 0, 0, []

    def put() -> None:
        nonlocal at, state, position
        while audit[at : at + 1] == "I":
            state, at, position = PUT[state], at + 1, position + 1
            out.append((conv, position, None, ROLE[state], "", "I"))

    def rows() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        columns = zip(*out) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        out = []
        for doc, plan_, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "turn", "role", "text"))):
            if plan_ is not None:
                put()
                conv, audit, at, state, position = doc, plan_, 0, 0, 0
                continue
            put()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            state = AFTER[state, role[0]] if edit == "K" else PUT[state]
            position += 1
            out.append((conv, position, turn, role if edit == "K" else ROLE[state], text, edit))
        yield rows()
    out = []
    put()
    yield rows()


def apply(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, position, turn, role, text, edit``: the repaired rows, by the audits of ``plan`` for the same rows.

    Deleted rows are gone; inserted ones have no turn and an empty text. The rows of a
    conversation follow each other, in order, in one partition, through which they
    are streamed. Nulls, ties and empty tables as in ``plan``.
    """
    none = lambda kind: F.lit(None).cast(kind)
    heads = plans.select("conv_id", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("binary").alias("same"), "audit")
    order = [F.col("conv_id"), F.col("audit").isNull(), F.col("turn"), F.col("role"), F.col("same")]
    every = heads.unionByName(_spelled(rows).withColumn("audit", none("string"))).repartition("conv_id").sortWithinPartitions(*order)
    return every.select("conv_id", "audit", "turn", "role", "text").mapInArrow(
        _applying, "conv_id long, position long, turn long, role string, text string, edit string"
    )
