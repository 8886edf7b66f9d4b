"""Repair of conversations at least cost, by weighted parsing of spans.

Turns of one conversation are put in order by turn (nulls first), then role, the first HEAD characters and the digest of
the text. Each turn is kept (cost 0), given the
role user or assistant (1) or deleted (2); empty turns of user or assistant are inserted (5). Blank turns and those whose role
and text stand earlier must be deleted; a turn that ends without a full stop, question or exclamation mark costs 5 more unless it
is deleted. The result's roles form nothing, or an optional system turn and then pairs of user and assistant.

The grammar is in Chomsky normal form. Its nonterminals are intervals of the language: (p, q) stands for every piece of a
conversation that leads from state p to state q of START, OPENED (system said), ASKED, ANSWERED, so its rules are
(p, q) -> (p, r) (r, q), and a single turn or an insertion at the leaves. A cell holds, for one span of turns and each
nonterminal, the least (cost, audit); audit spells the edits by initial (D, I, K, R), ties go to the lesser string. Leaves are
closed under insertion on both sides, and so are all products. Because every nonterminal splits at any place, each split of a
span gives the same cell. Hence one split per span is computed, and spans are combined bottom-up by length: 1, 2, 4, ... turns,
which takes the cubic table to a linear number of cells. Audits of equal cost and span are never prefixes of each other, so the
least audit of a span is made of least audits.

1. Turns that repeat turn, role and text collapse with a count before anything is sorted. Earlier turns of equal role and text
   come from a grouped minimum, joined back by unique keys. Only ids, roles, digests and the first HEAD characters take part.
2. Turns are sorted over all partitions, so that a very long conversation lies in many tasks. Each task combines the spans of
   its part of a conversation and returns one cell; the cells of a conversation that crosses partitions, one per task, are
   combined in order.
3. Edits go back to their turns by position; texts are shuffled once, to meet the edits that keep them.

A task holds the cells of a logarithm of its turns. The audit of a conversation is one value, by its nature.

Edge cases: null conv_id is a conversation of its own. A null role or text counts as one blank, so such turns are deleted or
given a role. Roles are told by their first letter. An empty conversation table gives an empty result. Extra columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pactscope.llm.common import cut

START, OPENED, ASKED, ANSWERED = range(4)
#: Where the initial of a turn that stays leads from each state.
STEPS = {"s": {START: OPENED}, "u": {START: ASKED, OPENED: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}}
INSERT, RENAME, DELETE, CUT_SHORT = 5, 1, 2, 5

#: Characters that separate words, and characters that end a sentence.
BLANKS, STOPS = " \t\n\x0b\f\r", ".!?"
#: Characters of a text that order turns of one number and role before their digests do.
HEAD = 64
#: Edits that one batch holds.
SCRIPT_ROWS = 1 << 16

Cell = dict[tuple[int, int], tuple[int, str]]


def product(left: Cell, right: Cell) -> Cell:
    """The cell of two spans that follow each other: the least of (p, r) and (r, q) over r."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            more = right.get((r, q))
            if more is not None:
                total = cost + more[0]
                best = out.get((p, q))
                if best is None or total <= best[0]:
                    one = (total, audit + more[1])
                    if best is None or one < best:
                        out[p, q] = one
    return out


def _insertions() -> Cell:
    """The cell of no turns: any number of insertions, shortest first."""
    nothing: Cell = {(p, p): (0, "") for p in range(4)}
    once: Cell = {(p, q): (INSERT, "I") for role in "ua" for p, q in STEPS[role].items()}
    cell = nothing
    while True:
        longer = product(cell, once)
        wider = {key: min(x for x in (cell.get(key), longer.get(key)) if x) for key in cell | longer}
        if wider == cell:
            return cell
        cell = wider


NO_TURNS = _insertions()


def leaf(initial: str, must_go: bool, cut_short: bool, copies: int) -> Cell:
    """The cell of one turn and of its further copies, which are deleted (d, told apart from turns of their own)."""
    rest, after = DELETE * (copies - 1), "d" * (copies - 1)
    cell: Cell = {(p, p): (DELETE + rest, "D" + after) for p in range(4)}
    if not must_go:
        more = rest + CUT_SHORT * cut_short
        for role, steps in STEPS.items():
            for p, q in steps.items():
                if role == initial:
                    cell[p, q] = (more, "K" + after)
                elif role != "s":
                    cell.setdefault((p, q), (RENAME + more, "R" + after))
    return product(product(NO_TURNS, cell), NO_TURNS)


_LEAVES: dict[tuple[str, bool, bool], Cell] = {}


def _leaf(initial: str, must_go: bool, cut_short: bool, copies: int) -> Cell:
    """The same, remembered for turns without copies."""
    if copies > 1:
        return leaf(initial, must_go, cut_short, copies)
    key = (initial if initial in STEPS else "", must_go, cut_short)
    if key not in _LEAVES:
        _LEAVES[key] = leaf(*key, 1)
    return _LEAVES[key]


def best(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(cell[p, q] for p, q in ((START, START), (START, ANSWERED)) if (p, q) in cell)


class Span:
    """A growing span: complete spans of falling length, as in a binary counter, and counts of what was seen."""

    def __init__(self, first: int):
        self.parts: list[tuple[int, Cell]] = []
        self.first, self.turns, self.places = first, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.numbers = 0
        self.least = self.most = None
        self.roles: tuple[str, str] | None = None

    def add(self, turn, role: str, fault: int, copies: int) -> None:
        initial = role[:1]
        self.parts.append((1, _leaf(initial, fault in (1, 2), fault == 3, copies)))
        while len(self.parts) > 1 and self.parts[-1][0] == self.parts[-2][0]:
            (n, right), (_, left) = self.parts.pop(), self.parts.pop()
            self.parts.append((2 * n, product(left, right)))
        self.places += 1
        self.turns += copies
        self.blank += copies if fault == 1 else 0
        self.duplicate += copies if fault == 2 else copies - 1 if fault != 1 else 0
        self.truncated += fault == 3
        self.illegal += (copies - 1) + (self.roles is not None and not _legal(self.roles[1], initial))
        self.roles = (self.roles[0] if self.roles else initial, initial)
        if turn is not None:
            self.numbers += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def cell(self) -> Cell:
        parts = [cell for _, cell in self.parts]
        whole = parts.pop()
        while parts:
            whole = product(parts.pop(), whole)
        return whole


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


_PAIRS = [(p, q) for p in range(4) for q in range(4)]
_COUNTS = ["turns", "blank", "duplicate", "truncated", "illegal", "numbers", "least", "most"]
_SPAN = (
    "first long, places long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", opens string, closes string, "
    "open boolean, costs array<long>, audits array<string>"
)


def _row(key, span: Span, edge: bool) -> tuple:
    """A span as a row. A conversation that may go on in another partition keeps its whole cell, others their best one."""
    counts = [getattr(span, c) for c in _COUNTS]
    if edge:
        cell = span.cell()
        held = [cell.get(pair) for pair in _PAIRS]
        costs, audits = [x and x[0] for x in held], [x and x[1] for x in held]
    else:
        cost, audit = best(span.cell())
        costs, audits = [cost], [audit]
    return (key, span.first, span.places, *counts, *span.roles, edge, costs, audits)


def _spans(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, span, edge, out = None, None, True, []
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("conv_id", "at", "turn", "role", "fault", "copies")), strict=True)
            for conv, at, turn, role, fault, copies in rows:
                if span is None or conv != key:
                    if span is not None:
                        out.append(_row(key, span, edge))
                        edge = False
                    key, span = conv, Span(at)
                span.add(turn, role, fault, copies)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                out = []
        if span is not None:
            row = _row(key, span, True)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

    return run


def _joined(schema: pa.Schema):
    """The parts of one conversation, one per task, as one row."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("first").to_pylist()
        cell, total = None, dict.fromkeys(_COUNTS, 0) | {"least": None, "most": None}
        before = None
        for row in rows:
            held = {pair: (c, a) for pair, c, a in zip(_PAIRS, row["costs"], row["audits"], strict=True) if c is not None}
            cell = held if cell is None else product(cell, held)
            for name in _COUNTS[:6]:
                total[name] += row[name]
            if before is not None:
                total["illegal"] += not _legal(before, row["opens"])
            before = row["closes"]
            if row["least"] is not None:
                total["numbers"] -= total["most"] == row["least"]
                total["least"] = row["least"] if total["least"] is None else total["least"]
                total["most"] = row["most"]
        cost, audit = best(cell)
        places = [{"first": r["first"], "places": r["places"]} for r in rows]
        out = {"conv_id": rows[0]["conv_id"], **total, "cost": cost, "audit": audit, "parts": places}
        return pa.Table.from_pylist([out], schema=schema)

    return run


def _arrow(kind: pa.DataType, whole: bool) -> pa.Schema:
    counts = [(c, pa.int64()) for c in _COUNTS]
    if whole:
        place = pa.struct([("first", pa.int64()), ("places", pa.int64())])
        return pa.schema([("conv_id", kind), *counts, ("cost", pa.int64()), ("audit", pa.string()), ("parts", pa.list_(place))])
    return pa.schema([
        ("conv_id", kind), ("first", pa.int64()), ("places", pa.int64()), *counts, ("opens", pa.string()),
        ("closes", pa.string()), ("open", pa.bool_()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    ])


def _told(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and digest."""
    known = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    return known.withColumn("digest", F.unhex(F.sha2("text", 256)))


def ordered(turns: DataFrame) -> DataFrame:
    """Different turns in the order of their conversations, over all partitions (written out): conv_id, at (grows with the
    order), turn, role, digest, copies, fault (0 none, 1 blank, 2 duplicate, 3 cut short)."""
    told = _told(turns).withColumns({
        "head": F.substring("text", 1, HEAD),
        "ending": F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)),
    })
    keys = ["conv_id", "turn", "role", "head", "digest"]
    each = told.groupBy(*keys, "ending").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))
    first = each.groupBy("conv_id", "role", "digest").agg(F.min(order)["turn"].alias("turn"))
    first = first.select(*[F.col(c).alias(f"first_{c}") for c in ("conv_id", "turn", "role", "digest")])
    # Both sides have each key once, however often a conversation says the same.
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in ("conv_id", "turn", "role", "digest")])
    fault = (
        F.when(F.col("ending") == "", 1).when(F.col("first_digest").isNull(), 2)
        .when(~F.col("ending").isin(*STOPS), 3).otherwise(0)
    )
    judged = each.join(first, same, "left").select(*keys, "copies", fault.alias("fault"))
    sorted_ = judged.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(sorted_.select("conv_id", F.monotonically_increasing_id().alias("at"), "turn", "role", "digest", "copies", "fault"))


def repairs(turns: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, turns, blank, duplicate, truncated, illegal (neighbours), numbers (different turn
    numbers), least and most (of these), cost, audit, parts (where its rows stand in `ordered`).

    audit: the edits by initial, in order; d marks a further copy of the turn before it, deleted as well.
    """
    rows = ordered(turns) if rows is None else rows
    kind = turns.schema["conv_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    spans = cut(rows.mapInArrow(_spans(_arrow(arrow, whole=False)), f"conv_id {name}, {_SPAN}"))
    place = F.array(F.struct("first", "places")).alias("parts")
    alone = spans.filter("not open").select("conv_id", *_COUNTS, F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), place)
    whole = f"conv_id {name}, {', '.join(f'{c} long' for c in _COUNTS)}, cost long, audit string, parts array<struct<first: long, places: long>>"
    across = spans.filter("open").groupBy("conv_id").applyInArrow(_joined(_arrow(arrow, whole=True)), whole)
    return alone.unionByName(across)


def _script(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that a repaired conversation has: place in `ordered` (null: inserted), number in the result, role (null: its own)."""
    names = ["conv_id", "at", "number", "role"]
    for batch in batches:
        held, out = 0, [[], [], [], []]
        for conv, audit, parts in zip(batch["conv_id"], batch["audit"].to_pylist(), batch["parts"].to_pylist(), strict=True):
            edits = np.frombuffer(audit.encode(), np.uint8)
            edits = edits[edits != ord("d")]
            inserted = edits == ord("I")
            first = np.cumsum([0, *(p["places"] for p in parts)])
            row = np.cumsum(~inserted) - 1
            part = np.clip(np.searchsorted(first, row, side="right") - 1, 0, len(parts) - 1)
            at = np.array([p["first"] for p in parts])[part] + row - first[part]
            stays = edits != ord("D")
            number = np.cumsum(stays) - 1
            # With a system turn in front the number of turns is odd, and users come at odd places.
            user = number % 2 == stays.sum() % 2
            role = np.where(edits == ord("K"), None, np.where(user, "user", "assistant"))
            out[0].extend([conv.as_py()] * int(stays.sum()))
            out[1].append(np.where(inserted, -1, at)[stays])
            out[2].append(number[stays])
            out[3].append(role[stays])
            held += int(stays.sum())
            if held > SCRIPT_ROWS:
                yield _script_batch(batch.schema.field("conv_id").type, out, names)
                held, out = 0, [[], [], [], []]
        if held:
            yield _script_batch(batch.schema.field("conv_id").type, out, names)


def _script_batch(kind: pa.DataType, out: list, names: list[str]) -> pa.RecordBatch:
    at, number, role = (np.concatenate(c) for c in out[1:])
    columns = [pa.array(out[0], kind), pa.array(at, mask=at < 0), pa.array(number), pa.array(role, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repairs (see there), and the repaired conversations: conv_id, number (from 0), role, text, inserted."""
    rows = ordered(turns)
    found = cut(repairs(turns, rows))
    kind = turns.schema["conv_id"].dataType.simpleString()
    script = found.select("conv_id", "audit", "parts").mapInArrow(_script, f"conv_id {kind}, at long, number long, role string")
    script = cut(script)
    new = script.filter("at is null").select("conv_id", "number", "role", F.lit("").alias("text"), F.lit(True).alias("inserted"))
    keys = ["conv_id", "turn", "role", "digest"]
    stays = script.select("at", "number", F.col("role").alias("new_role"))
    places = rows.join(stays, "at").select(*[F.col(c).alias(f"k_{c}") for c in keys], "number", "new_role")
    texts = _told(turns).groupBy(*keys).agg(F.first("text").alias("text"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in keys])
    kept = texts.join(places, same).select(
        "conv_id", "number", F.coalesce("new_role", "role").alias("role"), "text", F.lit(False).alias("inserted"),
    )
    return found, kept.unionByName(new)
