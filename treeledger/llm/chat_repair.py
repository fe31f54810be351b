"""Cheapest repairs of conversations, as lightest derivations found by Knuth's agenda.

Items are pairs of a place among a conversation's rows and a state of the grammar ``(s?(ua)+)?`` over role initials. A
deduction keeps, re-roles or deletes the next row, or inserts a turn; it adds a cost and a letter (K, R, D, I) to the
audit. Pairs (cost, audit) only grow along a deduction, and of two audits of one item and cost none begins with the
other (it would hold inserts more, which cost), so the functions are monotone and superior: the agenda pops an item at
its least pair, and stops once the goal has been popped. The grammar leaves no choice of a role, so an audit stands for
one repair.

Long conversations are cut into blocks. A block's items give a table of least pairs from each state to each state, and
tables follow one another by deductions of two antecedents (what leads to a state, what leads on from it).

On Spark: rows are dealt by range of conversation and turn, so that a long conversation spreads over tasks. A task works
out the conversations that lie in it whole. Of those at its edges, or too long to hold, it gives the tables of their
blocks; these, and then the rows in order, go through one stream a conversation, which holds the tables' running result
(the audit, which is part of the answer) and a running hash, but no rows. Where role and text were seen earlier is told by
a grouping that sums up in each task first.

Cases: null conv_id and turn are values of their own (nulls first), and a null role or text is one space; rows that tie on
turn are ordered by role, then text; repeated rows are duplicates of each other; a role without text has no initial and
can't be kept; a conversation of which no row is left has zeros, an empty audit and the hash of the empty text; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from treeledger.llm.common import _slices, few, materialize, row_key, scratch

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. state -> {initial: next state}
START, GOALS = 0, (0, 3)
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}
#: Rows of a block, and the rows and characters of a conversation that a task holds.
BLOCK, HELD_ROWS, HELD_CHARS = 256, 4096, 4_000_000
#: Shapes of conversations that a task remembers.
SHAPES = 50_000
_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
_LEGAL = {"su", "ua", "au"}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "part int, block int, first string, last string, low long, high long, turns long, table string"

Pair = tuple[int, str]


def lightest(axioms: dict, deduce: Callable[[object], Iterable[tuple[object, int, str]]], goals: set, one: bool) -> dict:
    """Least (cost, audit) of items, by an agenda of all that the popped items lead to. Ends when a goal (one) or every
    goal has been popped, or nothing is left."""
    agenda = [(cost, audit, item) for item, (cost, audit) in axioms.items()]
    heapq.heapify(agenda)
    chart: dict = {}
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = (cost, audit)
        if item in goals and (one or goals <= chart.keys()):
            break
        for to, c, a in deduce(item):
            if to not in chart:
                heapq.heappush(agenda, (cost + c, audit + a, to))
    return chart


def _moves() -> dict:
    """By letter of a row and state: (state, cost, letter of the edit). Rows: s u a x, upper case where truncated, - where
    they must go."""
    out = {}
    for row in "suaxSUAX-":
        for state, on in enumerate(GRAMMAR):
            found = [(state, DELETE, "D")]
            if row != "-":
                more = TRUNCATED if row.isupper() else 0
                if row.lower() in on:
                    found.append((on[row.lower()], more, "K"))
                found += [(to, more + REROLE, "R") for name, to in on.items() if name in NAMES]
            out[row, state] = found
    return out


_MOVES = _moves()
_INSERTS = [[(to, INSERT, "I") for name, to in on.items() if name in NAMES] for on in GRAMMAR]


def _deduce(shape: str):
    n = len(shape)

    def deduce(item: tuple[int, int]) -> list:
        i, state = item
        found = [((i, to), c, a) for to, c, a in _INSERTS[state]]
        if i < n:
            found += [((i + 1, to), c, a) for to, c, a in _MOVES[shape[i], state]]
        return found

    return deduce


def block_table(shape: str, starts: Iterable[int] = range(4)) -> dict[tuple[int, int], Pair]:
    """Least pairs of a block, from each of the starts to each state that it can lead to."""
    n, out = len(shape), {}
    for p in starts:
        ends = {2, 3} | ({p} if p < 2 else set()) | ({1} if p == START and ("s" in shape or "S" in shape) else set())
        chart = lightest({(0, p): (0, "")}, _deduce(shape), {(n, q) for q in ends}, False)
        out |= {(p, q): chart[n, q] for q in ends}
    return out


class Chain:
    """Least pairs from the start through blocks. What all states' audits begin with is put away, so that a step handles
    only what they differ in."""

    def __init__(self):
        self.done: list[str] = []
        self.at: dict[int, Pair] = {START: (0, "")}

    def add(self, table: dict[tuple[int, int], Pair]) -> None:
        to: dict[int, Pair] = {}
        for (p, q), (cost, audit) in table.items():
            if p in self.at:
                pair = (self.at[p][0] + cost, self.at[p][1] + audit)
                if q not in to or pair < to[q]:
                    to[q] = pair
        shared = len(os.path.commonprefix([a for _, a in to.values()]))
        if shared:
            self.done.append(next(iter(to.values()))[1][:shared])
        self.at = {q: (c, a[shared:]) for q, (c, a) in to.items()}

    def goal(self) -> Pair:
        cost, rest = min(self.at[q] for q in GOALS if q in self.at)
        return cost, "".join(self.done) + rest


class Solver:
    """The cheapest repair of a conversation's shape; short shapes are remembered."""

    def __init__(self):
        self.known: dict[str, Pair] = {}

    def __call__(self, shape: str) -> Pair:
        if shape in self.known:
            return self.known[shape]
        if len(shape) <= BLOCK:
            n = len(shape)
            goals = {(n, q) for q in GOALS}
            chart = lightest({(0, START): (0, "")}, _deduce(shape), goals, True)
            found = min(chart[g] for g in goals if g in chart)
        else:
            chain = Chain()
            for i in range(0, len(shape), BLOCK):
                chain.add(block_table(shape[i : i + BLOCK], sorted(chain.at)))
            found = chain.goal()
        if len(shape) <= 64:
            if len(self.known) >= SHAPES:
                self.known = {}
            self.known[shape] = found
        return found


def repaired(audit: Iterator[str], rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """role, text of the repaired rows, given the edits and the rows; stops with the rows, so that inserts at the end are
    told by a last call without rows."""
    state = START
    rows = iter(rows)
    for edit in audit:
        if edit == "I":
            name = next(n for n in GRAMMAR[state] if n in NAMES)
            state = GRAMMAR[state][name]
            yield NAMES[name], ""
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        name = role[:1] if edit == "K" else next(n for n in GRAMMAR[state] if n in NAMES)
        state = GRAMMAR[state][name]
        yield (role if edit == "K" else NAMES[name]), text


def _digest(turns: Iterable[tuple[str, str]]) -> str:
    h, first = hashlib.sha256(), True
    for role, text in turns:
        h.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False
    return h.hexdigest()


class Stretch:
    """Counts of rows of one conversation in order, and their shape."""

    def __init__(self):
        self.shape: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        initial = role[:1]
        solid = text.rstrip(_BLANK)
        if not solid:
            self.blank += 1
            letter = "-"
        elif again:
            self.duplicate += 1
            letter = "-"
        else:
            letter = initial if initial in ("s", "u", "a") else "x"
            if solid[-1] not in ".!?":
                self.truncated += 1
                letter = letter.upper()
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.shape.append(letter)
        self.rows.append((role, text))
        self.chars += len(text)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _write_table(table: dict[tuple[int, int], Pair]) -> str:
    return ";".join(f"{p},{q},{c},{a}" for (p, q), (c, a) in table.items())


def _read_table(text: str) -> dict[tuple[int, int], Pair]:
    return {(int(p), int(q)): (int(c), a) for p, q, c, a in (x.split(",") for x in text.split(";"))}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for part in _slices(b):
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _first_pass(schema: pa.Schema):
    """Rows in order to results of whole conversations and pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve, part, out = Solver(), TaskContext.get().partitionId(), []
        held = conv = before = None
        block, edge, begun = 0, True, False

        def piece() -> tuple:
            table: dict = {}
            for i in range(0, len(held.shape), BLOCK):
                own = block_table("".join(held.shape[i : i + BLOCK]))
                table = _product(table, own) if table else own
            table = table or block_table("")
            counts = (None, held.blank, held.duplicate, held.truncated, held.illegal, None, None, None)
            return (conv, *counts, part, block, held.first, held.last, held.low, held.high, held.turns, _write_table(table))

        def whole() -> tuple:
            cost, audit = solve("".join(held.shape))
            digest = _digest(repaired(iter(audit), held.rows))
            counts = (held.gaps(), held.blank, held.duplicate, held.truncated, held.illegal, cost, audit, digest)
            return (conv, *counts, *[None] * 8)

        for c, turn, role, text, gone, late in _rows_of(batches):
            if not begun or c != conv:
                if begun:
                    out.append(piece() if edge or block else whole())
                    edge = False
                held, conv, before, block, begun = Stretch(), c, None, 0, True
            if not gone:
                own = (turn, role, text)
                held.add(turn, role, text, late or own == before)
                before = own
            if len(held.rows) >= HELD_ROWS or held.chars >= HELD_CHARS:
                out.append(piece())
                held, block = Stretch(), block + 1
            if len(out) >= 1000 or block and out:
                yield _batch(out, schema)
                out = []
        if begun:
            out.append(piece())  # it may go on in the next part
        if out:
            yield _batch(out, schema)

    return run


def _product(a: dict[tuple[int, int], Pair], b: dict[tuple[int, int], Pair]) -> dict[tuple[int, int], Pair]:
    out: dict = {}
    for (p, q), (c, x) in a.items():
        for (q2, r), (d, y) in b.items():
            if q == q2 and ((p, r) not in out or (c + d, x + y) < out[p, r]):
                out[p, r] = (c + d, x + y)
    return out


def _second_pass(schema: pa.Schema):
    """Pieces, then rows, of one conversation after the other to results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations():
            """Each conversation's id and an iterator of its rows, to be used up before the next."""
            rows = _rows_of(batches)
            ahead = [next(rows, None)]

            def own(c):
                while ahead[0] is not None and ahead[0][0] == c:
                    row, ahead[0] = ahead[0], None
                    yield row
                    ahead[0] = next(rows, None)

            while ahead[0] is not None:
                c = ahead[0][0]
                yield c, own(c)

        for c, rows in conversations():
            chain, counts = Chain(), [0, 0, 0, 0]
            low = high = last = None
            turns, started = 0, False
            said: list = [None]

            def texts(rows=rows, said=said):
                if said[0] is not None:
                    yield said[0]
                for r in rows:
                    yield (r[-2], r[-1])

            for r in rows:
                kind, blank, duplicate, truncated, illegal, first, end, lo, hi, n, table, role, text = r[1:]
                if kind:
                    said[0] = (role, text)
                    break
                if not started:
                    started = True
                counts = [x + y for x, y in zip(counts, (blank, duplicate, truncated, illegal), strict=True)]
                if first is not None:
                    counts[3] += last is not None and last + first not in _LEGAL
                    last = end
                if lo is not None:
                    turns += n - (hi is not None and high == lo)
                    low = lo if low is None else low
                    high = hi
                chain.add(_read_table(table))
            cost, audit = chain.goal()
            turned = repaired(iter(audit), texts())
            digest = _digest(turned)
            for _ in rows:  # none is left, unless the audit is broken
                raise ValueError("rows are left after the audit")
            gaps = 0 if low is None else high - low + 1 - turns
            yield _batch([(c, gaps, *counts, cost, audit, digest)], schema)

    return run


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: some rows dropped (gone), emptied, without stops, repeated or given to the user, by
    a hash of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(code == 4, "user").otherwise(space("role"))
    twice = F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (code == 0).alias("gone"), twice.alias("_twice"))
    return out.select("conv_id", "turn", "role", "text", "gone", F.explode("_twice")).drop("col")


def _before(turn: Column) -> Column:
    """turn as something to compare, nulls first."""
    return F.struct(turn.isNotNull().alias("given"), F.coalesce(turn, F.lit(0)).alias("turn"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows
    (conv_id, turn, role, text and, for rows that only name their conversation, gone)."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), gone.alias("gone"))
    rows = rows.withColumn("text", F.when(F.col("gone"), "").otherwise(F.col("text")))
    key_type = rows.schema["conv_id"].dataType.simpleString()
    with scratch(rows.sparkSession):
        seen = rows.where(~F.col("gone")).select("conv_id", row_key(F.col("role"), F.col("text")).alias("key"), _before(F.col("turn")).alias("at"))
        seen = seen.groupBy("conv_id", "key").agg(F.min("at").alias("at"), F.max("at").alias("to")).where("to > at")
        seen = materialize(seen.select(F.col("conv_id").alias("_c"), F.col("key").alias("_k"), F.col("at").alias("_at")), "chat-seen")
        on = F.col("conv_id").eqNullSafe(F.col("_c")) & (row_key(F.col("role"), F.col("text")) == F.col("_k"))
        flagged = rows.join(F.broadcast(seen) if few(seen) else seen, on, "left")
        late = F.coalesce(_before(F.col("turn")) > F.col("_at"), F.lit(False))
        flagged = flagged.select(*rows.columns, late.alias("late"))
        order = ["conv_id", "turn", "role", "text"]
        # a row and those that sort with it up to here are in one part, so that parts follow in order
        dealt = flagged.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*order)
        schema = f"conv_id {key_type}, {RESULT}, {_PIECE}"
        found = dealt.mapInArrow(_first_pass(to_arrow_schema(StructType.fromDDL(schema))), schema)
        found = materialize(found, "chat-found", keep=True)
        done = found.where("part is null").select("conv_id", *[c.split()[0] for c in RESULT.split(", ")])
        pieces = found.where("part is not null")
        split = materialize(pieces.select(F.col("conv_id").alias("_c")).distinct(), "chat-split", keep=True)
        mine = rows.join(F.broadcast(split) if few(split) else split, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").where(~F.col("gone"))
        each = ["blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "table"]
        none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in each]
        stream = pieces.select("conv_id", F.lit(0).alias("kind"), *each, F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.col("part").cast("long").alias("_a"), F.col("block").alias("_b"))
        stream = stream.unionByName(mine.select("conv_id", F.lit(1).alias("kind"), *none, "role", "text", F.col("turn").alias("_a"), F.lit(0).alias("_b")))
        stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "_a", "_b", "role", "text").drop("_a", "_b")
        schema = f"conv_id {key_type}, {RESULT}"
        rest = stream.mapInArrow(_second_pass(to_arrow_schema(StructType.fromDDL(schema))), schema)
    return done.unionByName(rest)
