"""Conversation structure repair by a run-length min-plus program.

The turns of a conversation become symbols: the initial of the role and a fault. Edits
turn the sequence into one whose role initials read ``(s?(ua)+)?``: Keep costs 0, Rerole
(to user or assistant) 1, Delete 2, Insert (an empty user or assistant turn) 5, and a
truncated turn that is not deleted 5 more; blank and duplicate turns must be deleted. What
has been read of that pattern is one of four states, so a turn is a 4 x 4 matrix of least
costs, and turns compose by the min-plus product.

Equal consecutive symbols are collapsed to runs. The binary powers of a symbol's matrix are
cached, and a run advances by the powers that make up its length. Costs to go, carried from the
end, decide each edit: from every state each edit leads to one next state, so taking the
first edit in ASCII order that keeps to the least cost gives the least audit string. Choices
within a run are unrolled by the same powers, and blocks met before come from a cache.

Nothing is done per conversation in one task that could be large. All turns are sorted
across partitions and cut into pieces of at most ``PIECE_TURNS`` turns of one conversation. A piece gives its matrix; the
matrices of a conversation, one row each, give the costs to go at the end of its pieces;
pieces then tell where each state leads, which gives the state that each one starts in; and then each
piece is unrolled by itself. The turns' texts only meet the edits again by their number.

Order: by turn, nulls first, then role, then SHA-256 of the text. Nulls: a null role or text
is one blank, a null id is a conversation like any other. Repeated rows are turns each, of
which the second is a duplicate. Texts of any length are only looked at in Spark. Other columns are
dropped, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.llm.batches import map_batches, stream_batches
from logclew.session import stage

PIECE_TURNS = 32_768

# What the edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

INITIALS = "sua"
OTHER = len(INITIALS)
# A symbol is twice the initial's number, one more if truncated; or a turn that must go.
GONE = 2 * (OTHER + 1)
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# The state after an inserted or reroled turn, and after a kept one by the initial.
_FREELY = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = (
    {START: SYSTEM},
    {START: USER, SYSTEM: USER, ASSISTANT: USER},
    {USER: ASSISTANT},
    {},
)
_LEGAL = {(0, 1), (1, 2), (2, 1)}
# Costs to go after the last turn: nothing, or turns inserted to complete the pattern.
FINAL = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 40

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]
_UNIT: Matrix = tuple(tuple(0 if s == t else _FAR for t in STATES) for s in STATES)


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done to a turn, in ASCII order."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        initial, truncated = divmod(symbol, 2)
        more = truncated * TRUNCATED
        if state in _KEPT[initial]:
            found.append(("K", more, _KEPT[initial][state]))
        found.append(("R", REROLE + more, _FREELY[state]))
    return found


def times(a: Matrix, b: Matrix) -> Matrix:
    columns = tuple(zip(*b))
    return tuple(tuple(min(map(int.__add__, row, col)) for col in columns) for row in a)


def apply(matrix: Matrix, costs: Vector) -> Vector:
    return tuple(min(map(int.__add__, row, costs)) for row in matrix)


@lru_cache(maxsize=None)
def power(symbol: int, j: int) -> Matrix:
    """Least costs over 2^j turns of one symbol, with any inserts before each."""
    if j:
        return times(power(symbol, j - 1), power(symbol, j - 1))
    rows = []
    for state in STATES:
        row, spent = [_FAR] * len(STATES), 0
        for _ in STATES:
            for _, cost, after in _edits(symbol, state):
                row[after] = min(row[after], spent + cost)
            state, spent = _FREELY[state], spent + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def _bits(count: int) -> list[int]:
    return [j for j in range(count.bit_length()) if count >> j & 1]


def matrix_of(runs: list[tuple[int, int]]) -> Matrix:
    """Least costs over runs of (symbol, count)."""
    whole = _UNIT
    for symbol, count in runs:
        for j in _bits(count):
            whole = times(whole, power(symbol, j))
    return whole


def _one(symbol: int, after: Vector, state: int) -> tuple[tuple[str, ...], int]:
    now, letters = apply(power(symbol, 0), after), ""
    while True:
        insert = ("I", INSERT, _FREELY[state])
        for letter, cost, to in sorted([insert, *_edits(symbol, state)]):
            if cost + (now if letter == "I" else after)[to] == now[state]:
                break
        letters, state = letters + letter, to
        if letter != "I":
            return (letters,), state


def _block(symbol: int, j: int, after: Vector, state: int) -> tuple[tuple[str, ...], int]:
    """The edits of 2^j turns of one symbol, one text a turn, and the state they lead to."""
    if not j:
        return _one(symbol, after, state)
    middle = apply(power(symbol, j - 1), after)
    left, state = _cached(symbol, j - 1, _least_zero(middle), state)
    right, state = _cached(symbol, j - 1, after, state)
    return left + right, state


_small = lru_cache(maxsize=10_000)(_block)


def _cached(symbol: int, j: int, after: Vector, state: int) -> tuple[tuple[str, ...], int]:
    return (_small if j < 7 else _block)(symbol, j, after, state)


def _least_zero(costs: Vector) -> Vector:
    """Only differences decide; without the common part blocks are met again."""
    least = min(costs)
    return tuple(c - least for c in costs)


def unroll(runs: list[tuple[int, int]], after: Vector, state: int) -> tuple[list[str], int]:
    """The edits of each turn of ``runs``, and the state after them."""
    blocks = []
    for symbol, count in reversed(runs):
        for j in _bits(count):
            blocks.append((symbol, j, _least_zero(after)))
            after = apply(power(symbol, j), after)
    edits: list[str] = []
    for symbol, j, costs in reversed(blocks):
        some, state = _cached(symbol, j, costs, state)
        edits += some
    return edits, state


def closing(state: int) -> str:
    """Initials of the turns to insert after the last one."""
    return {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}[state]


def _inserted(state: int) -> str:
    return INITIALS[_FREELY[state] - 1]


def written(edits: list[str], runs: list[tuple[int, int]], state: int) -> tuple[list[str], list[str]]:
    """Per turn: initials of what is inserted before it; and k, d, u or a for the turn itself."""
    leads, owns, at = [], [], 0
    for symbol, count in runs:
        for letters in edits[at : at + count]:
            lead = ""
            for _ in range(len(letters) - 1):
                lead += _inserted(state)
                state = _FREELY[state]
            leads.append(lead)
            owns.append({"D": "d", "K": "k", "R": _inserted(state)}[letters[-1]])
            if letters[-1] != "D":
                state = _KEPT[symbol // 2][state] if letters[-1] == "K" else _FREELY[state]
        at += count
    return leads, owns


# --- the pieces -----------------------------------------------------------------------


def _initial(role: Column) -> Column:
    """Number of the role's initial."""
    first = F.substring(role, 1, 1)
    number = F.lit(OTHER)
    for n, letter in enumerate(INITIALS):
        number = F.when(first == letter, n).otherwise(number)
    return number.cast("int")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """The turns in order, numbered by ``seq`` (ascending, with gaps), with what is wrong in the text."""
    read = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumns(
        {
            "digest": F.sha2("text", 256),
            "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
            "cut": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
            "copy": F.monotonically_increasing_id(),
        }
    )
    # Not by the text itself: the bounds of the ranges are a sample that goes through the driver.
    by = ("conv_id", "turn", "role", "digest", "copy")
    ranged = read.repartitionByRange(*by).sortWithinPartitions(*by)
    return stage(ranged.drop("copy").withColumn("seq", F.monotonically_increasing_id()), "turns")


def marked_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, seq, turn, initial, fault`` of ordered turns; fault 0 to 3: none, blank, duplicate, truncated."""
    firsts = (
        turns.where(~F.col("blank"))
        .groupBy("conv_id", "role", "digest")
        .agg(F.min("seq").alias("seq"))
        .select("seq", F.lit(True).alias("first"))
    )
    fault = (
        F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    )
    narrow = turns.select("conv_id", "seq", "turn", "blank", "cut", _initial(F.col("role")).alias("initial"))
    return narrow.join(firsts, "seq", "left").select(
        "conv_id", "seq", "turn", "initial", fault.alias("fault")
    )


def _piece_schema(conv: T.StructField) -> T.StructType:
    longs = T.ArrayType(T.LongType(), False)
    return T.StructType(
        [
            conv,
            T.StructField("piece", T.LongType(), False),
            T.StructField("matrix", longs),
            T.StructField("first", T.IntegerType()),
            T.StructField("last", T.IntegerType()),
            T.StructField("illegal", T.LongType()),
            T.StructField("symbols", T.ArrayType(T.IntegerType(), False)),
            T.StructField("counts", T.ArrayType(T.IntegerType(), False)),
            T.StructField("seqs", longs),
        ]
    )


def _conv_field(df: DataFrame) -> T.StructField:
    return T.StructField("conv_id", df.schema["conv_id"].dataType, True)


def _arrow(rows: list[tuple], names: list[str], schema: pa.Schema | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    types = schema.types if schema else [None] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def pieces_of(marked: DataFrame) -> DataFrame:
    """The pieces of all conversations; ``piece`` is the number of the first turn."""
    schema = _piece_schema(_conv_field(marked))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        conv, seqs, initials, symbols = None, [], [], []

        def piece() -> tuple:
            runs: list[list[int]] = []
            for s in symbols:
                if runs and runs[-1][0] == s:
                    runs[-1][1] += 1
                else:
                    runs.append([s, 1])
            illegal = sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))
            matrix = [c for row in matrix_of(runs) for c in row]
            return (conv, seqs[0], matrix, initials[0], initials[-1], illegal,
                    [s for s, _ in runs], [n for _, n in runs], list(seqs))

        for batch in batches:
            done = []
            types = types or _types(batch.schema.field(0).type, schema)
            for c, seq, initial, fault in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if seqs and (c != conv or len(seqs) == PIECE_TURNS):
                    done.append(piece())
                    seqs, initials, symbols = [], [], []
                conv = c
                seqs.append(seq)
                initials.append(initial)
                symbols.append(GONE if fault in (1, 2) else 2 * initial + (fault == 3))
            if done:
                yield _arrow(done, schema.names, types)
        if seqs:
            yield _arrow([piece()], schema.names, types)

    rows = marked.select("conv_id", "seq", "initial", "fault")
    ranged = rows.repartitionByRange("seq").sortWithinPartitions("seq")
    return stream_batches(ranged, cut, schema)


def _types(conv: pa.DataType, schema: T.StructType) -> pa.Schema:
    """The Arrow types of a result whose first column is the conversation's id."""
    plain = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}

    def of(kind: T.DataType) -> pa.DataType:
        if isinstance(kind, T.ArrayType):
            return pa.list_(of(kind.elementType))
        if isinstance(kind, T.StructType):
            return pa.struct([pa.field(f.name, of(f.dataType)) for f in kind.fields])
        return plain[kind.typeName()]

    return pa.schema([("conv_id", conv), *[(f.name, of(f.dataType)) for f in schema.fields[1:]]])


def _square(flat: list[int]) -> Matrix:
    return tuple(tuple(flat[4 * s : 4 * s + 4]) for s in STATES)


_ENDS = T.ArrayType(
    T.StructType([T.StructField("piece", T.LongType()), T.StructField("after", T.ArrayType(T.LongType()))])
)
_STARTS = T.ArrayType(
    T.StructType([T.StructField("piece", T.LongType()), T.StructField("state", T.IntegerType())])
)


def _in_order(pieces: DataFrame, *columns: str) -> DataFrame:
    """``conv_id, parts``: the named small columns of a conversation's pieces, in order."""
    return pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("piece", *columns))).alias("parts")
    )


def costs_to_go(pieces: DataFrame) -> DataFrame:
    """``conv_id, cost, illegal, ends``: least cost, illegal neighbours, and costs to go after each piece."""
    schema = T.StructType(
        [
            _conv_field(pieces),
            T.StructField("cost", T.LongType()),
            T.StructField("illegal", T.LongType()),
            T.StructField("ends", _ENDS),
        ]
    )

    def chain(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            costs, ends = FINAL, []
            for p in reversed(parts):
                ends.append({"piece": p["piece"], "after": list(costs)})
                costs = apply(_square(p["matrix"]), costs)
            seams = sum((a["last"], b["first"]) not in _LEGAL for a, b in zip(parts, parts[1:]))
            rows.append((conv, costs[START], seams + sum(p["illegal"] for p in parts), ends[::-1]))
        return _arrow(rows, schema.names, _types(batch.schema.field(0).type, schema))

    return map_batches(_in_order(pieces, "matrix", "first", "last", "illegal"), chain, schema)


def start_states(pieces: DataFrame, ends: DataFrame) -> DataFrame:
    """``piece, state``: where each piece of a conversation of several starts.

    ``ends`` are ``piece, after`` of those pieces.
    """
    conv = _conv_field(pieces)
    led = T.StructType(
        [conv, T.StructField("piece", T.LongType()), T.StructField("to", T.ArrayType(T.IntegerType()))]
    )

    def lead(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for c, piece, symbols, counts, after in zip(*(batch.column(i).to_pylist() for i in range(5))):
            runs = list(zip(symbols, counts))
            rows.append((c, piece, [unroll(runs, tuple(after), s)[1] for s in STATES]))
        return _arrow(rows, led.names, _types(batch.schema.field(0).type, led))

    states = T.StructType([conv, T.StructField("starts", _STARTS)])

    def follow(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for c, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            state, starts = START, []
            for p in parts:
                starts.append({"piece": p["piece"], "state": state})
                state = p["to"][state]
            rows.append((c, starts))
        return _arrow(rows, states.names, _types(batch.schema.field(0).type, states))

    some = pieces.join(ends, "piece").select("conv_id", "piece", "symbols", "counts", "after")
    leading = map_batches(some, lead, led)
    return map_batches(_in_order(leading, "to"), follow, states).select(F.inline("starts"))


def edits_of(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, piece, audit, turns`` with ``seq, lead, own, tail`` of each turn of a piece.

    ``plan`` gives ``piece, after, state, is_last``.
    """
    turn = T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("lead", T.StringType()),
            T.StructField("own", T.StringType()),
            T.StructField("tail", T.StringType()),
        ]
    )
    schema = T.StructType(
        [
            _conv_field(pieces),
            T.StructField("piece", T.LongType()),
            T.StructField("audit", T.StringType()),
            T.StructField("turns", T.ArrayType(turn)),
        ]
    )

    def choose(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for c, piece, symbols, counts, seqs, after, state, is_last in zip(
            *(batch.column(i).to_pylist() for i in range(8))
        ):
            runs = list(zip(symbols, counts))
            edits, to = unroll(runs, tuple(after), state)
            leads, owns = written(edits, runs, state)
            tails = [""] * len(seqs)
            tails[-1] = closing(to) if is_last else ""
            turns = [
                {"seq": s, "lead": lead, "own": own, "tail": tail}
                for s, lead, own, tail in zip(seqs, leads, owns, tails)
            ]
            rows.append((c, piece, "".join(edits) + "I" * len(tails[-1]), turns))
        return _arrow(rows, schema.names, _types(batch.schema.field(0).type, schema))

    some = pieces.join(plan, "piece").select(
        "conv_id", "piece", "symbols", "counts", "seqs", "after", "state", "is_last"
    )
    return map_batches(some, choose, schema)


@dataclass(frozen=True)
class Repair:
    """What is wrong with conversations, and the cheapest edits that mend them."""

    turns: DataFrame  # ordered_turns
    marked: DataFrame
    costs: DataFrame
    edits: DataFrame

    @cached_property
    def conversations(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of conversations with turns."""
        count = lambda fault: F.count_if(F.col("fault") == fault).cast("long")
        gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        facts = self.marked.groupBy("conv_id").agg(
            F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
            count(1).alias("blank"),
            count(2).alias("duplicate"),
            count(3).alias("truncated"),
        )
        parts = F.array_sort(F.collect_list(F.struct("piece", "audit")))
        audits = self.edits.groupBy("conv_id").agg(
            F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit")
        )
        return merged(
            [facts, self.costs.select("conv_id", "cost", "illegal"), audits],
            ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"),
        )

    @cached_property
    def repaired(self) -> DataFrame:
        """``conv_id, seq, pos, role, text``: the turns as mended, in order of seq and pos."""
        made = lambda initials: F.transform(
            F.filter(F.split(initials, ""), lambda c: c != ""),
            lambda c: F.struct(_role(c).alias("role"), F.lit("").alias("text")),
        )
        role = F.when(F.col("own") == "k", F.col("role")).otherwise(_role(F.col("own")))
        own = F.array(F.struct(role.alias("role"), F.col("text").alias("text")))
        lines = F.concat(made(F.col("lead")), F.filter(own, lambda _: F.col("own") != "d"), made(F.col("tail")))
        edits = self.edits.select(F.inline("turns"))
        joined = self.turns.select("conv_id", "seq", "role", "text").join(edits, "seq")
        return joined.select("conv_id", "seq", F.posexplode(lines).alias("pos", "line")).select(
            "conv_id", "seq", "pos", "line.role", "line.text"
        )


def _role(initial: Column) -> Column:
    return F.when(initial == "u", "user").otherwise("assistant")


def merged(tables: list[DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """One row per ``conv_id`` of tables with one row each; a null id is a group of its own."""
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table, allowMissingColumns=True)
    return every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in columns])


def repair_conversations(turns: DataFrame) -> Repair:
    """Find the faults of ``conv_id, turn, role, text`` rows and the cheapest repair of each conversation."""
    ordered = ordered_turns(turns)
    marked = stage(marked_turns(ordered), "marked-turns")
    pieces = stage(pieces_of(marked), "repair-pieces")
    costs = stage(costs_to_go(pieces), "repair-costs")
    several = F.size("ends") > 1
    ends = costs.where(several).select(F.inline("ends"))
    starts = stage(start_states(pieces, ends), "repair-starts")
    last = F.element_at("ends", -1)["piece"].alias("last")
    plan = (
        costs.select(last, F.inline("ends"))
        .join(starts, "piece", "left")
        .select("piece", "after", F.coalesce("state", F.lit(START)).alias("state"), (F.col("piece") == F.col("last")).alias("is_last"))
    )
    return Repair(ordered, marked, costs, stage(edits_of(pieces, plan), "repair-edits"))


def text_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, digest``: SHA-256 of the ``role:text`` lines of ``repaired`` turns.

    A hash over a whole conversation is sequential: its turns are read in order by one task, which
    holds one batch and no conversation.
    """
    schema = T.StructType([_conv_field(turns), T.StructField("digest", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, types = None, None, None
        for batch in batches:
            done = []
            types = types or _types(batch.schema.field(0).type, schema)
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or c != conv:
                    if state:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if done:
                yield _arrow(done, schema.names, types)
        if state:
            yield _arrow([(conv, state.hexdigest())], schema.names, types)

    lines = turns.select("conv_id", "seq", "pos", F.concat("role", F.lit(":"), "text").alias("line"))
    by_conversation = lines.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "pos")
    return stream_batches(by_conversation.select("conv_id", "line"), read, schema)
