"""Chat formatting: heterogeneous records become canonical turns by schema fingerprint.

A record is one JSON object. Its nested field paths (top-level names, and names inside
the elements of list fields), cut to the names that any mapping knows, are sorted and
hashed; the hash selects a declarative mapping that says where turns and their roles
are. Fields that no mapping knows, and those that are null, change nothing. Records
of an unknown layout, and text that is no JSON object, give no turns (``layout``
null in ``canonical_turns``).

Turns are written with marks around each. In texts and roles the control strings of
this and of other usual templates are escaped with a backslash and a letter, so that
no text can close its turn; ``unescape`` gives back exactly what was there. The loss
mask covers assistant texts: code-point spans of the formatted string.

Everything is DataFrame operations. Nulls: a null text or role is empty, a null id is an
id like any other. Ties: turns of equal number are ordered by role and text; repeated
rows are turns each. A conversation becomes one string, so one is limited by what a
string can hold (2 GB). Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Layout:
    """A mapping: the field paths that select it, and where the turns are.

    Either ``turns`` names a list field with ``role`` and ``text`` inside its elements,
    or ``fields`` gives (field, role) in the order of the turns. ``roles`` renames roles.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> list[str]:
        if self.turns:
            inside = (self.turns, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}")
            return sorted([*inside, *(f for f, _ in self.fields)])
        return sorted(f for f, _ in self.fields)


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout("messages", turns="messages", role="role", text="content"),
    Layout("shared", turns="conversations", role="from", text="value", roles=_SPEAKERS),
    Layout("shared_system", (("system", "system"),), "conversations", "from", "value", _SPEAKERS),
    Layout("completion", (("prompt", "user"), ("completion", "assistant"))),
    Layout("response", (("prompt", "user"), ("response", "assistant"))),
    Layout("system_response", (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout("question", (("question", "user"), ("answer", "assistant"))),
    Layout("instruction", (("instruction", "user"), ("output", "assistant"))),
    Layout("instruction_input", (("instruction", "system"), ("input", "user"), ("output", "assistant"))),
    Layout("prompt", (("prompt", "user"),)),
)


def path_hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def _elements(members: Column, layouts: Sequence[Layout]) -> dict[str, Column]:
    lists = dict.fromkeys(x.turns for x in layouts if x.turns)
    return {x: F.from_json(members[x], "array<map<string,string>>") for x in lists}


def _under(name: str):
    return lambda key: F.concat(F.lit(f"{name}[]."), key)


def fingerprint(members: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the known nested field paths of a record, given as its members' JSON."""
    known = sorted({p for x in layouts for p in x.paths})
    filled = F.map_keys(F.map_filter(members, lambda _, v: v.isNotNull()))
    paths = [filled]
    for name, elements in _elements(members, layouts).items():
        inside = F.flatten(F.transform(elements, lambda e: F.map_keys(e)))
        named = F.transform(inside, _under(name))
        paths.append(F.coalesce(named, F.array().cast("array<string>")))
    return path_hash(F.array_intersect(F.concat(*paths), F.array(*map(F.lit, known))))


def _turns(members: Column, layout: Layout) -> Column:
    def renamed(role: Column) -> Column:
        for old, new in layout.roles:
            role = F.when(role == old, new).otherwise(role)
        return F.coalesce(role, F.lit(""))

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    own = F.array(*[turn(F.lit(role), members[field]) for field, role in layout.fields])
    if not layout.turns:
        return own
    elements = F.from_json(members[layout.turns], "array<map<string,string>>")
    listed = F.transform(elements, lambda e: turn(renamed(e[layout.role]), e[layout.text]))
    return F.concat(own, listed) if layout.fields else listed


def canonical_turns(
    records: DataFrame, id_col: str, record_col: str, layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """(conv_id, layout, turns): the turns of each record in order, as role and text."""
    members = F.from_json(F.col(record_col).cast("string"), "map<string,string>")
    parsed = records.select(F.col(id_col).alias("conv_id"), members.alias("members"))
    parsed = parsed.withColumn("print", fingerprint(F.col("members"), layouts))
    layout = turns = None
    for x in layouts:
        chosen = F.col("print") == path_hash(F.array(*map(F.lit, x.paths)))
        found = _turns(F.col("members"), x)
        layout = F.when(chosen, x.name) if layout is None else layout.when(chosen, x.name)
        turns = F.when(chosen, found) if turns is None else turns.when(chosen, found)
    return parsed.select("conv_id", layout.alias("layout"), turns.alias("turns"))


def escape(text: Column, line_breaks: bool = False) -> Column:
    r"""Backslashes as ``\b``; the first character of a control string as ``\l`` for ``<``
    or ``\s`` for ``[``; with ``line_breaks`` also these, as ``\n``."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.regexp_replace(text, r"<(?=\||/?s>|<?/?SYS>)", r"\\l")
    text = F.regexp_replace(text, r"\[(?=/?INST\])", r"\\s")
    return F.replace(text, F.lit("\n"), F.lit("\\n")) if line_breaks else text


def unescape(text: Column) -> Column:
    for code, char in (("\\n", "\n"), ("\\l", "<"), ("\\s", "["), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the string of each record and its loss spans.

    ``turns`` comes from ``canonical_turns``. Offsets are running sums of lengths, so a
    record costs what it is long.
    """
    head = lambda t: F.concat(F.lit(START), escape(t["role"], True), F.lit("\n"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            head(t).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == ASSISTANT).alias("loss"),
        ),
    )
    cut = turns.select("conv_id", parts.alias("parts"))
    whole = F.array_join(
        F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""
    )
    lengths = F.transform(
        "parts",
        lambda p: F.struct(
            F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["loss"].alias("loss")
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda s, n: F.struct(
            (s["at"] + n["head"] + n["body"] + len(END)).alias("at"),
            F.when(
                n["loss"],
                F.concat(
                    s["spans"],
                    F.array(
                        F.struct(
                            (s["at"] + n["head"]).alias("start"),
                            (s["at"] + n["head"] + n["body"]).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return cut.select("conv_id", whole.alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    inner = lambda p: F.substr(p, F.lit(len(START) + 1))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(inner(p), "\n", 1)).alias("role"),
            unescape(F.substr(inner(p), F.instr(inner(p), F.lit("\n")) + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(
        F.transform(
            loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))
        ),
        "",
    )


def records_of(turns: DataFrame) -> DataFrame:
    """(conv_id, record): a table of turns as the JSON records that sources hand over.

    Each conversation takes the layout that its roles fit: question and answer, with or
    without a system turn, as plain fields; else a list of messages.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    listed = F.array_sort(F.collect_list(row))
    grouped = turns.groupBy("conv_id").agg(listed.alias("t"))
    roles = F.array_join(F.transform("t", lambda t: t["role"]), "\n")
    at = lambda i: F.col("t")[i]["text"]
    spoken = F.transform(
        "t", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value"))
    )
    said = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    record = (
        F.when(roles == "user\nassistant", F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when(
            roles == "system\nuser\nassistant",
            F.to_json(
                F.struct(at(0).alias("instruction"), at(1).alias("input"), at(2).alias("output"))
            ),
        )
        .when(roles == "user", F.to_json(F.struct(at(0).alias("prompt"))))
        .when(
            F.forall("t", lambda t: t["role"].isin("user", "assistant")),
            F.to_json(F.struct(spoken.alias("conversations"))),
        )
        .otherwise(F.to_json(F.struct(said.alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))
