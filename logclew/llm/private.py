r"""Personal data: fixed rules, and identifiers found by bootstrapped contexts.

The rules find e-mail addresses, IP addresses, payment cards and phone numbers. Their
matches are the seeds. Lexical patterns are the words around a place: the one before, the
two before, the one after, and those on both sides. Other tokens that look like an identifier
of some kind, loosely, are candidates, and so are groups of digits with blanks, brackets or
hyphens between them. Patterns and the values seen in them form a graph, which Spark scores
in rounds:

1. A pattern's confidence for a kind is the share of known values of that kind among all
   distinct values in its place, ordinary words included. It is used if it has
   ``min_support`` known values and ``min_confidence``.
2. A candidate value's score for a kind it looks like is the noisy-or of the
   confidences of its patterns. From ``min_score`` on it is known, in every text, and stays so.
3. The next round counts it among the known values, which can raise other patterns. The
   rounds end when one adds nothing (or after ``rounds``, if given).

Words in the place of a pattern are read in a second pass, and only for patterns that can be
used at all: the rounds are run without these words before, which makes every pattern at least as
confident. A bit table of fixed size drops nearly all other places in the task, a join the rest. Only hashes of values and contexts leave a text. Edges are distinct
pairs, so copies of a document add nothing. The rounds run on staged tables of edges; nothing
but the bit table is gathered on the driver. Spans found in a text are a function of it, so
they are joined back by its digest, and texts without candidates are not joined at all.

Everything is linear in a text's length: starts inside a run of digits or behind a failed
match are not tried again, and words are split once.

Nulls: a null text is empty and has no spans; a null id stays null. Repeated rows have
the same spans each. Ties between kinds go to the higher score, then the kind listed
first. Long texts are read whole. Other columns are ignored by ``find_private`` and kept by
``redact``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.llm.batches import free_name, id_field, map_batches, text_or_empty
from logclew.session import stage

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, kind number

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class Bootstrap:
    rounds: int | None = None
    min_support: int = 5
    min_confidence: float = 0.8
    min_score: float = 0.9


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @ the local part is read backwards, up to the last match."""
    found, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the rules by start, then kind."""
    spans: list[Span] = [(a, b, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                spans.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    spans.append((*m.span(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


# Tokens with a digit or an at-sign, and what each kind loosely looks like.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_EDGE = "\"'()[]{}<>,;:!?.=|"
_BLANKS = re.compile(r"[ \t ]{1,2}")
_LOOSE = (
    re.compile(r"[^\s@]+@[^\s@]+"),
    re.compile(r"[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}"),
    re.compile(r"(?:[0-9][./_ \t -]{0,2}){11,18}[0-9]"),
    re.compile(r"\+?\(?(?:[0-9][()./_ \t -]{0,3}){6,14}[0-9]"),
)
# More groups than the loosest kind has digits are never one identifier.
_MOST_GROUPS = 19


def looks_like(token: str) -> int:
    """Bits of the kinds that the token may be of."""
    return sum(1 << k for k, loose in enumerate(_LOOSE) if loose.fullmatch(token))


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its ends; a bracket that is closed inside stays."""
    token = text[start:end]
    start += len(token) - len(token.lstrip(_EDGE))
    token = token.strip(_EDGE)
    if start and text[start - 1] == "(" and 0 <= token.find(")") < (token + "(").find("("):
        return start - 1, start + len(token)
    return start, start + len(token)


def candidates(text: str, base: list[Span]) -> list[Span]:
    """(start, end, kind bits) outside the base spans of what looks like something.

    Tokens next to each other are read together if that looks like something; from the left,
    as many as can be.
    """
    if "@" not in text and not _DIGIT.search(text):
        return []
    chains: list[list[tuple[int, int]]] = []
    n = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while n < len(base) and base[n][1] <= start:
            n += 1
        if n < len(base) and base[n][0] < end:
            continue
        last = chains[-1][-1][1] if chains else -1
        near = 0 <= last < start and start - last <= 2 and _BLANKS.fullmatch(text, last, start)
        if near:
            chains[-1].append((start, end))
        else:
            chains.append([(start, end)])
    found = []
    for chain in chains:
        i = 0
        while i < len(chain):
            for j in range(min(len(chain), i + _MOST_GROUPS), i, -1):
                start, end = _trimmed(text, chain[i][0], chain[j - 1][1])
                if bits := looks_like(text[start:end]):
                    found.append((start, end, bits))
                    break
            i = max(j, i + 1)
    return found


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8")) - (1 << 63)


# Stands for a span among the words; no word has a blank.
_PLACE = "\0 "
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: list[str]) -> np.ndarray:
    return hash_array(np.array(words, dtype=object), categorize=False)


def word_sequence(text: str, spans: list[Span]) -> tuple[list[str], list[int]]:
    """Lower-cased words, with one place for each stretch of spans, and each span's place."""
    words, places, at = [], [], 0
    for start, end, _ in spans:
        if start >= at:
            words += text[at:start].lower().split()
            words.append(_PLACE)
        places.append(len(words) - 1)
        at = max(at, end)
    words += text[at:].lower().split()
    return words, places


def _mixed(hashes: np.ndarray, tag: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(tag)) * _MIX
    return (mixed ^ (mixed >> np.uint64(31))) * _MIX


def patterns(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(first place, pattern hashes from there on): before, two before, after, both sides."""
    before, after = hashes[:-1], hashes[1:]
    return [
        (1, _mixed(before, 1)),
        (2, _mixed(before[:-1] * _MIX + hashes[1:-1], 2)),
        (0, _mixed(after, 3)),
        (1, _mixed(hashes[:-2] * _MIX + hashes[2:], 4)),
    ]


def contexts(text: str, spans: list[Span]) -> list[list[int]]:
    """Hashed patterns around each span."""
    if not spans:
        return []
    words, places = word_sequence(text, spans)
    made = patterns(_word_hashes(words))
    return [
        [int(h[p - first].view(np.int64)) for first, h in made if first <= p < first + len(h)]
        for p in places
    ]


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])
_SEEN = pa.struct(
    [
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("kind", pa.int32()),
        ("bits", pa.int32()),
        ("value", pa.int64()),
        ("contexts", pa.list_(pa.int64())),
    ]
)
_SPANS_TYPE = "array<struct<start:int,end:int,kind:int>>"
_SEEN_TYPE = "array<struct<start:int,end:int,kind:int,bits:int,value:long,contexts:array<long>>>"


def _kind(sql: str) -> T.DataType:
    return T._parse_datatype_string(sql)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text digest, base spans, and everything seen with its contexts, per row."""
    schema = T.StructType(
        [
            id_field(docs, id_col),
            T.StructField("digest", T.StringType()),
            T.StructField("base", _kind(_SPANS_TYPE)),
            T.StructField("seen", _kind(_SEEN_TYPE)),
        ]
    )

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, bases, seens = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            loose = candidates(text, base)
            marked = sorted([(a, b, k, 0) for a, b, k in base] + [(a, b, -1, k) for a, b, k in loose])
            around = contexts(text, [m[:3] for m in marked])
            bases.append([dict(zip(("start", "end", "kind"), s, strict=True)) for s in base])
            seens.append(
                [
                    {
                        "start": a,
                        "end": b,
                        "kind": kind,
                        "bits": bits,
                        "value": _hash(text[a:b].lower()),
                        "contexts": near,
                    }
                    for (a, b, kind, bits), near in zip(marked, around, strict=True)
                ]
            )
            digests.append(hashlib.sha256(text.encode("utf-8")).hexdigest() if loose else None)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(digests, pa.string()),
                pa.array(bases, pa.list_(_SPAN)),
                pa.array(seens, pa.list_(_SEEN)),
            ],
            names=schema.names,
        )

    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), rows, schema)


def _has_bit(bits: Column, kind: Column) -> Column:
    return F.expr("(shiftright(bits, kind) & 1) = 1")


# Size of the bit table of patterns, in bits: bounded, whatever the corpus has.
_TABLE_BITS = 1 << 22


def _bit_table(patterns_: DataFrame) -> np.ndarray:
    """Marks of the patterns' low bits; at most ``_TABLE_BITS`` / 64 rows come to the driver."""
    low = F.col("context").bitwiseAND(F.lit(_TABLE_BITS - 1))
    words = (
        patterns_.select(F.shiftright(low, 6).alias("at"), low.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("at")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("marks"))
    )
    table = np.zeros(_TABLE_BITS // 64, np.int64)
    for at, marks in words.collect():
        table[at] = marks
    return table.view(np.uint64)


def words_in_place(docs: DataFrame, text_col: str, table: np.ndarray) -> DataFrame:
    """(context, value) of ordinary words in the place of a pattern that ``table`` marks."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.zeros((0, 2), np.uint64)]
        for text in batch.column(0).to_pylist():
            base = base_spans(text) if text else []
            spans = sorted(base + candidates(text or "", base))
            words, places = word_sequence(text or "", spans)
            hashes = _word_hashes(words)
            ordinary = np.ones(len(words), bool)
            ordinary[places] = False
            for first, h in patterns(hashes):
                low = h & np.uint64(_TABLE_BITS - 1)
                marked = (table[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)
                at = np.flatnonzero(marked.astype(bool) & ordinary[first : first + len(h)])
                if len(at):
                    found.append(np.stack([h[at], hashes[at + first]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        columns = [np.ascontiguousarray(pairs[:, i]).view(np.int64) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["context", "value"])

    return map_batches(
        docs.select(F.col(text_col).cast("string")), rows, "context long, value long"
    )


def score_graph(
    edges: DataFrame, settings: Bootstrap, docs: DataFrame | None = None, text_col: str = "text"
) -> DataFrame:
    """(value, kind) of the candidates that the rounds make known.

    ``edges``: distinct (context, value, kind, bits), kind -1 for candidates. The ordinary
    words in the place of a pattern are read from ``docs``, if given.
    """
    edges = stage(edges, "edges")
    shared = stage(
        edges.groupBy("context").agg(F.count_distinct("value").alias("n")).where(
            F.col("n") >= settings.min_support
        ),
        "contexts",
    )
    if docs is None:
        return _rounds(edges, shared, settings)
    # Without the ordinary words every pattern is at least as confident as with them. So what these
    # rounds do not use, and values they do not make known, the full count cannot bring in either.
    most = _rounds(edges, shared, settings, every_kind=True)
    if most is None or most.isEmpty():
        return most
    used = stage(_strong(edges, most, shared, settings).select("context").distinct(), "used")
    # Distinct pairs are dealt by both columns, so a pattern that all texts have is no hot key.
    words = words_in_place(docs, text_col, _bit_table(used)).join(used, "context", "left_semi")
    every = edges.join(used, "context", "left_semi").select("context", "value").unionByName(words)
    counted = every.distinct().groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    return _rounds(edges, stage(counted, "totals"), settings)


def _strong(
    edges: DataFrame, learnt: DataFrame | None, totals: DataFrame, settings: Bootstrap
) -> DataFrame:
    """(context, kind, k, n, confidence) of the patterns that are used, by the known values."""
    known = edges.where("kind >= 0").select("context", "value", "kind")
    if learnt is not None:
        loose = edges.where("kind < 0").select("context", "value")
        known = known.unionByName(loose.join(learnt, "value").select("context", "value", "kind"))
    return (
        known.groupBy("context", "kind")
        .agg(F.count_distinct("value").alias("k"))
        .where(F.col("k") >= settings.min_support)
        .join(totals, "context")
        .withColumn("confidence", F.col("k") / F.col("n"))
        .where(F.col("confidence") >= settings.min_confidence)
    )


def _rounds(
    edges: DataFrame, totals: DataFrame, settings: Bootstrap, every_kind: bool = False
) -> DataFrame | None:
    """(value, kind) of what becomes known if the patterns have ``totals`` values in their places.

    With ``every_kind`` a value is known as each kind it scores enough for, not as the best only.
    """
    loose = edges.where("kind < 0").select("context", "value", "bits")
    learnt: DataFrame | None = None
    done = 0
    while settings.rounds is None or done < settings.rounds:
        done += 1
        strong = _strong(edges, learnt, totals, settings)
        # 1 - confidence is bounded from below, as a logarithm is taken.
        doubt = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))
        new = loose.join(strong, "context").where(_has_bit(F.col("bits"), F.col("kind")))
        if learnt is not None:
            new = new.join(learnt, ["value", "kind"] if every_kind else "value", "left_anti")
        scored = (
            new.groupBy("value", "kind")
            .agg(F.round(1 - F.exp(F.sum(doubt)), 9).alias("score"))
            .where(F.col("score") >= settings.min_score)
        )
        best = scored.groupBy("value", *(["kind"] if every_kind else [])).agg(
            F.max(F.struct("score", (-F.col("kind")).alias("first"))).alias("best")
        )
        added = stage(best.select("value", (-F.col("best.first")).alias("kind")), "learnt")
        learnt = added if learnt is None else stage(learnt.unionByName(added), "known")
        if added.isEmpty():
            break
    return learnt


def bootstrapped(
    scanned: DataFrame, settings: Bootstrap, docs: DataFrame, text_col: str = "text"
) -> DataFrame:
    """(digest, added): the spans that the method adds to the text of that digest."""
    seen = scanned.select("digest", F.explode("seen").alias("s")).select("digest", "s.*")
    edges = seen.select(F.explode("contexts").alias("context"), "value", "kind", "bits").distinct()
    learnt = score_graph(edges, settings, docs, text_col)
    span = F.struct("start", "end", "kind")
    return (
        seen.where("kind < 0")
        .select("digest", "start", "end", "value")
        .distinct()
        .join(learnt, "value")
        .groupBy("digest")
        .agg(F.collect_list(span).alias("added"))
    )


def find_private(
    docs: DataFrame,
    settings: Bootstrap = Bootstrap(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, base, added): each row's spans by the rules and by the contexts, sorted."""
    scanned = stage(scan(docs, id_col, text_col), "scanned")
    added = stage(bootstrapped(scanned, settings, docs, text_col), "added")
    none = F.array().cast(_SPANS_TYPE)
    plain = scanned.where("digest IS NULL").select("doc_id", "base", none.alias("added"))
    joined = (
        scanned.where("digest IS NOT NULL")
        .join(added, "digest", "left")
        .select("doc_id", "base", F.coalesce("added", none).alias("added"))
    )
    order = lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")
    )
    return plain.unionByName(joined).select(
        "doc_id",
        F.array_sort(F.transform("base", order)).alias("base"),
        F.array_sort(F.transform("added", order)).alias("added"),
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(
        ":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string")
    )
    return F.array_join(F.transform(spans, one), ",")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span (overlapping ones as one, named by the first) as ``[KIND]``."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], s[2], s[1])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(
    docs: DataFrame,
    settings: Bootstrap = Bootstrap(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with personal data masked. Only texts with candidates are joined to spans."""
    scanned = stage(scan(docs, id_col, text_col), "scanned")
    added = stage(bootstrapped(scanned, settings, docs, text_col), "added")
    digest, extra = free_name(docs, "_digest"), free_name(docs, "_added")
    columns, at_text = docs.columns, docs.columns.index(text_col)

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = list(batch.columns[: len(columns)])
        more = batch.column(len(columns)).to_pylist() if batch.num_columns > len(columns) else None
        out = []
        for i, text in enumerate(arrays[at_text].to_pylist()):
            spans = base_spans(text) if text else []
            spans += [(s["start"], s["end"], s["kind"]) for s in (more and more[i]) or ()]
            out.append(masked(text, spans) if spans else text)
        arrays[at_text] = pa.array(out, arrays[at_text].type)
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    marks = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False))
    plain = map_batches(docs.where(~marks), mask, docs.schema)
    right = added.select(F.col("digest").alias(digest), F.col("added").alias(extra))
    joined = (
        docs.where(marks)
        .withColumn(digest, F.sha2(text_or_empty(text_col), 256))
        .join(right, digest, "left")
        .select(*columns, extra)
    )
    return plain.unionByName(map_batches(joined, mask, docs.schema))
