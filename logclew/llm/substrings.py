"""Substring dedup by hashing normalised units: the earliest ranked occurrence stays.

Units are lines, and clauses: passages are pasted in the middle of lines as often as on
lines of their own, so lines are cut again at punctuation. A unit is normalised (ASCII lower
case, white space to single blanks, punctuation at its ends off) and hashed; digests are
grouped globally, with the least rank per digest found by partial aggregates, so a unit that
everyone has costs no task more than others. An occurrence other than the least one is a
repeat. A line of ``LINE_WORDS`` words or more that is a repeat is cut out. Clauses repeat by
chance, so only runs of repeats with ``min_words`` words or more are cut out, and clauses of
one or two words, which repeat in any text, lie in runs but do not count. In scripts without
blanks every character counts as a word. The spans removed, merged where they meet, are kept
as code-point offsets into the original.

Rank: id (nulls last), then the row as read, then the place in the text. Nulls: a null
text is empty. Blank units neither repeat nor end a run. Repeated rows: the first
keeps its text, the others lose it (a row always stays). Long texts are read whole.
Other columns stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.llm.batches import free_name, map_batches
from logclew.session import fresh_path, stage

MIN_WORDS = 20
# Shorter units add nothing to the words of a run.
COUNTED_WORDS = 3
# A shorter line stays, however often it repeats.
LINE_WORDS = 5
MARKS = ".,;:!?。，、；：！？\n"
_UNIT = re.compile(f"[^{MARKS}]+[{MARKS}]*|[{MARKS}]+")
_TRIM = MARKS + " \t\v\f\r"
_LINE = re.compile("[^\n]*\n|[^\n]+")
# Thai to Khmer, kana, Han: scripts that set no blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")


def normal(unit: str) -> bytes:
    return b" ".join(unit.strip(_TRIM).encode("utf-8").lower().split())


def words_in(unit: bytes) -> int:
    """Words of a normal form; a character of a script without blanks is one more."""
    words = unit.count(b" ") + 1
    return words if unit.isascii() else words + len(_UNSPACED.findall(unit.decode("utf-8")))


def units_of(text: str | None) -> list[tuple[int, int, bytes]]:
    """(start, end, normal form) of the units that have a word."""
    found = ((m.start(), m.end(), normal(m.group())) for m in _UNIT.finditer(text or ""))
    return [u for u in found if u[2]]


def lines_of(text: str | None) -> list[tuple[int, int, bytes]]:
    """(start, end, normal form) of the lines of ``LINE_WORDS`` words or more, line end included."""
    found, at = [], 0
    for line in _LINE.findall(text or ""):
        unit = normal(line)
        if unit and words_in(unit) >= LINE_WORDS:
            found.append((at, at + len(line), unit))
        at += len(line)
    return found


def digests_of(text: str | None) -> list[tuple[int, int]]:
    """(number, digest) of all units: clauses have even numbers, lines odd ones."""
    clauses = [(2 * n, xxhash.xxh64_intdigest(u[2])) for n, u in enumerate(units_of(text))]
    # A seed of their own keeps lines from being repeats of clauses.
    return clauses + [(2 * n + 1, xxhash.xxh64_intdigest(u[2], 1)) for n, u in enumerate(lines_of(text))]


def repeated_spans(text: str | None, repeats: list[int] | None, min_words: int) -> list[tuple[int, int]]:
    """Repeated lines, and runs of repeated clauses with ``min_words`` words that count.

    ``repeats``: numbers of the units that are repeats.
    """
    if not repeats:
        return []
    units, marked, run = units_of(text), {n // 2 for n in repeats if n % 2 == 0}, []
    lines = lines_of(text) if any(n % 2 for n in repeats) else []
    spans = [lines[n // 2][:2] for n in repeats if n % 2]
    for n in range(len(units) + 1):
        if n in marked:
            run.append(units[n])
        elif run:
            words = [words_in(u[2]) for u in run]
            if sum(n for n in words if n >= COUNTED_WORDS) >= min_words:
                spans.append((run[0][0], run[-1][1]))
            run = []
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    at, kept = 0, []
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    spans_col: str = "removed_spans",
) -> DataFrame:
    """``docs`` with repeats cut out of the text, and ``spans_col`` with their offsets.

    The texts are written once with row numbers, so that every pass names rows alike.
    """
    spark = docs.sparkSession
    if spans_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column {spans_col}; pass another spans_col")
    row = free_name(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    path = fresh_path(spark, "texts")
    numbered.write.option("compression", "zstd").parquet(path)
    texts = spark.read.schema(numbered.schema).parquet(path)

    unit_schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("place", T.IntegerType()),
            T.StructField("digest", T.LongType()),
        ]
    )

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, places, digests = [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            made = digests_of(text)
            at += [i] * len(made)
            places += [n for n, _ in made]
            digests += [d for _, d in made]
        rows = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(rows),
                batch.column(1).take(rows),
                pa.array(places, pa.int32()),
                pa.array(digests, pa.uint64()).view(pa.int64()),
            ],
            names=unit_schema.names,
        )

    units = map_batches(
        texts.select(row, id_col, F.col(text_col).cast("string")), split, unit_schema
    )
    rank = F.struct(F.col("id").isNull().alias("x"), "id", "row", "place")
    first = (
        units.groupBy("digest")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", F.col("first.row").alias("r"), F.col("first.place").alias("p"))
    )
    # From a table both sides of the join have a plain exchange, so that a digest which many
    # texts share is split over tasks.
    repeats = (
        units.select("digest", "row", "place")
        .join(stage(first, "repeated"), "digest")
        .where((F.col("row") != F.col("r")) | (F.col("place") != F.col("p")))
        .groupBy(F.col("row").alias(row))
        .agg(F.collect_list("place").alias(spans_col))
    )
    marked = texts.join(repeats, row, "left").select(*docs.columns, spans_col)
    kind = "array<struct<start:int,end:int>>"
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(spans_col, T._parse_datatype_string(kind))]
    )
    at_text = docs.columns.index(text_col)
    arrow_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def shorten(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        old, places = columns[at_text].to_pylist(), columns[-1].to_pylist()
        spans = [repeated_spans(t, p, min_words) for t, p in zip(old, places, strict=True)]
        new = [cut(t, s) if s else t for t, s in zip(old, spans, strict=True)]
        columns[at_text] = pa.array(new, columns[at_text].type)
        named = [[{"start": a, "end": b} for a, b in s] for s in spans]
        columns[-1] = pa.array(named, arrow_kind)
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(marked, shorten, schema)
