"""Quality rules: repetition and length, and the fertility of a public tokeniser.

A vocabulary made from much text cuts ordinary prose of its languages into a typical
number of characters a token, seldom falls back to bytes, and spreads over many
pieces. Markup debris, shouting, encoded data and loops leave those bands. Bands go by
language, else by the script most letters are of.

Short texts scatter more, and have room for less entropy: for both measures the scatter
of clean text goes with one over the square root of its tokens. A bound is
therefore a level less a slack over that root, at every length. The bands of the four
languages are set from a clean reference: the documents of sf0.1 that are labelled
quality 1, pass the base rules and have an even doc_id (1,608). The level of characters a
token is 97 % of the reference's median, that of entropy 6.8 bits; a slack is the least
that keeps the whole reference, and a tenth more. Scripts have no reference: their
levels are lower.

Nulls: a null text has no words and fails; a null or unknown language takes the band
of the script. Each row is judged by itself, so repeated rows and ties change nothing;
texts are read whole. Other columns are ignored by ``measure`` and kept by
``keep_good``. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.llm.batches import id_field, map_batches
from logclew.llm.tokens import WordStore, piece_store

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Band:
    """What passes. A text of n tokens has at least ``min_chars_per_token`` less
    ``chars_slack`` / sqrt(n) characters a token, and at least ``min_entropy`` less
    ``entropy_slack`` / sqrt(n) bits of entropy."""

    min_chars_per_token: float
    chars_slack: float = 0.0
    max_chars_per_token: float = 8.0
    max_fallback_share: float = 0.25
    min_entropy: float = 6.8
    entropy_slack: float = 16.0


# By language, then by script.
BANDS: Mapping[str, Band] = {
    "en": Band(2.15, 4.0, entropy_slack=14.9),
    "de": Band(2.18, 2.4, entropy_slack=14.8),
    "fr": Band(1.92, 3.7, entropy_slack=16.2),
    "es": Band(1.88, 1.7, entropy_slack=15.7),
    "latin": Band(1.25, min_entropy=6.4),
    "other": Band(0.3, max_fallback_share=0.7, min_entropy=4.0, entropy_slack=8.0),
}

_FIRST_BYTE_PIECE = 3  # <0x00>; pieces 3 to 258 are the bytes
_FIELDS = (
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
    ("chars_per_token", T.DoubleType()),
    ("fallback_share", T.DoubleType()),
    ("token_entropy", T.DoubleType()),
    ("band", T.StringType()),
)


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words (a power of two) that occur twice or more.

    Windows are named by doubling: a window of 2k words is the pair of its halves.
    """
    size, names = 1, codes
    while size < window:
        if len(names) <= size:
            return 0
        pairs = names[:-size] * np.int64(len(codes) + 1) + names[size:]
        _, names, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max(initial=0) < 2:
            return 0
        size *= 2
    edge = np.zeros(len(codes) + 1, np.int64)
    twice = np.flatnonzero(counts[names] > 1)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    letters = [c for c in text if c.isalpha()]
    return "latin" if 2 * sum(c < "ɐ" for c in letters) >= len(letters) else "other"


def judge(
    text: str, words: list[bytes], lang: str | None, bands: Mapping[str, Band], store: WordStore
) -> tuple:
    """The values of ``_FIELDS`` for one text and its words."""
    data = text.encode("utf-8")
    n = len(words)
    blanks = sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    word_chars = len(text) - blanks
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(names.__getitem__, words), np.int64, n)
    repeated = repeated_words(codes)
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    band = lang if lang in bands else script_of(text)
    if not n:
        return 0, word_chars, symbols, 0, 0, True, False, 0.0, 0.0, 0.0, band
    found = list(map(store.__getitem__, names))
    ids = np.frombuffer(b"".join(found), "<u2")
    times = np.repeat(np.bincount(codes), [len(x) // 2 for x in found])
    per_piece = np.bincount(ids, weights=times)
    tokens = int(times.sum())
    fallback = per_piece[_FIRST_BYTE_PIECE : _FIRST_BYTE_PIECE + 256].sum() / tokens
    share = per_piece[per_piece > 0] / tokens
    entropy = float(-(share * np.log2(share)).sum())
    chars = word_chars / tokens
    b, root = bands[band], math.sqrt(tokens)
    passes = (
        b.min_chars_per_token - b.chars_slack / root <= chars <= b.max_chars_per_token
        and fallback <= b.max_fallback_share
        and entropy >= b.min_entropy - b.entropy_slack / root
    )
    return (
        n, word_chars, symbols, duplicate_lines(data), repeated, base_failed,
        bool(not base_failed and passes), chars, float(fallback), entropy, band,
    )


def judge_all(
    texts: list[str | None], langs: list[str | None], bands: Mapping[str, Band], vocabulary: str
) -> list[tuple]:
    store = piece_store(vocabulary)
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8").split() for t in texts]
    store.learn(set().union(*words))
    return [judge(t, w, x, bands, store) for t, w, x in zip(texts, words, langs, strict=True)]


def measure(
    docs: DataFrame,
    vocabulary: str,
    bands: Mapping[str, Band] = BANDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Measures and verdict of each row."""
    fields = [T.StructField(name, kind) for name, kind in _FIELDS]
    schema = T.StructType([id_field(docs, id_col), *fields])
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        judged = judge_all(texts, langs, bands, vocabulary)
        columns = [pa.array(c, k) for c, k in zip(zip(*judged, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    wanted = docs.select(
        F.col(id_col), F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    )
    return map_batches(wanted, rows, schema)


def keep_good(
    docs: DataFrame,
    vocabulary: str,
    bands: Mapping[str, Band] = BANDS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The rows that pass, with all their columns."""
    at_text, at_lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def passing(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = batch.column(at_text).to_pylist(), batch.column(at_lang).to_pylist()
        kept = [row[6] for row in judge_all(texts, langs, bands, vocabulary)]
        return batch.filter(pa.array(kept, pa.bool_()))

    return map_batches(docs, passing, docs.schema)
