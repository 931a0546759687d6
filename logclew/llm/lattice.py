"""SentencePiece encoding and decoding as lattices of pieces.

A text is marked as the library does (blanks become U+2581, one is put in front) and
cut into units that no piece reaches across: marks with the characters after them,
and line breaks. Each distinct unit of a batch becomes a lattice, if its ids are not kept
from an earlier one: its substrings are joined to the pieces, all starts at a time, along a tree of
the pieces' characters that drops a start as soon as no piece goes on so. Edges are folded
by their ends from left to right, in all units at once, keeping the last edge of every prefix.

The vocabulary is a merge table. Taking the path of the greatest sum of scores, which is
right for unigram vocabularies, gives the library's ids for only two words in five
here. So the fold scores by merges: an edge may follow another only if merging
their joined text gives just these two pieces. A prefix has exactly one such last edge,
and the path through them is the library's. A pair that comes up in a fold is
tested once by each worker.

Characters without a piece become their UTF-8 bytes' pieces.

All this is done where a text is read: sending units to be encoded once in all, and their ids back
to every text, moves several times the input. So a unit is encoded once by each worker that
meets it (again if it was dropped: at most ``KEPT_UNITS`` and ``KEPT_PAIRS`` are kept, and those of
one batch). Rows are not moved: a file that Spark cannot split is one task's work.

Nulls: a null text is empty, and empty texts have no ids. Repeated rows are encoded each.
Long texts are read whole; a unit without any break costs time and memory in proportion to its length.
Other columns stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclew.llm.batches import ready, text_or_empty
from logclew.llm.tokens import STORE_BYTES, pieces

MARK = "▁"
BYTES_FROM, BYTES_TO = 3, 259  # ids of the byte pieces
# Bounds of a worker's memory: about 200 bytes a unit, up to 50 a pair.
KEPT_UNITS, KEPT_PAIRS = 250_000, 1_000_000
# Units are folded together up to so many characters, or one at a time.
FOLD_CHARS = 200_000
_UNIT = f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n"
_UNKNOWN, _NONE = -1, -2
_BASE = 1 << 20  # ids are below
_CHARS = 1 << 21  # code points are below
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def piece_list(model: str) -> list[tuple[str, int]]:
    """(piece, id) of the vocabulary without control and byte pieces."""
    known = pieces(model)
    rows = [(known.id_to_piece(i), i) for i in range(BYTES_TO, known.vocab_size())]
    for piece, _ in rows:
        if MARK in piece.lstrip(MARK) or "\n" in piece:
            raise ValueError(f"units cannot be cut around the piece {piece!r}")
    return rows


def units_of(text: Column) -> Column:
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(marked, F.lit(_UNIT), F.lit(0))
    )


class NumberTable:
    """Numbers by keys from 0 on, asked for by whole arrays: open addressing."""

    def __init__(self, bits: int = 12):
        self._bits, self.count = bits, 0
        self._keys = np.full(1 << bits, -1, np.int64)
        self._values = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it may be put."""
        at = ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self._bits)).astype(np.int64)
        held = self._keys[at]
        other = np.flatnonzero((held != keys) & (held != -1))
        while len(other):
            at[other] = (at[other] + 1) & ((1 << self._bits) - 1)
            held = self._keys[at[other]]
            other = other[(held != keys[other]) & (held != -1)]
        return at

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        return np.where(self._keys[at] == keys, self._values[at], _NONE)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """For different keys that are not there."""
        while 2 * (self.count + len(keys)) > len(self._keys):
            held = np.flatnonzero(self._keys != -1)
            old = self._keys[held], self._values[held]
            self.__init__(self._bits + 1)
            self.put(*old)
        self.count += len(keys)
        while len(keys):
            at = self._slots(keys)
            self._keys[at] = keys
            # Of keys that went for the same place one has it.
            has = self._keys[at] == keys
            self._values[at[has]] = values[has]
            keys, values = keys[~has], values[~has]


class Lattices:
    """The pieces as a tree, and the pairs that were tested."""

    def __init__(self, model: str):
        self._known, self._pairs, self.kept = pieces(model), NumberTable(), {}
        nodes, ids = {}, [_NONE]
        for piece, number in piece_list(model):
            node = 0
            for char in piece:
                node = nodes.setdefault(node * _CHARS + ord(char), len(ids))
                if node == len(ids):
                    ids.append(_NONE)
            ids[node] = number
        self._tree, self._ids = NumberTable(), np.array(ids)
        self._tree.put(np.fromiter(nodes, np.int64), np.fromiter(nodes.values(), np.int64))

    def encode(self, units: list[str]) -> list[bytes]:
        """The ids of different units, as 32-bit numbers."""
        if len(self.kept) > KEPT_UNITS:
            self.kept.clear()
        if self._pairs.count > KEPT_PAIRS:
            self._pairs = NumberTable()
        new = [u for u in units if u not in self.kept]
        low, chars = 0, 0
        for high, unit in enumerate(new):
            if chars and chars + len(unit) > FOLD_CHARS:
                self._learn(new[low:high])
                low, chars = high, 0
            chars += len(unit)
        if new:
            self._learn(new[low:])
        out = [self.kept[u] for u in units]
        for unit in new:
            if len(unit) > STORE_BYTES:
                del self.kept[unit]
        return out

    def _edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, size, id) of the parts that are pieces, and of single unknown characters;
        ``left`` is the number of characters in the unit from each one on."""
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        found, size = [], 0
        while len(at):
            node = self._tree.get(node * _CHARS + chars[at + size]).astype(np.int64)
            size += 1
            on = node != _NONE
            ids = np.where(on, self._ids[np.where(on, node, 0)], _NONE)
            if size == 1:
                ids[ids == _NONE] = _UNKNOWN
            edge = ids != _NONE
            found.append((at[edge], np.full(np.count_nonzero(edge), size), ids[edge]))
            on &= left[at] > size
            at, node = at[on], node[on]
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _stable(self, keys: np.ndarray) -> np.ndarray:
        """Whether the pieces of each key stay as they are when their joined text is encoded."""
        kept = self._pairs.get(keys)
        missing = np.flatnonzero(kept == _NONE)
        if len(missing):
            new = np.unique(keys[missing])
            texts, wanted = [], []
            for key in new.tolist():
                ids = [i for i in divmod(key, _BASE) if i]
                # A line break in front keeps the library from adding its own mark.
                texts.append("\n" + "".join(map(self._known.id_to_piece, ids)).replace(MARK, " "))
                wanted.append(ids)
            got = self._known.encode(texts, num_threads=1)
            self._pairs.put(new, np.array([g[2:] == w for g, w in zip(got, wanted, strict=True)], np.int32))
            kept[missing] = self._pairs.get(keys[missing])
        return kept == 1

    def _learn(self, units: list[str]) -> None:
        chars = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(u) for u in units])
        unit = np.repeat(np.arange(len(units)), sizes)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start, size, ids = self._edges(chars, np.repeat(sizes, sizes) - place)

        # A unit has a prefix more than characters: the empty one, with 0 as its last edge. Edges
        # that follow an unknown character stand as at the beginning.
        ends = place[start] + size
        order = np.argsort(ends, kind="stable")
        bounds = np.cumsum(np.bincount(ends)).tolist()
        start, size, ids = start[order], size[order], ids[order]
        low = start + unit[start]
        high = low + size
        whole = np.cumsum(sizes + 1) - 1
        last = np.full(len(chars) + len(units), _NONE, np.int64)
        back = np.zeros(len(last), np.int64)
        last[whole - sizes] = 0
        for a, b in zip(bounds, bounds[1:]):
            edge, before = ids[a:b], last[low[a:b]]
            fits = before != _NONE
            known = np.flatnonzero(fits & (edge != _UNKNOWN))
            fits[known] = self._stable(np.maximum(before[known], 0) * _BASE + edge[known])
            to = high[a:b][fits]
            last[to], back[to] = edge[fits], low[a:b][fits]
        lost = np.flatnonzero(last[whole] == _NONE)
        if len(lost):
            raise ValueError(f"no path through the unit {units[lost[0]]!r}")

        used, at = np.zeros(len(last), bool), whole
        while len(at):
            used[at] = True
            at = back[at]
            at = at[last[at] != 0]
        path = np.flatnonzero(used)
        of, ids = np.repeat(np.arange(len(units)), sizes + 1)[path], last[path]
        unknown = ids == _UNKNOWN
        codes = chars[(path - of - 1)[unknown]]
        times = np.ones(len(path), np.int64)
        times[unknown] += (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        out = np.repeat(ids, times).astype(np.int32)
        spelt = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        out[np.repeat(unknown, times)] = np.frombuffer(spelt, np.uint8).astype(np.int32) + BYTES_FROM
        to = np.cumsum(np.bincount(of, times, len(units)).astype(np.int64)) * out.itemsize
        packed, low = out.tobytes(), 0
        for text, high in zip(units, to.tolist(), strict=True):
            self.kept[text] = packed[low:high]
            low = high


@lru_cache(maxsize=2)
def lattices(model: str) -> Lattices:
    return Lattices(model)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def encode(
    rows: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids"
) -> DataFrame:
    """``rows`` with ``ids_col``, the ids of each text in order."""
    if ids_col.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"the input has a column {ids_col}; pass another ids_col")
    piece_list(model)
    ready(rows.sparkSession)

    def ids_of(units: pa.Array) -> pa.Array:
        used = units.flatten().dictionary_encode()
        packed = lattices(model).encode(used.dictionary.to_pylist())
        counts = np.array([len(p) // 4 for p in packed], np.int64)
        ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
        at = used.indices.to_numpy()
        listed = pa.ListArray.from_arrays(pa.array(_offsets(counts), pa.int32()), ids).take(used.indices)
        rows_at = _offsets(units.value_lengths().to_numpy())
        return pa.ListArray.from_arrays(pa.array(_offsets(counts[at])[rows_at], pa.int32()), listed.flatten())

    return rows.withColumn(ids_col, F.arrow_udf(ids_of, "array<int>")(units_of(text_or_empty(text_col))))


@lru_cache(maxsize=2)
def _spelling(model: str) -> pa.Array:
    """The bytes of each id, none for those of control pieces."""
    spelt = [b""] * BYTES_FROM + [bytes([n]) for n in range(BYTES_TO - BYTES_FROM)]
    spelt += [piece.replace(MARK, " ").encode("utf-8") for piece, _ in piece_list(model)]
    return pa.array(spelt, pa.binary())


def decode(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``, the text of the ids: the spelling of each, in order.

    Null or empty ids give an empty text, ids without a piece nothing; repeated rows are decoded each.
    A column that is called ``text_col`` already is replaced.
    """
    piece_list(model)
    ready(rows.sparkSession)

    def spell(ids: pa.Array) -> pa.Array:
        spelt = _spelling(model)
        at = ids.flatten().cast(pa.int64()).fill_null(0).to_numpy()
        parts = spelt.take(pa.array(np.where((at < 0) | (at >= len(spelt)), 0, at)))
        offsets = pa.array(_offsets(ids.value_lengths().to_numpy()), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, parts), b"")

    rows = rows.drop(text_col)
    ids = F.coalesce(F.col(ids_col), F.array().cast(rows.schema[ids_col].dataType))
    text = F.decode(F.arrow_udf(spell, "binary")(ids), "UTF-8")
    # The blank in front is the encoder's.
    text = F.when(F.substr(text, F.lit(1), F.lit(1)) == " ", F.substr(text, F.lit(2))).otherwise(text)
    return rows.withColumn(text_col, text)
