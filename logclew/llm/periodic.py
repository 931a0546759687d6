"""Periodic runs of words, found by catching squares online over dyadic blocks.

A run is a longest stretch of words in which words ``period`` apart are the same, with the
smallest such period. ``SquareCatcher`` reads a sequence that grows. Whenever an aligned
block of 2^k words is complete, it becomes a catcher for the periods 2^(k+1) - 1 to
2^(k+2) - 2: a square of such a period has a whole aligned block in its first half, so
the block comes back exactly one period later. Every appended word therefore compares, on
each level, the suffix of 2^k words that it ends with the two blocks that lie at such a
distance. A match is extended to both sides by less than a block, neighbouring matches
of one period merge, and what is long enough is a run. That takes a constant number of
steps for a word and level. Suffixes are compared by a hash that needs no rescan, and words of
runs once more directly, so a collision changes nothing.

Documents are independent rows: no shuffle, and a task holds one Arrow batch. Words
are what lies between the ASCII blanks. Null and empty texts have no words and no
runs; repeated rows and null ids are documents like any other; a text of any length
is one sequence, read whole. Ties (two periods of one stretch) go to the smaller period;
runs are ordered by start, then period. Other columns are dropped, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.llm.batches import id_field, map_batches, text_or_empty

MIN_WORDS = 6
MIN_EXPONENT = 4
# Documents of a batch are read as one sequence with marks between them, of about so many
# words at most, unless one document has more.
GROUP_WORDS = 200_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
_NONE = np.zeros(0, np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """One 64-bit code per id; different ids have different codes."""
    x = ids.astype(np.uint64) + np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SquareCatcher:
    """Squares of a sequence of word ids that is appended to; ``runs`` merges them.

    Periods above ``max_period`` are not looked for.
    """

    def __init__(self, max_period: int):
        self.max_period = max_period
        self.ids = _NONE
        self._sums = np.zeros(1, np.uint64)
        self._powers = np.ones(1, np.uint64)
        self._caught: list[list[tuple[np.ndarray, np.ndarray]]] = []
        while (2 << len(self._caught)) - 1 <= max_period:
            self._caught.append([])

    def append(self, ids: np.ndarray) -> None:
        """Read further words; each is compared with the blocks that were complete before it."""
        before, n = len(self.ids), len(self.ids) + len(ids)
        self.ids = np.concatenate([self.ids, ids])
        self._powers = _powers(_BASE, n)
        terms = _mixed(ids) * _powers(_INVERSE, n)[before:n]
        sums = np.cumsum(terms, dtype=np.uint64) + self._sums[-1]
        self._sums = np.concatenate([self._sums, sums])
        for level, caught in enumerate(self._caught):
            caught.extend(self._matches(1 << level, before, n))

    def _keys(self, ends: np.ndarray, length) -> np.ndarray:
        """Hash of the ``length`` words that end with each of ``ends``."""
        return (self._sums[ends + 1] - self._sums[ends + 1 - length]) * self._powers[ends]

    def _matches(self, length: int, before: int, n: int):
        """(word, period) of suffixes equal to the nearer and to the farther block in reach."""
        words = np.arange(max(before, 3 * length - 2), n)
        if not len(words):
            return
        keys = self._keys(words, length)
        nearest = (words + 2 - 2 * length) // length - 1
        low = max(int(nearest[0]) - 1, 0)
        blocks = self._keys((np.arange(low, nearest[-1] + 1) + 1) * length - 1, length)
        for back in (0, 1):
            block = nearest - back
            # The first words have no farther block; clipping compares them with the
            # nearer one again, at a period that is then not theirs.
            same = (keys == blocks[np.maximum(block - low, 0)]) & (block >= 0)
            found = words[same]
            period = found - ((block[same] + 1) * length - 1)
            within = period <= self.max_period
            yield found[within], period[within]

    def runs(self, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT):
        """Arrays ``start, length, period`` of the runs so far, by start, then period."""
        found = [self._streaks(1 << level, caught, min_words, min_exponent)
                 for level, caught in enumerate(self._caught)]
        start, length, period = (
            np.concatenate([_NONE, *(f[i] for f in found)]) for i in range(3)
        )
        # A stretch that has a period has its multiples too: the least one counts.
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        start, length, period = start[first], length[first], period[first]
        order = np.lexsort((period, start))
        return start[order], length[order], period[order]

    def _streaks(self, block: int, caught, min_words: int, min_exponent: int):
        """Merge the matches of one level, extend them, and keep what is long enough."""
        if not caught:
            return _NONE, _NONE, _NONE
        word = np.concatenate([w for w, _ in caught])
        period = np.concatenate([p for _, p in caught])
        order = np.lexsort((word, period))
        word, period = word[order], period[order]
        opens = np.ones(len(word), bool)
        opens[1:] = (period[1:] != period[:-1]) | (word[1:] - word[:-1] != block)
        closes = np.append(opens[1:], True) if len(word) else opens
        first, last, period = word[opens] - block + 1, word[closes], period[opens]
        # Words first..last equal the words one period before them.
        step = block // 2
        while step:
            ends = np.maximum(first - 1, 0)
            room = first - step - period >= 0
            at = np.where(room, ends, step + period)
            more = room & (self._keys(at, step) == self._keys(at - period, step))
            first = first - np.where(more, step, 0)
            room = last + step < len(self.ids)
            at = np.where(room, last + step, last)
            more = room & (self._keys(at, step) == self._keys(at - period, step))
            last = last + np.where(more, step, 0)
            step //= 2
        least = np.maximum(min_words, min_exponent * period)
        long = last - first + 1 + period >= least
        exact = [
            piece
            for f, t, p in zip(first[long].tolist(), last[long].tolist(), period[long].tolist())
            for piece in self._verified(f, t, p)
            if piece[1] >= max(min_words, min_exponent * p)
        ]
        columns = np.array(exact, np.int64).reshape(-1, 3).T
        return columns[0], columns[1], columns[2]

    def _verified(self, first: int, last: int, period: int):
        """``(start, length, period)`` of the parts of a streak whose words truly agree."""
        agree = self.ids[first : last + 1] == self.ids[first - period : last + 1 - period]
        if agree.all():
            yield first - period, last - first + 1 + period, period
            return
        bounds = np.flatnonzero(np.diff(np.concatenate([[False], agree, [False]]).astype(np.int8)))
        for a, b in zip(bounds[::2].tolist(), bounds[1::2].tolist()):
            yield first + a - period, b - a + period, period


def _kept(n: int, runs: list[dict]) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for r in runs:
        depth[r["start"] + r["period"]] += 1
        depth[r["start"] + r["length"]] -= 1
    return np.cumsum(depth)[:n] == 0


def _of_group(documents: list[list[bytes]], min_words: int, min_exponent: int):
    """Runs and collapsed text of each document; all are read as one sequence."""
    number = defaultdict(count().__next__)
    sizes = [len(d) for d in documents]
    offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    ids = np.empty(offsets[-1], np.int64)
    for i, (at, words) in enumerate(zip(offsets.tolist(), documents)):
        ids[at : at + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids[at + len(words)] = -1 - i  # a mark that nothing equals
    catcher = SquareCatcher(max(sizes) // min_exponent)
    catcher.append(ids)
    starts, lengths, periods = catcher.runs(min_words, min_exponent)
    owner = np.searchsorted(offsets, starts, "right") - 1
    found: list[list[dict]] = [[] for _ in documents]
    for d, s, n, p in zip(owner.tolist(), (starts - offsets[owner]).tolist(), lengths.tolist(), periods.tolist()):
        found[d].append({"start": s, "length": n, "period": p})
    for words, runs in zip(documents, found):
        if runs:
            words = [w for w, k in zip(words, _kept(len(words), runs).tolist()) if k]
        yield runs, b" ".join(words).decode()


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """``doc_id, runs, collapsed`` for every document.

    ``runs`` lists ``start, length, period`` (in words) of every run of at least
    ``min_words`` words and ``min_exponent`` periods. ``collapsed`` is the
    text with each run cut to its first period, words joined by one blank.
    """
    if min_words < 1 or min_exponent < 2:
        raise ValueError("min_words must be 1 or more, min_exponent 2 or more")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, collapsed, group, held = [], [], [], 0

        def flush():
            for r, c in _of_group(group, min_words, min_exponent):
                runs.append(r)
                collapsed.append(c)
            group.clear()

        for text in batch.column(1):
            words = text.as_py().encode().split()
            if group and held + len(words) > GROUP_WORDS:
                flush()
                held = 0
            group.append(words)
            held += len(words)
        if group:
            flush()
        run = pa.struct([pa.field(n, pa.int64(), False) for n in _RUN.names])
        columns = [batch.column(0), pa.array(runs, pa.list_(run)), pa.array(collapsed, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])

    schema = T.StructType(
        [id_field(docs, id_col), T.StructField("runs", T.ArrayType(_RUN, False)), T.StructField("collapsed", T.StringType())]
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_batches(texts, scan, schema)
