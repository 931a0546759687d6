"""Language identification by prediction by partial matching.

For each language a context tree counts which byte follows which context of up to
``ORDER`` bytes in the training texts. Under a tree a byte costs its code length: with n
bytes seen after a context, d of them different, one seen c times costs -log2(c / (n + d));
any other costs the escape, -log2(d / (n + d)), and then what the context without its
first byte asks for, down to eight bits for a byte never seen at all. A context that the
tree lacks costs nothing to leave. (Bytes known to the longer context are not excluded
from the shorter one.) The trees are frozen: scoring a text changes nothing. The
language whose tree gives the shortest code for the whole text is predicted, and the
score is its share of the likelihood over all languages.

Spark counts, over all training texts: tasks count 5-byte windows of their rows by sorting, the
shuffle adds them up, and the shorter contexts are sums of the longer ones. A
tree keeps the nodes from the least count on at which it fits its share of ``CELLS``; since a context
is seen at least as often as one that extends it, what is kept is a tree. So the
model has at most ``CELLS`` numbers, however much text there is and however many
languages, and that bounds what goes through the driver and to the executors.

Null and empty texts, and those without a letter, are ``und`` with score 0, as is every
text when nothing could be learnt. A text of any length is read whole, in slices.
Equal code lengths go to the first language by name. Rows without a language or without
an id teach nothing; a null id is not held out. Repeated rows count as often as they come.
Other columns are dropped, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.llm.batches import id_field, map_batches, stream_batches, text_or_empty
from logclew.session import stage

ORDER = 4
# Numbers in the model: nodes of all trees times languages.
CELLS = 1_600_000
HELD_OUT_OF, HELD_OUT_IS = 4, 2
UNKNOWN = "und"

# Texts are read in slices of about so many bytes, and counts of a task are handed on when
# there are so many different ones.
_SLICE = 1 << 20
_HELD = 2_000_000
_PAD = b"\n" * ORDER


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, window of ORDER + 1 bytes as a number) of every byte.

    The last byte of a window is the one it stands for; line ends come before a text.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= _SLICE):
            size += len(texts[last])
            last += 1
        group = texts[first:last]
        data = np.frombuffer(b"".join(_PAD + t for t in group), np.uint8)
        sizes = np.array([len(t) + ORDER for t in group])
        starts = np.cumsum(sizes) - sizes
        for low in range(ORDER, len(data), _SLICE):
            at = np.arange(low, min(low + _SLICE, len(data)))
            owner = np.searchsorted(starts, at, "right") - 1
            window = np.zeros(len(at), np.uint64)
            for back in range(ORDER, -1, -1):
                window = (window << np.uint64(8)) | data[low - back : low - back + len(at)]
            real = at - starts[owner] >= ORDER
            yield owner[real] + first, window[real]
        first = last


def _tail(windows: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` + 1 bytes of each window."""
    return windows & np.uint64((1 << (8 * (order + 1))) - 1)


class _Rows:
    """Rows of different numbers, found by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self._shift = np.uint64(64 - max(2 * len(keys), 2).bit_length())
        self._slots = np.full(1 << int(64 - self._shift), -1, np.int32)
        rows = np.arange(len(keys), dtype=np.int32)
        slots = self._home(keys)
        while len(rows):
            free = self._slots[slots] < 0
            self._slots[slots[free]] = rows[free]
            lost = self._slots[slots] != rows
            rows, slots = rows[lost], (slots[lost] + 1) % len(self._slots)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slots = self._home(keys)
        found = self._slots[slots]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys)) if len(self.keys) else []
        while len(open_):
            slots[open_] = (slots[open_] + 1) % len(self._slots)
            found[open_] = self._slots[slots[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


@dataclass(frozen=True)
class Model:
    """Frozen trees: for every order, code lengths of the nodes and escapes of the contexts."""

    languages: tuple[str, ...]
    nodes: tuple[_Rows, ...]
    bits: tuple[np.ndarray, ...]
    contexts: tuple[_Rows, ...]
    escapes: tuple[np.ndarray, ...]

    def code_lengths(self, windows: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each window, one column a language."""
        if order < 0:
            return np.full((len(windows), len(self.languages)), 8.0, np.float32)
        tails = _tail(windows, order)
        row = self.nodes[order].find(tails)
        if not len(self.bits[order]):
            return self.code_lengths(windows, order - 1)
        out = self.bits[order][row]
        missing = np.flatnonzero(row < 0)
        if len(missing):
            left = windows[missing]
            row = self.contexts[order].find(tails[missing] >> np.uint64(8))
            out[missing] = self.code_lengths(left, order - 1)
            out[missing] += np.where((row >= 0)[:, None], self.escapes[order][row], 0)
        return out

    def texts_bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text, one column a language."""
        total = np.zeros((len(texts), len(self.languages)))
        for owner, windows in slices(texts):
            bits = self.code_lengths(windows)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner, bits[:, k], len(texts))
        return total


def freeze(counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of ``{(language, order): (windows in ascending order, counts)}``."""
    languages = tuple(sorted({name for name, _ in counts}))
    model = Model(languages, (), (), (), ())
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for order in range(ORDER + 1):
        trees = [counts.get((name, order), none) for name in languages]
        keys = np.unique(np.concatenate([none[0], *(k for k, _ in trees)]))
        above = np.unique(keys >> np.uint64(8))
        escapes = np.zeros((len(above), len(languages)), np.float32)
        contexts = _Rows(above)
        # What a node costs in a language that lacks it is the escape and the shorter context.
        bits = model.code_lengths(keys, order - 1).astype(np.float32)
        for k, (tree, n) in enumerate(trees):
            parents, at = np.unique(tree >> np.uint64(8), return_inverse=True)
            seen, kinds = np.bincount(at, n, len(parents)), np.bincount(at, minlength=len(parents))
            if len(parents):
                rows = np.searchsorted(above, parents)
                escapes[rows, k] = np.log2((seen + kinds) / kinds)
            bits[:, k] += escapes[np.searchsorted(above, keys >> np.uint64(8)), k] if len(keys) else 0
            if len(tree):
                bits[np.searchsorted(keys, tree), k] = np.log2((seen + kinds)[at] / n)
        model = Model(
            languages,
            (*model.nodes, _Rows(keys)),
            (*model.bits, bits),
            (*model.contexts, contexts),
            (*model.escapes, escapes),
        )
    return model


def remainder(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % HELD_OUT_OF


def held_out(id_: Column) -> Column:
    return F.coalesce(remainder(id_) == HELD_OUT_IS, F.lit(False))


def _window_counts(rows: DataFrame) -> DataFrame:
    """``lang, gram, n``: windows of ORDER + 1 bytes, counted per task and then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[str, list[np.ndarray]] = {}

        def settle() -> None:
            for lang, parts in fresh.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], keys])
                    weights = np.concatenate([held[lang][1], n])
                    keys, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, weights, len(keys)).astype(np.int64)
                held[lang] = keys, n
            fresh.clear()

        def result() -> Iterator[pa.RecordBatch]:
            for lang, (keys, n) in held.items():
                for low in range(0, len(keys), 100_000):
                    part = keys[low : low + 100_000].astype(np.int64)
                    names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(part), np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(part), pa.array(n[low : low + 100_000].astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )
            held.clear()

        waiting = 0
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text.encode())
            for lang, group in texts.items():
                for _, windows in slices(group):
                    fresh.setdefault(lang, []).append(windows)
                    waiting += len(windows)
                    if waiting >= _HELD:
                        settle()
                        waiting = 0
                        if sum(len(k) for k, _ in held.values()) >= _HELD:
                            yield from result()
        settle()
        yield from result()

    counted = stream_batches(rows.select("lang", "text"), count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    cells: int = CELLS,
) -> Model:
    """Trees of all languages of ``docs``, from every row that is not held out."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where((remainder(F.col("doc_id")) != HELD_OUT_IS) & F.col("lang").isNotNull())
    windows = stage(_window_counts(rows), "byte-windows")
    orders = F.explode(F.array(*[F.lit(k) for k in range(ORDER + 1)])).alias("k")
    # The counts of a shorter context are sums over the windows that end like it.
    masks = F.element_at(
        F.array(*[F.lit((1 << (8 * (k + 1))) - 1) for k in range(ORDER + 1)]), F.col("k") + 1
    )
    nodes = stage(
        windows.select("lang", "gram", "n", orders)
        .select("lang", "k", F.col("gram").bitwiseAND(masks).alias("gram"), "n")
        .groupBy("lang", "k", "gram")
        .agg(F.sum("n").alias("n")),
        "context-trees",
    )
    languages = windows.select("lang").distinct().count()
    if not languages:
        return freeze({})
    # Of each language, the counts down to the least at which its tree has its share of nodes.
    share = cells // languages**2
    down = Window.partitionBy("lang").orderBy(F.col("n").desc())
    least = stage(
        nodes.groupBy("lang", "n")
        .agg(F.count(F.lit(1)).alias("of"))
        .withColumn("so_far", F.sum("of").over(down))
        .where(F.col("so_far") <= share)
        .groupBy("lang")
        .agg(F.min("n").alias("least")),
        "least-counts",
    )
    # At most ``cells`` / languages rows.
    kept = nodes.join(least, "lang").where(F.col("n") >= F.col("least")).orderBy("lang", "k", "gram")
    table = kept.select("lang", "k", "gram", "n").toArrow()
    lang, k = (np.array(table[c].to_pylist(), object) for c in ("lang", "k"))
    gram, n = table["gram"].to_numpy().astype(np.uint64), table["n"].to_numpy()
    counts = {}
    for name in sorted(set(lang)):
        for order in range(ORDER + 1):
            mine = (lang == name) & (k == order)
            counts[name, order] = gram[mine], n[mine]
    return freeze(counts)


def share_of_best(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column of the shortest code of each row, and its share of the likelihood."""
    best = bits.argmin(axis=1)
    behind = bits - bits[np.arange(len(bits)), best][:, None]
    return best, 1.0 / np.exp2(-np.minimum(behind, 1000.0)).sum(axis=1)


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    schema = T.StructType(
        [
            id_field(docs, id_col),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        trees = shared.value
        names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        at = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False)) if trees.languages else []
        if len(at):
            texts = batch.column(2).take(pa.array(at)).to_pylist()
            best, scores[at] = share_of_best(trees.texts_bits([t.encode() for t in texts]))
            for i, b in zip(at.tolist(), best.tolist(), strict=True):
                names[i] = trees.languages[b]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
            names=schema.names,
        )

    text = text_or_empty(text_col)
    read = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text.alias("text"))
    return map_batches(read.withColumn("letters", F.col("text").rlike(r"\p{L}")), rows, schema)
