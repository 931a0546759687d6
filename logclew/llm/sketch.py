"""Threshold-scaled sketches: every shingle hash below a fixed share of the hash range.

As the threshold is fixed, the sketch of a union is the union of the sketches, and the
share of one sketch found in another estimates containment however unequal the
documents are. A document's least hash is kept even if it lies above the threshold, so
any text with a word has a sketch; merging keeps it only while nothing lower is there.

``edited_pairs`` compares each document with a text edited from it and with the
next document, in descending order of ids. The order is cut into ranges, found from ids and text
hashes alone. Each range goes to one task with a copy of the next one's first text behind it, and
is read in order, holding two texts at a time. Texts cross the network once, and sketches not at all.

Nulls: a null text is empty and has an empty sketch; null ids come after all others.
Ties: rows of equal id follow one another by the hash of their text. Repeated rows
are documents each. Two empty sketches are alike (1.0); an empty one and another are not
(0.0). Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.llm.batches import id_field, map_batches, stream_batches
from logclew.llm.simhash import shingle_hashes
from logclew.session import fresh_path

SHINGLE = 5
ONE_IN = 3


def scaled(hashes: np.ndarray, one_in: int = ONE_IN) -> np.ndarray:
    """The distinct hashes below the threshold, else the least one; ascending."""
    kept = np.unique(hashes)
    return kept[: max(int(np.searchsorted(kept, np.uint64((1 << 64) // one_in))), 1)]


def sketch(text: str | None, one_in: int = ONE_IN) -> np.ndarray:
    return scaled(shingle_hashes((text or "").encode("utf-8").lower().split(), SHINGLE), one_in)


def merge(one: np.ndarray, other: np.ndarray, one_in: int = ONE_IN) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    return scaled(np.concatenate([one, other]), one_in)


def containment(part: np.ndarray, whole: np.ndarray) -> float:
    """Estimated share of ``part``'s shingles that ``whole`` has."""
    if not len(part):
        return float(not len(whole))
    return len(np.intersect1d(part, whole, assume_unique=True)) / len(part)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Containment of the smaller sketch in the larger."""
    small, large = sorted((one, other), key=len)
    return containment(small, large) if len(small) else float(not len(large))


def written(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode("ascii")


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    schema = T.StructType([id_field(docs, id_col), T.StructField("fingerprint", T.StringType())])

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [written(sketch(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=schema.names)

    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), rows, schema)


_RESULT = (
    ("n_chars", T.LongType(), pa.int64()),
    ("edited_sha256", T.StringType(), pa.string()),
    ("fingerprint", T.StringType(), pa.string()),
    ("edited_fingerprint", T.StringType(), pa.string()),
    ("near_edited", T.DoubleType(), pa.float64()),
    ("near_next", T.DoubleType(), pa.float64()),
)


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(text: str, own: np.ndarray, following: str, next_sketch: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = sketch(changed)
    return (
        len(text),
        hashlib.sha256(changed.encode("utf-8")).hexdigest(),
        written(own),
        written(other),
        likeness(own, other),
        likeness(own, next_sketch),
    )


def _compressed(rows_: DataFrame) -> DataFrame:
    """``rows_`` with its texts as ``body``, compressed, as they are moved whole between executors."""
    kept = [f for f in rows_.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("body", T.BinaryType())])

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        bodies = [pack((t or "").encode("utf-8")) for t in batch.column(len(kept)).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(kept)], pa.array(bodies, pa.binary())], names=schema.names
        )

    return map_batches(rows_.select(*(f.name for f in kept), "text"), rows, schema)


def unpack(body: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(body).decode("utf-8")


def _ranges(keys: DataFrame, n: int) -> DataFrame:
    """One row: ``firsts``, the (doc_id, tie) at which each of at most ``n`` ranges of the order
    begins, in order and in blocks of about their square root, so that few are compared per row.

    Written, as a range partitioning that is planned again may cut elsewhere.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = keys.repartitionByRange(n, *order).groupBy(F.spark_partition_id().alias("part"))
    # The greatest struct has the greatest id, nulls last, and of these the least tie.
    first = dealt.agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"))).alias("first"))
    begin = lambda f: F.struct(f["doc_id"], F.bitwise_not(f["tie"]).alias("tie"))
    width = F.ceil(F.sqrt(F.size("firsts"))).cast("int")
    starts = F.when(F.size("firsts") > 0, F.sequence(F.lit(1), F.size("firsts"), width))
    one = (
        first.agg(F.reverse(F.array_sort(F.collect_list("first"))).alias("firsts"))
        .withColumn("firsts", F.transform("firsts", begin))
        .select(F.transform(starts, lambda i: F.slice("firsts", i, width)).alias("firsts"))
    )
    path = fresh_path(keys.sparkSession, "ranges")
    one.write.option("compression", "zstd").parquet(path)
    return keys.sparkSession.read.schema(one.schema).parquet(path)


def _dealt(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, tie, part, follows, body): every row with the number of its range, and the first
    row of each range a second time, as the one that follows the range before (the last, before the first)."""
    text = F.col(text_col).cast("string")
    keys = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"))
    same_id = lambda b: b["doc_id"].eqNullSafe(F.col("doc_id"))
    begun = lambda b: (
        F.coalesce(b["doc_id"] > F.col("doc_id"), b["doc_id"].isNotNull() & F.col("doc_id").isNull())
        | (same_id(b) & (b["tie"] <= F.col("tie")))
    )
    width = F.size(F.get("firsts", F.lit(0)))
    ranges = width * (F.size("firsts") - 1) + F.size(F.element_at("firsts", -1))
    placed = (
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
        .crossJoin(F.broadcast(_ranges(keys, n)))
        .withColumn("nth", F.size(F.filter("firsts", lambda block: begun(block[0]))) - 1)
        .withColumn("block", F.get("firsts", F.col("nth")))
        .withColumn("at", F.size(F.filter("block", begun)) - 1)
        .withColumn("part", F.col("nth") * width + F.col("at"))
    )
    first = F.get("block", F.col("at"))
    heads = (
        placed.where(same_id(first) & (first["tie"] == F.col("tie")))
        .select("doc_id", "tie", "text", F.pmod(F.col("part") - 1, ranges).alias("part"))
        .dropDuplicates(["part"])
    )
    both = placed.select("doc_id", "tie", "text", "part", F.lit(False).alias("follows")).unionByName(
        heads.withColumn("follows", F.lit(True))
    )
    return _compressed(both)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    key = id_field(docs, id_col)
    schema = T.StructType([key, *(T.StructField(name, kind) for name, kind, _ in _RESULT)])
    arrow = [kind for _, _, kind in _RESULT]
    names = schema.names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, None
        for batch in batches:
            rows = []
            columns = (batch.column(i).to_pylist() for i in range(3))
            for doc, body, part in zip(*columns, strict=True):
                text = unpack(body)
                own = sketch(text)
                # The last row of a range is the one that follows, and has no row of its own here.
                if last is not None and of == part:
                    rows.append((last[0], *_compare(last[1], last[2], text, own)))
                last, of = (doc, text, own), part
            if rows:
                kinds = [batch.column(0).type, *arrow]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    # A range per task.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(docs, id_col, text_col, n).repartitionById(n, "part")
    order = [F.col("part"), F.col("follows"), F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ordered = dealt.sortWithinPartitions(*order).select("doc_id", "body", "part")
    return stream_batches(ordered, walk, schema)
