"""Power-of-two decomposition: documents are cut into pieces of binary lengths.

A document of n tokens gives as many whole sequences as fit and one piece for each
binary digit of the rest, longest first. Pieces of one length fill sequences of that
length, so no sequence crosses documents and none is padded. Sequences of a length
are numbered from 0 without gaps and batched by their numbers.

Nulls: a null text is empty and gives only the end token; a null id stays null.
Repeated rows are packed each. Long texts are tokenised whole. Other columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.llm.batches import id_field, map_batches, number_rows
from logclew.llm.tokens import word_store

MAX_TOKENS = 4096
END_ID = 2


def binary_pieces(tokens: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document, lengths powers of two."""
    start, length = 0, longest
    while length:
        while tokens - start >= length:
            yield start, length
            start += length
        length //= 2


def cut_documents(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = MAX_TOKENS,
    end_id: int = END_ID,
    with_ids: bool = False,
    specials_as_text: bool = False,
) -> DataFrame:
    """One row per piece: where it starts, its length, a checksum of its ids, and,
    if asked for, the ids. ``specials_as_text`` is told in ``word_store``."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence is a power of two")
    schema = T.StructType(
        [
            id_field(docs, id_col),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            *([T.StructField("ids", T.BinaryType())] if with_ids else []),
        ]
    )
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        store = word_store(vocabulary, specials_as_text)
        at, starts, lengths, sums, totals, kept = [], [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            ids = b"".join(map(store.__getitem__, (text or "").encode("utf-8").split())) + end
            tokens, view = len(ids) // 4, memoryview(ids)
            for start, length in binary_pieces(tokens, longest):
                piece = view[4 * start : 4 * (start + length)]
                at.append(row)
                starts.append(start)
                lengths.append(length)
                sums.append(zlib.crc32(piece))
                totals.append(tokens)
                if with_ids:
                    kept.append(bytes(piece))
        numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
        columns = [batch.column(0).take(pa.array(at, pa.int32())), *numbers]
        if with_ids:
            columns.append(pa.array(kept, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), cut, schema)


def pack_documents(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """The pieces with their sequences: ``sequence_id`` is the number among sequences of
    that length times 64, plus the length's binary exponent. ``offset`` is 0, as each
    sequence holds one piece."""
    numbered = number_rows(cut_documents(docs, vocabulary, **options), "length", "pieces", "_n")
    exponent = F.round(F.log2(F.col("length").cast("double"))).cast("long")
    return numbered.withColumns(
        {"sequence_id": F.col("_n") * 64 + exponent, "offset": F.lit(0).cast("long")}
    ).drop("_n")


def batches_of(packed: DataFrame, batch_tokens: int) -> DataFrame:
    """``packed`` with ``batch``: sequences of one length, ``batch_tokens`` tokens together."""
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))
    return packed.withColumn("batch", F.floor(F.floor(F.col("sequence_id") / 64) / per_batch))
