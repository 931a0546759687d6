"""Quality classifier: hashed word n-grams, logistic regression by FTRL updates.

A text is its runs of letters, digits and marks, in their case; a token equal to the
one before it becomes the repeat token, so that loops of any word look alike. Single
tokens and pairs are hashed to ``2 ** BITS`` features, weighted by the root of
their share. Training follows the regularised leader, once through the rows per epoch, in
``SHARDS`` shards by a hash of the id whose weights are averaged. Scores are sparse dot
products through the logistic function.

Training rows: labelled rows with a training id, at most ``MAX_ROWS`` of them, taken by
the order of a hash. That bounds the training; the model is bounded by
the number of features (2 MB), so it is gathered and handed to every task. All
documents are scored, whole.

Nulls: a null label is no label; a null text is empty and scored by the bias alone; a
null id is scored and not trained on. Repeated rows are scored each; an id with several
labels counts as its greatest. Without labels all weights are 0 and scores 0.5. Other
columns, language and source are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.llm.batches import id_field, map_batches, stream_batches

BITS = 18
SHARDS = 4
EPOCHS = 2
MAX_ROWS = 20_000
HELD_OUT_ONE_IN = 5
THRESHOLD = 0.3
BIAS = 1 << BITS  # the feature every text has

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]+|[\d_]")
_REPEAT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_codes: dict[str, int] = {}
_MAX_CODES = 500_000


def _code(token: str) -> int:
    code = _codes.get(token)
    if code is None:
        if len(_codes) >= _MAX_CODES:
            _codes.clear()
        code = _codes[token] = zlib.crc32(token.encode("utf-8"))
    return code


def _slots(codes: np.ndarray) -> np.ndarray:
    mixed = (codes ^ (codes >> np.uint64(29))) * _MIX
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their weights; the bias comes last."""
    tokens = _TOKEN.findall(text or "")
    codes = np.fromiter(map(_code, tokens), np.uint64, len(tokens))
    if len(codes) > 1:
        again = np.flatnonzero(codes[1:] == codes[:-1]) + 1
        codes[again] = _REPEAT
    pairs = (codes[:-1] * _MIX + codes[1:]) * _REPEAT
    slots, counts = np.unique(np.concatenate([_slots(codes), _slots(pairs)]), return_counts=True)
    weights = np.sqrt(counts / max(1, len(tokens)))
    return np.append(slots, BIAS), np.append(weights, 1.0)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = (logistic(float(w @ x)) - label) * x
        more = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange(BIAS + 1))


def logistic(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0))))


def score(text: str | None, weights: np.ndarray) -> float:
    at, x = features(text)
    return logistic(float(weights[at] @ x))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % HELD_OUT_ONE_IN == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(shard, turn, label, text): the sample in the order it is learnt in, once per epoch."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .withColumn("turn", F.xxhash64("doc_id"))
        .orderBy("turn", "doc_id")
        .limit(max_rows)
    )
    # At most max_rows ids and numbers: a bounded broadcast.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    dealt = joined.select(
        F.pmod("turn", F.lit(SHARDS)).cast("int").alias("shard"), "turn", "label", "text"
    )
    keys = F.array(*map(F.lit, partition_keys(docs.sparkSession, SHARDS)))
    # A text crosses the exchange once; its epochs are made behind it.
    return dealt.repartition(SHARDS, F.get(keys, F.col("shard"))).select(
        "shard", F.explode(F.array(*map(F.lit, range(EPOCHS)))).alias("epoch"), "turn", "label", "text"
    )


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` partitions that Spark's hash deals to that one."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    rows = spark.range(64 * n).groupBy(at.alias("at")).agg(F.min("id").alias("key")).collect()
    found = {r["at"]: r["key"] for r in rows}
    return [found[i] for i in range(n)]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """The averaged weights. One task per shard holds one model and one batch of rows."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now = None, None

        def result() -> pa.RecordBatch:
            weights = model.all_weights()
            at = np.flatnonzero(weights)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()).take(pa.array(np.zeros(len(at), np.int32))),
                 pa.array(at, pa.int64()), pa.array(weights[at], pa.float64())],
                names=["shard", "slot", "weight"],
            )

        for batch in batches:
            shards, marks, texts = (batch.column(i).to_pylist() for i in range(3))
            for shard, label, text in zip(shards, marks, texts, strict=True):
                if shard != now:
                    if model:
                        yield result()
                    model, now = Ftrl(), shard
                model.update(*features(text), label)
        if model:
            yield result()

    rows = (
        training_rows(docs, labels, max_rows)
        .sortWithinPartitions("shard", "epoch", "turn", "text")
        .select("shard", "label", "text")
    )
    models = stream_batches(rows, learn, "shard int, slot long, weight double")
    mean = models.groupBy("slot").agg((F.sum("weight") / SHARDS).alias("weight"))
    weights = np.zeros(BIAS + 1)
    for slot, weight in mean.collect():  # at most 2 ** BITS + 1 rows
        weights[slot] = weight
    return weights


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    schema = T.StructType(
        [
            id_field(docs, "doc_id"),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )
    small = weights.astype(np.float32)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [score(t, small) for t in batch.column(2).to_pylist()]
        marks = [int(s >= THRESHOLD) for s in scores]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(marks, pa.int32())],
            names=schema.names,
        )

    text = F.col("text").cast("string")
    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")), text), rows, schema)
