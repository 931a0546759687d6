"""Arrow batches, free column names and row numbers shared by the operators here."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logclew.session import stage

# Rows per Arrow batch: whole texts travel in these, so a batch has to stay small
# even if every text in it is long.
BATCH_ROWS = 400
_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> None:
    """Small batches, and workers that find this package, for the plans made from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # Workers find this package where the driver did, even if not started from there.
    # (Where executors have other paths, ship it with --py-files.)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str
) -> DataFrame:
    """``df.mapInArrow`` with one output batch per input batch of at most ``BATCH_ROWS`` rows.

    Sets the session's Arrow batch size, which Spark reads when the plan runs.
    """
    return stream_batches(df, lambda batches: (fn(b) for b in batches if b.num_rows), schema)


def stream_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
) -> DataFrame:
    """As ``map_batches``, for functions that carry state from batch to batch of a partition."""
    ready(df.sparkSession)
    return df.mapInArrow(fn, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores in front until no column has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def id_field(df: DataFrame, id_col: str) -> T.StructField:
    return T.StructField("doc_id", df.schema[id_col].dataType, True)


def number_rows(df: DataFrame, key: str, name: str, as_name: str) -> DataFrame:
    """``df`` with ``as_name``: gapless numbers from 0 within ``key``, however large a key is.

    The rows are staged with the partition that wrote them. Within a key and
    partition they are ranked, and offsets by partition come from the counts, a
    table of keys times partitions. No task sees more of a key than one partition had.
    """
    part, seq = free_name(df, "_part"), free_name(df, "_seq")
    staged = stage(
        df.withColumns({part: F.spark_partition_id(), seq: F.monotonically_increasing_id()}), name
    )
    offsets = (
        staged.groupBy(key, part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy(part)) - F.col("_n"))
        .select(key, part, "_before")
    )
    rank = F.row_number().over(Window.partitionBy(key, part).orderBy(seq)) - 1
    return (
        staged.withColumn(as_name, rank.cast("long"))
        .join(offsets, [key, part])
        .withColumn(as_name, F.col(as_name) + F.col("_before"))
        .drop(part, seq, "_before")
    )


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))
