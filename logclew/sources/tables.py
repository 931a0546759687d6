"""Log rows and notes that are already tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logclew.functions.rawmap import raw_of
from logclew.operators.normalize import shape_rows
from logclew.schema import ATOMS
from logclew.session import prepare


def logs_from_columns(
    records: DataFrame,
    fields: Mapping[str, tuple[Column, str]],
    row_ord: Column,
    extra_formats: tuple[str, ...] = (),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Log rows from a table; ``fields`` maps raw field names to (column, kind)."""
    raw, kind = raw_of(fields)
    return shape_rows(records, raw, kind, row_ord, extra_formats, keep)


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """External notes from JSON lines; a note without tags gets an empty list."""
    prepare(spark)
    return with_tags(spark.read.schema(ATOMS).json(path))


def with_tags(atoms: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return atoms.withColumn("tags", F.coalesce(F.col("tags"), empty))


def time_bounded(
    table: DataFrame,
    time_col: str,
    order_col: str,
    as_of: Column,
    hours: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows up to ``as_of``, of the last ``hours`` if given.

    ``limit`` asks for the newest so many, newest first; without it all are kept, in no
    order. The filters compare the stored column itself, so they reach the file scan.
    """
    for name, value in (("hours", hours), ("limit", limit)):
        if value is not None and value < 1:
            raise ValueError(f"{name} must be 1 or more")
    kind = table.schema[time_col].dataType
    out = table.where(F.col(time_col) <= as_of.cast(kind))
    if hours is not None:
        bound = as_of - F.make_dt_interval(hours=F.lit(hours))
        out = out.where(F.col(time_col) >= bound.cast(kind))
    if limit is None:
        return out
    return out.orderBy(F.col(time_col).desc(), order_col).limit(limit)
