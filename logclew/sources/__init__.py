"""Readers that turn log exports into log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logclew.sources.delimited import read_csv_logs
from logclew.sources.json import read_json_logs
from logclew.sources.tabular import read_tabular_logs

_READERS = {
    "csv": read_csv_logs,
    "json": read_json_logs,
    "tabular-json": read_tabular_logs,
}


def read_logs(spark: SparkSession, source: str, path: str, **options) -> DataFrame:
    """Log rows from ``path`` in the named format."""
    if source not in _READERS:
        raise ValueError(f"unknown source {source!r}; choose from {sorted(_READERS)}")
    return _READERS[source](spark, path, **options)
