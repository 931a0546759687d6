from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from log_rows import at  # noqa: E402

from logclew.schema import ATOMS, COMMITS, LOGS  # noqa: E402
from logclew.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("logclew-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)
    session.stop()


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "number"
    return "string"


@pytest.fixture(scope="session")
def make_logs(spark):
    """Log rows from dicts; ``raw`` values are Python scalars or (text, kind) pairs."""

    def make(rows):
        out = []
        for i, row in enumerate(rows):
            raw, kinds = {}, {}
            for key, value in row.get("raw", {}).items():
                if isinstance(value, tuple):
                    raw[key], kinds[key] = value
                else:
                    raw[key] = None if value is None else str(value)
                    kinds[key] = kind_of(value)
            out.append(
                (
                    row.get("row_ord", i),
                    at(row.get("timestamp", "2026-05-22T00:00:00Z")),
                    row.get("level", "info"),
                    row.get("message", "x"),
                    row.get("source", "test"),
                    list(raw),
                    list(raw.values()),
                    list(kinds.values()),
                )
            )
        # A Python dict would reach Spark with its keys in another order.
        schema = (
            "row_ord bigint, timestamp timestamp, level string, message string, source string, "
            "keys array<string>, texts array<string>, kinds array<string>"
        )
        df = spark.createDataFrame(out, schema).withColumns(
            {
                "raw": F.map_from_arrays("keys", "texts"),
                "raw_kind": F.map_from_arrays("keys", "kinds"),
            }
        )
        return df.select(*LOGS.fieldNames())

    return make


@pytest.fixture(scope="session")
def make_commits(spark):
    def make(*commits):
        rows = [
            (i, f"{i:040x}", f"{i:040x}"[:7], "Test", at(time), subject)
            for i, (time, subject) in enumerate(commits)
        ]
        return spark.createDataFrame(rows, COMMITS)

    return make


@pytest.fixture(scope="session")
def make_atoms(spark):
    def make(*atoms):
        rows = [
            (i, f"a-{i}", at("2026-05-22T00:00:00Z"), message, tags)
            for i, (message, tags) in enumerate(atoms)
        ]
        return spark.createDataFrame(rows, ATOMS)

    return make
