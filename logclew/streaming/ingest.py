"""The row-wise steps on a stream: normalise, key, redact, append.

They keep no state, so a streaming query gives the same rows as a batch one and
resumes from its checkpoint after a lost executor or driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logclew.functions.redaction import DEFAULT_RULES
from logclew.operators.keys import row_keys
from logclew.operators.normalize import shape_rows
from logclew.operators.redact import redact_rows
from logclew.schema import JoinPolicy, RedactionRule
from logclew.session import prepare
from logclew.sources.json import object_records


def stream_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log rows from JSON-lines files as they arrive.

    A stream has no running row number; ``row_ord`` is a hash of the line.
    """
    prepare(spark)
    lines = spark.readStream.text(path).where(F.trim("value") != "")
    elements = lines.select(
        F.col("value").alias("text"),
        F.parse_json("value").alias("value"),
        F.xxhash64("value").alias("line_hash"),
    )
    records = object_records(elements, ("line_hash",))
    return shape_rows(records, F.col("raw"), F.col("raw_kind"), F.col("line_hash"))


def stream_redacted(
    logs: DataFrame,
    policy: JoinPolicy,
    out_dir: str,
    checkpoint_dir: str,
    rules: Sequence[RedactionRule] = DEFAULT_RULES,
) -> StreamingQuery:
    """Append redacted rows as Parquet; stops when the input is used up."""
    keyed = row_keys(logs, policy)
    is_matched = F.col("group_key").isNotNull().alias("matched")
    rows = redact_rows(
        keyed.select(
            is_matched, "timestamp", "level", "message", "source", "raw", "raw_kind"
        ),
        rules,
    )
    return (
        rows.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
