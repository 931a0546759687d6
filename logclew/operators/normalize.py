"""Raw records to the five-field log row, and facts about the row set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclew.functions.rawmap import pick
from logclew.functions.timestamps import epoch, parse_timestamp
from logclew.schema import PREVIEW_ROWS

# Candidate field names, tried in this order.
TIMESTAMP_KEYS = (
    "timestamp", "TimeGenerated", "time", "Time", "@timestamp", "ts", "eventTime", "EventTime",
)
LEVEL_KEYS = (
    "level", "severityLevel", "SeverityLevel", "Level", "severity", "Severity", "type",
)
MESSAGE_KEYS = ("message", "Message", "msg", "outerMessage", "name", "Name")
SOURCE_KEYS = (
    "source", "Source", "cloud_RoleName", "appName", "service", "category", "Category",
)

# Words that place a level, in order, and the numeric levels.
LEVEL_WORDS = (
    ("critical", ("crit", "fatal", "emerg")),
    ("error", ("err", "severe")),
    ("warn", ("warn",)),
    ("info", ("info", "notice")),
    ("debug", ("debug", "trace", "verbose")),
)
LEVEL_DIGITS = (("0", "info"), ("1", "warn"), ("2", "error"), ("3", "critical"))

DEFAULT_SOURCE = "unknown"


def log_timestamp(raw: Column, extra_formats: tuple[str, ...] = ()) -> Column:
    """Event time; the epoch when missing or unreadable (see ``time_known``)."""
    return F.coalesce(parse_timestamp(pick(raw, TIMESTAMP_KEYS), extra_formats), epoch())


def time_known(timestamp: Column, raw: Column, extra_formats: tuple[str, ...] = ()) -> Column:
    """False where ``timestamp`` is the epoch only because there was no readable time.

    The record is parsed again for rows at the epoch alone, with the formats it was read by.
    """
    written = parse_timestamp(pick(raw, TIMESTAMP_KEYS), extra_formats)
    read = F.coalesce(written == epoch(), F.lit(False))
    return F.when(timestamp == epoch(), read).otherwise(timestamp.isNotNull())


def canonical_level(value: Column) -> Column:
    """One of critical, error, warn, info, debug, or the value as it came."""
    lowered = F.lower(value)
    level = F.when(F.coalesce(value, F.lit("")) == "", "info")
    for name, words in LEVEL_WORDS:
        hit = lowered.contains(words[0])
        for word in words[1:]:
            hit = hit | lowered.contains(word)
        level = level.when(hit, name)
    for digit, name in LEVEL_DIGITS:
        level = level.when(value == digit, name)
    return level.otherwise(value)


def shape_rows(
    records: DataFrame,
    raw: Column,
    kind: Column,
    row_ord: Column,
    extra_formats: tuple[str, ...] = (),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Log rows (one narrow projection) from records with a raw and a kind map.

    ``row_ord`` is the order of arrival; every "first" in the library means the
    smallest ``row_ord``. ``keep`` carries extra columns through.
    """
    return records.select(
        row_ord.cast("bigint").alias("row_ord"),
        log_timestamp(raw, extra_formats).alias("timestamp"),
        canonical_level(pick(raw, LEVEL_KEYS)).alias("level"),
        F.coalesce(pick(raw, MESSAGE_KEYS), F.lit("")).alias("message"),
        F.coalesce(pick(raw, SOURCE_KEYS), F.lit(DEFAULT_SOURCE)).alias("source"),
        raw.alias("raw"),
        kind.alias("raw_kind"),
        *keep,
    )


def column_types(logs: DataFrame, extra_formats: tuple[str, ...] = ()) -> DataFrame:
    """``name, type, first_ord, first_pos`` for every raw key.

    One aggregate over (row, key) pairs. Its buffers are flags and numbers, so
    it hashes and combines map-side: what is shuffled is one row per key and
    task, however many log rows there are.
    """
    pairs = logs.select("row_ord", "raw_kind", F.posexplode("raw").alias("pos", "name", "value"))
    kind = F.col("raw_kind")[F.col("name")]
    value = F.col("value")
    filled = (kind != "null") & value.isNotNull() & (value != "")
    is_string = kind == "string"
    is_number = (kind == "number") | (is_string & value.rlike(r"^-?[0-9]+(?:\.[0-9]+)?\z"))
    is_date = (
        is_string & value.rlike("[-:T]") & parse_timestamp(value, extra_formats).isNotNull()
    )

    def all_filled(test: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(filled, test)), F.lit(True))

    facts = (
        pairs.where(kind.isNotNull())
        .groupBy("name")
        .agg(
            F.coalesce(F.bool_or(filled), F.lit(False)).alias("any_filled"),
            all_filled(is_number).alias("numbers"),
            all_filled(is_date).alias("dates"),
            all_filled(is_string).alias("strings"),
            F.min("row_ord").alias("first_ord"),
            F.min_by("pos", "row_ord").alias("first_pos"),
        )
    )
    column_type = (
        F.when(~F.col("any_filled"), "string")
        .when(F.col("numbers"), "number")
        .when(F.col("dates"), "datetime")
        .when(F.col("strings"), "string")
        .otherwise("dynamic")
    )
    return facts.select("name", column_type.alias("type"), "first_ord", "first_pos")


def preview(logs: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return logs.orderBy("row_ord").limit(rows)


def rowset_meta(logs: DataFrame, source: str, extra_formats: tuple[str, ...] = ()) -> DataFrame:
    """One row: source, number of rows, and of those without a readable time.

    ``logs`` are log rows, or their keys, which know already which times were readable.
    """
    if "time_known" in logs.columns:
        unknown = ~F.col("time_known")
    else:
        unknown = ~time_known(F.col("timestamp"), F.col("raw"), extra_formats)
    return logs.agg(
        F.lit(source).alias("source"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(unknown).alias("unreadable_times"),
    )
