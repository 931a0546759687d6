import pytest
from pyspark.sql import functions as F

from logclew.functions.timestamps import parse_timestamp
from logclew.operators.normalize import (
    canonical_level,
    column_types,
    preview,
    rowset_meta,
)
from logclew.sources import read_logs


@pytest.mark.parametrize(
    "value, level",
    [
        ("CRITICAL", "critical"), ("Fatal error", "critical"), ("emergency", "critical"),
        ("Error", "error"), ("ERR", "error"), ("severe", "error"), ("stderr", "error"),
        ("WARNING", "warn"), ("Information", "info"), ("notice", "info"), ("Debug", "debug"),
        ("trace", "debug"), ("Verbose", "debug"), ("0", "info"), ("1", "warn"), ("2", "error"),
        ("3", "critical"), ("4", "4"), ("Custom", "Custom"), ("", "info"), (None, "info"),
    ],
)
def test_levels(spark, value, level):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(canonical_level(F.col("v"))).first()[0] == level


@pytest.mark.parametrize(
    "text, iso",
    [
        ("2026-05-22T00:00:00Z", "2026-05-22 00:00:00"),
        ("2026-05-22T02:00:00+02:00", "2026-05-22 00:00:00"),
        ("2026-05-22 00:00:00.1239", "2026-05-22 00:00:00.123"),
        ("2026-05-22T00:00:00.1234567Z", "2026-05-22 00:00:00.123"),
        ("2026-05-22", "2026-05-22 00:00:00"),
        ("2026-05", "2026-05-01 00:00:00"),
        ("2026", "2026-01-01 00:00:00"),
        ("12:30", None), ("T12:30", None), ("not a date", None), ("", None), ("1700000000", None),
        ("2026-02-30", None), ("2026-05-22T25:00:00Z", None),
    ],
)
def test_timestamps(spark, text, iso):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(parse_timestamp(F.col("v")).cast("string")).first()[0] == iso


def test_extra_timestamp_formats(spark):
    df = spark.createDataFrame([("22/05/2026 01:02",)], "v string")
    parsed = parse_timestamp(F.col("v"), ("dd/MM/yyyy HH:mm",)).cast("string")
    assert df.select(parsed).first()[0] == "2026-05-22 01:02:00"


def types(logs):
    rows = column_types(logs).orderBy("first_ord", "first_pos").collect()
    return [(r["name"], r["type"]) for r in rows]


def test_column_types(make_logs):
    logs = make_logs(
        [
            {"raw": {"n": 1, "s": "12", "year": "2024", "d": "2024-01-01", "mix": "a", "e": ""}},
            {"raw": {"n": None, "s": "-1.5", "year": "", "d": None, "mix": 2, "e": None, "b": True}},
            {"raw": {"late": ("{}", "object"), "n": 2, "d": "2024-01-02T03:04:05Z", "s": "7"}},
        ]
    )
    assert types(logs) == [
        ("n", "number"), ("s", "number"), ("year", "number"), ("d", "datetime"), ("mix", "dynamic"),
        ("e", "string"), ("b", "dynamic"), ("late", "dynamic"),
    ]


def test_number_pattern_is_strict(make_logs):
    assert types(make_logs([{"raw": {"a": "1\n"}}]))[0][1] == "string"
    assert types(make_logs([{"raw": {"a": ".5"}}]))[0][1] == "string"


def test_meta_and_preview(make_logs):
    epoch = "1970-01-01T00:00:00Z"
    logs = make_logs(
        [{"row_ord": 2000 - i, "message": f"m{i}"} for i in range(1002)]
        + [{"row_ord": 996 + i, "timestamp": epoch, "raw": raw} for i, raw in enumerate(
            ({}, {"timestamp": "soon"}, {"timestamp": epoch}))]
    )
    meta = rowset_meta(logs, "csv").first()
    assert (meta["source"], meta["row_count"], meta["unreadable_times"]) == ("csv", 1005, 2)
    shown = preview(logs)
    assert shown.count() == 50
    assert shown.agg(F.max("row_ord")).first()[0] == 996 + 49


def test_field_order_and_empty_string(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(
        '[{"level":"","severityLevel":2,"Message":"M","message":"m","source":"","service":"s"},'
        '{"type":"warn","name":"n","Category":"c"},{"level":null,"Level":"fatal"}]'
    )
    rows = read_logs(spark, "json", str(path)).orderBy("row_ord").collect()
    assert [(r["level"], r["message"], r["source"]) for r in rows] == [
        ("info", "m", ""), ("warn", "n", "c"), ("critical", "", "unknown"),
    ]
    assert rows[0]["timestamp"].timestamp() == 0
