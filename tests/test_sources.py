import json
import random

import pytest
from pyspark.sql import functions as F

from logclew.operators.normalize import column_types
from logclew.sources import read_logs
from logclew.sources.commits import read_commit_log, recent_commits
from logclew.sources.tables import read_atoms, time_bounded


@pytest.fixture
def read(spark, tmp_path):
    def run(source, text, **options):
        path = tmp_path / "export"
        path.write_bytes(text.encode())
        logs = read_logs(spark, source, str(path), **options)
        return logs.withColumn("keys", F.map_keys("raw")).orderBy("row_ord").collect()

    return run


@pytest.mark.parametrize("eol", ["\n", "\r\n", "\r"])
def test_csv(read, eol):
    rows = read(
        "csv",
        eol.join(
            [
                "timestamp,level,message,source",
                '2026-05-22T00:00:00Z,error,"he said ""hi"", twice",Shop.Cards',
                "",
                "2026-05-22T00:01:00Z,info,short",
                "2026-05-22T00:02:00Z,info,long,src,extra,cells",
                ",,,",
            ]
        ),
    )
    assert [r["row_ord"] for r in rows] == [0, 1, 2, 3]
    assert [(r["level"], r["message"], r["source"]) for r in rows] == [
        ("error", 'he said "hi", twice', "Shop.Cards"),
        ("info", "short", ""),
        ("info", "long", "src"),
        ("info", "", ""),
    ]


def test_csv_line_break_in_cell(read):
    rows = read("csv", 'timestamp,message\n2026-05-22T00:00:00Z,"line1\nline2"\n')
    assert [r["message"] for r in rows] == ["line1\nline2"]


def test_csv_headers_by_case_and_repeated(read):
    rows = read("csv", "Level,level,a,a\nfatal,warn,1,2\nfatal,warn,3\n")
    assert [r["level"] for r in rows] == ["warn", "warn"]
    assert rows[0]["raw"] == {"Level": "fatal", "level": "warn", "a": "2"}
    assert rows[1]["raw"]["a"] == ""


def test_csv_splittable(read):
    assert len(read("csv", "message\na\nb\n", multiline=False)) == 2


def test_csv_mixed_line_ends(read):
    rows = read("csv", 'message,source\r\na,"x\r\ny"\nb,z\rc,\n')
    assert [(r["message"], r["source"]) for r in rows] == [("a", "x\ny"), ("b", "z"), ("c", "")]


def test_csv_no_source_column(read):
    assert read("csv", "message\nhi\n")[0]["source"] == "unknown"


@pytest.mark.parametrize("text", ["", "a,b\n"])
def test_csv_without_rows(read, text):
    assert read("csv", text) == []


def test_json_mixed_array(read):
    rows = read(
        "json",
        '[{"b":{"x":[1,"q"]},"a":1,"a":2,"n":null,"t":true,"f":1.5,"message":"m"},'
        ' 3, "s", "{\\"k\\":1}", [1], null, {"message":"last"}]',
    )
    assert [r["row_ord"] for r in rows] == [0, 1]
    assert rows[0]["keys"] == ["b", "a", "n", "t", "f", "message"]
    assert rows[0]["raw"] == {
        "b": '{"x":[1,"q"]}', "a": "2", "n": None, "t": "true", "f": "1.5", "message": "m",
    }
    assert rows[0]["raw_kind"] == {
        "b": "object", "a": "number", "n": "null", "t": "boolean", "f": "number", "message": "string",
    }


@pytest.mark.parametrize(
    "text, n", [("", 0), ("  \n", 0), ("42", 0), ('"x"', 0), ("[]", 0), (' \n{"message":"m"}', 1)]
)
def test_json_other_roots(read, text, n):
    assert len(read("json", text)) == n


@pytest.mark.parametrize("text", ["[1,", "nope", '{"a":'])
def test_bad_json_is_an_error(read, text):
    with pytest.raises(Exception, match="(?i)malformed"):
        read("json", text)


def test_json_per_line(read):
    rows = read("json", '{"message":"a"}\n\n[{"message":"b"},{"message":"c"}]\n7\n', per_line=True)
    assert [r["message"] for r in rows] == ["a", "b", "c"]


TABULAR = {
    "tables": [
        {
            "name": "PrimaryResult",
            "columns": [
                {"name": "TimeGenerated", "type": "datetime"},
                {"name": "Message", "type": "string"},
                {"name": "SeverityLevel", "type": "int"},
                {"name": "Message", "type": "string"},
            ],
            "rows": [
                ["2026-05-22T13:58:00Z", "first", 3, "last", "extra"],
                ["2026-05-22T13:59:12Z", "only", 1],
            ],
        },
        {"name": "no columns", "rows": [[1]]},
        {"name": "no rows", "columns": [{"name": "x"}]},
        {"name": "Second", "columns": [{"name": "Message"}], "rows": [["two"], [{"k": [1]}]]},
    ]
}


def test_tabular(read):
    rows = read("tabular-json", json.dumps(TABULAR))
    assert [(r["level"], r["message"]) for r in rows] == [
        ("critical", "last"), ("warn", ""), ("info", "two"), ("info", '{"k":[1]}'),
    ]
    assert rows[1]["raw_kind"]["Message"] == "null"
    assert rows[3]["raw_kind"]["Message"] == "object"


@pytest.mark.parametrize(
    "text, n", [('[{"Message":"x"}, 1]', 1), ("{}", 0), ('{"tables":5}', 0), ("7", 0), ("", 0)]
)
def test_tabular_other_shapes(read, text, n):
    assert len(read("tabular-json", text)) == n


def test_tabular_bad_json(read):
    with pytest.raises(Exception, match="(?i)malformed"):
        read("tabular-json", '{"tables":')


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        read_logs(spark, "xml", "/nowhere")


def test_types_see_json_kinds(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"z":1,"a":"2024-01-01","o":{}},{"z":"2","a":"x","o":null}]')
    rows = column_types(read_logs(spark, "json", str(path))).orderBy("first_ord", "first_pos")
    assert [(r["name"], r["type"]) for r in rows.collect()] == [
        ("z", "number"), ("a", "string"), ("o", "dynamic"),
    ]


def test_commit_log(spark, tmp_path):
    records = [
        "a" * 40 + "\x00Ann\x002026-05-22T02:00:00+02:00\x00fix: PROJ-42 | \"quoted\"",
        "\n" + "b" * 40 + "\x00Bob\x00no date\x00feat",
        "\nabc\x00Cid\x002026-05-22T00:00:00Z\x00short sha",
        "\n" + "c" * 40 + "\x00\x002026-05-22T00:00:00Z\x00no author",
        "\n" + "d" * 40 + "\x00Dee\x002026-05-22T00:00:00Z",
        "\n" + "e" * 40 + "\x00Eve\x002026-05-21T00:00:00Z\x00",
    ]
    path = tmp_path / "log"
    path.write_bytes("\x1e".join(records).encode() + b"\x1e")
    rows = read_commit_log(spark, str(path)).orderBy("commit_ord").collect()
    assert [(r["short_sha"], r["author"], r["subject"]) for r in rows] == [
        ("aaaaaaa", "Ann", 'fix: PROJ-42 | "quoted"'), ("bbbbbbb", "Bob", "feat"), ("eeeeeee", "Eve", ""),
    ]
    assert [r["authored_at"].strftime("%s") != "" for r in rows] == [True] * 3
    times = read_commit_log(spark, str(path)).orderBy("commit_ord")
    assert [r[0] for r in times.select(F.col("authored_at").cast("string")).collect()] == [
        "2026-05-22 00:00:00", "1970-01-01 00:00:00", "2026-05-21 00:00:00",
    ]


def test_recent_commits(make_commits):
    commits = make_commits(
        ("2026-05-01T00:00:00Z", "old"), ("2026-05-20T00:00:00Z", "b"), ("2026-05-22T00:00:00Z", "c")
    )
    as_of = F.lit("2026-05-23").cast("timestamp")
    assert {r["subject"] for r in recent_commits(commits, as_of).collect()} == {"old", "b", "c"}
    assert {r["subject"] for r in recent_commits(commits, as_of, 14).collect()} == {"b", "c"}
    assert [r["subject"] for r in recent_commits(commits, as_of, 30, 2).collect()] == ["c", "b"]
    earlier = F.lit("2026-05-21").cast("timestamp")
    assert [r["subject"] for r in recent_commits(commits, earlier, max_commits=1).collect()] == ["b"]
    many = make_commits(*[("2026-05-22T00:00:00Z", str(i)) for i in range(230)])
    assert recent_commits(many, as_of, 14, 999).count() == recent_commits(many, as_of).count() == 230
    with pytest.raises(ValueError):
        recent_commits(many, as_of, 0)


def test_atoms(spark, tmp_path):
    path = tmp_path / "atoms.json"
    path.write_text(
        '{"atom_ord":1,"id":"a","ts":"2026-05-22T00:00:00Z","message":"m","tags":["t"]}\n'
        '{"atom_ord":2,"id":"b","ts":"2026-05-22T00:00:00Z","message":"m"}\n'
    )
    assert [r["tags"] for r in read_atoms(spark, str(path)).orderBy("atom_ord").collect()] == [["t"], []]


def test_time_bounded_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    as_of = F.lit("2024-01-31").cast("timestamp")
    bounded = time_bounded(events, "ts", "event_id", as_of, 24, 5)
    assert bounded.count() == 5
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan
    early = F.lit("2024-01-10").cast("timestamp")
    assert time_bounded(events, "ts", "event_id", early).count() == events.where("ts <= '2024-01-10'").count()
    assert time_bounded(events, "ts", "event_id", as_of, 100_000, 20_000).count() == events.where("ts <= '2024-01-31'").count()
    with pytest.raises(ValueError):
        time_bounded(events, "ts", "event_id", as_of, 0)


def test_csv_files_with_unlike_headers_and_sizes(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("timestamp,message\n2026-05-22T00:00:00Z,first\n")
    many = "".join(f"m{i},2026-05-22T01:00:00Z,7\n" for i in range(2000))
    (folder / "b.csv").write_text("message,timestamp,extra\n" + many)
    (folder / "c.csv").write_text("timestamp,message\n2026-05-22T02:00:00Z,last\n")
    (folder / "d.csv").write_text("")
    for multiline in (True, False):
        rows = read_logs(spark, "csv", str(folder), multiline=multiline).orderBy("row_ord").collect()
        assert [r["row_ord"] for r in rows] == list(range(2002))
        assert [r["message"] for r in rows] == ["first", *[f"m{i}" for i in range(2000)], "last"]
        assert {str(r["timestamp"].minute) for r in rows} == {"0"} and rows[0]["timestamp"] < rows[1]["timestamp"]
        assert rows[0]["raw"].keys() == {"timestamp", "message"} and rows[5]["raw"]["extra"] == "7"


@pytest.mark.parametrize("source", ["json", "tabular-json"])
@pytest.mark.parametrize("split_bytes", ["128m", "16k"])
def test_order_over_files(spark, tmp_path, source, split_bytes):
    folder = tmp_path / "json"
    folder.mkdir()
    wrap = (lambda t: f'[{{"message":"{t}"}}]') if source == "json" else (
        lambda t: f'{{"tables":[{{"name":"T","columns":[{{"name":"Message","type":"s"}}],"rows":[["{t}"]]}}]}}')
    want = []
    for n, size in enumerate((1, 3000, 2)):
        names = [f"f{n}-{i}" for i in range(size)]
        want += names
        # In a tabular export every third document is a plain array.
        lines = [f'[{{"Message":"{t}"}}]' if i % 3 == 2 else wrap(t) for i, t in enumerate(names)]
        (folder / f"part-{n}").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    rows = read_logs(spark, source, str(folder), per_line=True).orderBy("row_ord").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_ord"] for r in rows] == list(range(3003))
    assert [r["message"] for r in rows] == want


def test_commit_order_over_files(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    want = []
    for n, size in enumerate((1, 2000)):
        subjects = [f"s{n}-{i}" for i in range(size)]
        want += subjects
        records = (f"{i:040x}\0me\x002026-05-22T00:00:00Z\0{s}" for i, s in enumerate(subjects))
        (folder / f"part-{n}").write_text("\x1e".join(records))
    rows = read_commit_log(spark, str(folder)).orderBy("commit_ord").collect()
    assert [(r["commit_ord"], r["subject"]) for r in rows] == list(enumerate(want))


# --- large files in splits -----------------------------------------------------


@pytest.fixture
def in_splits(spark):
    """Runs a reader with splits of a few hundred bytes."""

    def run(source, path, size="300", **options):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            logs = read_logs(spark, source, str(path), **options)
            return logs.withColumn("keys", F.map_keys("raw")).orderBy("row_ord").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")

    return run


def plain_csv(text):
    """Records of cells, character by character."""
    records, cells, cell, quoted, i = [], [], "", False, 0
    touched = False
    while i < len(text):
        ch = text[i]
        if ch == '"':
            touched = True
            if quoted and text[i + 1 : i + 2] == '"':
                cell += '"'
                i += 1
            else:
                quoted = not quoted
        elif not quoted and ch == ",":
            cells.append(cell)
            cell, touched = "", True
        elif not quoted and ch == "\n":
            if touched or cell or cells:
                records.append([*cells, cell])
            cells, cell, touched = [], "", False
        else:
            cell += ch
        i += 1
    if touched or cell or cells:
        records.append([*cells, cell])
    return records


def random_csv(rand, n):
    def cell():
        kind = rand.random()
        word = "".join(rand.choice("abc é,日\u001f\u001e") for _ in range(rand.randint(0, 8)))
        if kind < 0.2:
            return '"' + word + rand.choice(["\n", "\n\n", ",", '""', ""]) + word + '"'
        if kind < 0.3:
            return "x" + '"' + word + '"' + "y"
        return word.replace(",", "")

    lines = [",".join(cell() for _ in range(rand.randint(1, 5))) for _ in range(n)]
    return "message,b,c\n" + "".join(x + rand.choice(["\n", "\n", "\n\n"]) for x in lines)


@pytest.mark.parametrize("seed", [1, 2])
def test_csv_in_splits_equals_plain_reading(in_splits, tmp_path, seed):
    rand = random.Random(seed)
    folder = tmp_path / "csv"
    folder.mkdir()
    want = []
    for n in range(3):
        text = random_csv(rand, rand.choice([1, 40, 300]))
        if n == 1:
            # One cell over several splits.
            text += '"' + "long\ncell, " * 150 + '",1\nlast,2'
        (folder / f"f{n}").write_text(text)
        want += [(r + ["", "", ""])[:3] for r in plain_csv(text)[1:]]
    rows = in_splits("csv", folder)
    assert [r["row_ord"] for r in rows] == list(range(len(want)))
    assert [[r["raw"][k] for k in ("message", "b", "c")] for r in rows] == want


def test_csv_quotes_anywhere(read):
    rows = read("csv", 'message,b\nab"c,d"e,2\n"x""y",""\na""b,"""q"""\n""""\n"open\n')
    assert [(r["raw"]["message"], r["raw"]["b"]) for r in rows] == [
        ("abc,de", "2"), ('x"y', ""), ("ab", '"q"'), ('"', ""), ("open", ""),
    ]


def test_csv_header_over_two_lines(read):
    rows = read("csv", '﻿"mess""age\nof a row",message\r\n1,two\r\n')
    assert rows[0]["raw"] == {'mess"age\nof a row': "1", "message": "two"}


def random_value(rand, depth=0):
    kind = rand.random()
    if kind < 0.3 and depth < 3:
        return {rand.choice("abcd"): random_value(rand, depth + 1) for _ in range(rand.randint(0, 3))}
    if kind < 0.45 and depth < 3:
        return [random_value(rand, depth + 1) for _ in range(rand.randint(0, 3))]
    return rand.choice([1, "x}]", 'q"}{', "\\", "\\\"[", None, True, "é日"])


def same_json(texts, values):
    return [json.loads(t) for t in texts] == values


@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_in_splits_equals_plain_reading(in_splits, tmp_path, indent):
    rand = random.Random(7)
    folder = tmp_path / "json"
    folder.mkdir()
    want = []
    for n, size in enumerate((0, 1, 200, 60)):
        values = [random_value(rand) if rand.random() < 0.2 else {"message": f"{n}-{i}", "v": random_value(rand)}
                  for i in range(size)]
        (folder / f"f{n}").write_text(" \n" + json.dumps(values, indent=indent, ensure_ascii=bool(n % 2)))
        want += [v for v in values if isinstance(v, dict)]
    (folder / "g").write_text('{"message":"alone","v":{"k":[1,{"m":2}]}}')
    (folder / "h").write_text("[3]")
    want.append({"message": "alone", "v": {"k": [1, {"m": 2}]}})
    rows = in_splits("json", folder)
    assert [r["row_ord"] for r in rows] == list(range(len(want)))
    assert [set(r["keys"]) for r in rows] == [set(v) for v in want]
    assert [r["message"] for r in rows if "message" in r["keys"]] == [v["message"] for v in want if "message" in v]
    nested = [(r["raw"]["v"], v["v"]) for r, v in zip(rows, want) if isinstance(v.get("v"), (dict, list))]
    assert same_json([t for t, _ in nested], [v for _, v in nested])


@pytest.mark.parametrize(
    "text",
    ['[{"a":1}', '[{"a":1},{"b":2', '[{"a":1}{"b":2}]', '[{"a":1},]', '[{"a":1},,{"b":2}]', '[,{"a":1}]', '{"a":1', '[{"a":1},{"b":]'],
)
def test_broken_arrays_are_errors(read, text):
    with pytest.raises(Exception, match="(?i)malformed"):
        read("json", text)


def test_tabular_in_splits_equals_plain_reading(in_splits, tmp_path):
    rand = random.Random(3)
    folder = tmp_path / "tabular"
    folder.mkdir()
    want = []
    for n in range(4):
        tables = []
        for t in range(rand.randint(1, 4)):
            names = [rand.choice(["Message", "b", "c"]) for _ in range(rand.randint(1, 3))]
            rows = [[random_value(rand, 2) for _ in range(rand.randint(0, 4))] for _ in range(rand.choice([0, 1, 90]))]
            columns = [{"name": c, "type": "x]["} for c in names]
            no_rows = [None, 5, "x"] if t % 2 else []
            table = {"name": f"T[{t}", "columns": columns, "rows": [*no_rows, *rows, *no_rows], "odd": [[[1], [2]]]}
            keys = list(table)
            rand.shuffle(keys)
            tables.append({k: table[k] for k in keys})
            want += [dict(zip(names, [*row, *[None] * 3])) for row in rows]
        tables.insert(1, {"name": "no columns", "rows": [[1], [2]]})
        (folder / f"f{n}").write_text(json.dumps({"meta": [[[[[5], [6]]]]], "tables": tables, "end": [[[[1]]]]}))
    (folder / "g").write_text('[{"Message":"of an array"}, 7]')
    want.append({"Message": "of an array"})
    rows = in_splits("tabular-json", folder)
    assert [r["row_ord"] for r in rows] == list(range(len(want)))
    assert [set(r["keys"]) for r in rows] == [set(w) for w in want]
    plain = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    for r, w in zip(rows, want):
        for k, v in w.items():
            if not isinstance(v, (dict, list)):
                assert r["raw"][k] == plain(v)
            else:
                assert json.loads(r["raw"][k]) == v


@pytest.mark.parametrize("source", ["csv", "json", "tabular-json"])
def test_large_file_is_read_by_many_tasks(spark, tmp_path, source):
    path = tmp_path / "one"
    n = 20_000
    if source == "csv":
        path.write_text("message,b\n" + "".join(f'm{i},"x\ny{i}"\n' for i in range(n)))
    elif source == "json":
        path.write_text(json.dumps([{"message": f"m{i}", "b": {"k": "}"}} for i in range(n)]))
    else:
        rows = [[f"m{i}", ["]"]] for i in range(n)]
        columns = [{"name": "message"}, {"name": "b"}]
        path.write_text(json.dumps({"tables": [{"name": "T", "columns": columns, "rows": rows}]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        logs = read_logs(spark, source, str(path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = logs.select("row_ord", "message").orderBy("row_ord").collect()
    assert [tuple(r) for r in rows] == [(i, f"m{i}") for i in range(n)]
    assert path.stat().st_size > 5 * 65_536


@pytest.mark.parametrize("source", ["csv", "json", "json-lines", "commits"])
def test_numbers_survive_other_splits(spark, tmp_path, source):
    """The frame is built under one split size and runs under another."""
    path = tmp_path / "export"
    if source == "csv":
        path.write_text("message\n" + "".join(f"m{i}\n" for i in range(9000)))
    elif source == "json":
        path.write_text(json.dumps([{"message": f"m{i}"} for i in range(9000)]))
    elif source == "json-lines":
        path.write_text("".join(json.dumps({"message": f"m{i}"}) + "\n" for i in range(9000)))
    else:
        path.write_text("\x1e".join(f"{i:040x}\0me\x002026-05-22T00:00:00Z\0m{i}" for i in range(9000)))
    if source == "commits":
        logs = read_commit_log(spark, str(path)).selectExpr("commit_ord AS row_ord", "subject AS message")
    elif source == "json-lines":
        logs = read_logs(spark, "json", str(path), per_line=True)
    else:
        logs = read_logs(spark, source, str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = logs.select("row_ord", "message").orderBy("row_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in rows] == [(i, f"m{i}") for i in range(9000)]
