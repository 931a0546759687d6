from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logclew.operators.report import escape_cells, linked_tickets, raw_preview
from logclew.plans.bundle import redact_findings, write_bundle
from logclew.plans.correlate import correlate
from logclew.schema import JoinPolicy


@pytest.mark.parametrize(
    "base, link",
    [
        ("https://x.example.com/browse", "https://x.example.com/browse/A%2F%26%25%20b!'()~*"),
        ("https://x.example.com/browse/", "https://x.example.com/browse/A%2F%26%25%20b!'()~*"),
        ("https://X.example.com", "https://x.example.com/A%2F%26%25%20b!'()~*"),
        ("https://x.example.com/t?p=1", "https://x.example.com/t/A%2F%26%25%20b!'()~*?p=1"),
        (None, None),
    ],
)
def test_ticket_links(spark, base, link):
    tickets = spark.createDataFrame([("g", "A/&% b!'()~*"), ("h", "A/&% b!'()~*")], "group_key string, ticket string")
    assert [tuple(r) for r in linked_tickets(tickets, base).collect()] == [("A/&% b!'()~*", link)]


def test_tickets_are_distinct(spark):
    tickets = spark.createDataFrame([("g", t) for t in ("b", "a", "B", "b")], "group_key string, ticket string")
    assert sorted(r["ticket"] for r in linked_tickets(tickets).collect()) == ["B", "a", "b"]


@pytest.mark.parametrize("base", ["http://x.example.com", "not a url", "https://"])
def test_links_need_https(spark, base):
    tickets = spark.createDataFrame([("g", "t")], "group_key string, ticket string")
    with pytest.raises(ValueError, match="https"):
        linked_tickets(tickets, base)


def test_raw_preview_order_and_escape(make_logs, make_commits):
    logs = make_logs(
        [
            {"message": "left | right"},
            {"message": "b1", "raw": {"operation_Id": "b"}},
            {"message": "a1", "raw": {"operation_Id": "a"}},
            {"message": "b2", "raw": {"operation_Id": "b"}},
            {"message": "|" * 150},
        ]
    )
    found = correlate(logs, make_commits(), JoinPolicy())
    shown = escape_cells(raw_preview(found.keys, found.logs)).collect()
    assert [r["message"] for r in shown] == ["b1", "b2", "a1", "left \\| right", "\\|" * 150]
    assert [r["message"] for r in raw_preview(found.keys, found.logs, 2).collect()] == ["b1", "b2"]
    assert [r["message"] for r in raw_preview(found.keys, found.logs, 3).collect()] == ["b1", "b2", "a1"]


def test_group_report(make_logs, make_commits, make_atoms):
    logs = make_logs(
        [{"message": "T-1 T-2 T-3 T-4", "raw": {"operation_Id": "a"}}, {"message": "T-1"}, {"raw": {"operation_Id": "z"},
          "timestamp": "2020-01-01T00:00:00Z"}]
    )
    commits = make_commits(("2026-05-22T00:01:00Z", "x"), ("2026-05-01T00:00:00Z", "T-1"))
    found = correlate(logs, commits, JoinPolicy(r"T-\d"), make_atoms(("n T-1", [])))
    rows = redact_findings(found).table("group_report").drop("group_id").orderBy("first_ord").collect()
    assert [tuple(r) for r in rows] == [
        ("operationId=a", 1, 0, 2, 4, 1),
        ("tickets T-1", 1, 1, 1, 1, 1),
        ("operationId=z", 1, 2, 0, 0, 0),
    ]
    details = found.group_commits.where("group_key = 'tickets:T-1'").first()
    assert (details["short_sha"], details["subject"], details["author"]) == ("0000000", "T-1", "Test")
    assert found.group_atoms.where(F.col("group_key") == "op:a").first()["id"] == "a-0"


def test_links_are_written_by_commit_and_group(make_logs, make_commits, make_atoms, tmp_path):
    """Every group is near every commit and note; an order is kept in which files are small."""
    logs = make_logs([{"raw": {"operation_Id": f"g{i}"}, "message": "T-1"} for i in range(40)])
    commits = make_commits(*[("2026-05-22T00:01:00Z", f"change {i}") for i in range(50)])
    atoms = make_atoms(*[(f"note {i} on T-1", []) for i in range(50)])
    found = correlate(logs, commits, JoinPolicy(r"T-\d"), atoms, staged=True)
    folder = Path(write_bundle(redact_findings(found), str(tmp_path / "out"), ("parquet",)))
    spark = found.keyed.sparkSession
    for name, ordinal, staged in (
        ("group_commits", "commit_ord", found.commit_links),
        ("group_atoms", "atom_ord", found.atom_links),
    ):
        seen = []
        for file in staged.inputFiles():
            rows = spark.read.parquet(file).collect()
            assert [r[ordinal] for r in rows] == sorted(r[ordinal] for r in rows)
            seen += {r["group_key"] for r in rows}
        assert len(seen) == len(set(seen)) == 40
        written = folder / "parquet" / name
        assert spark.read.parquet(str(written)).distinct().count() == 40 * 50
        assert all(".zstd." in f.name for f in written.glob("*.parquet"))
