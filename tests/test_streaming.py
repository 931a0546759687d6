import json

from pyspark.sql import functions as F

from logclew.schema import JoinPolicy
from logclew.streaming.ingest import stream_json_lines, stream_redacted


def test_stream_appends_redacted_rows_once(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()

    def arrive(name, *rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        query = stream_redacted(
            stream_json_lines(spark, str(source)), JoinPolicy(r"T-\d+"), str(out), str(state)
        )
        query.awaitTermination()
        return spark.read.parquet(str(out))

    assert arrive("a.json", {"message": "T-1 from a@b.co", "level": "ERR"}, {"message": "none"}).count() == 2
    rows = arrive("b.json", {"message": "late", "ip": "10.0.0.1"}, 7).orderBy("message").collect()
    assert [(r["message"], r["level"], r["matched"]) for r in rows] == [
        ("T-1 from [REDACTED:email]", "error", True), ("late", "info", False), ("none", "info", False),
    ]
    assert rows[1]["raw"]["ip"] == "[REDACTED:ipv4]"
    assert spark.read.parquet(str(out)).where(F.col("message").contains("@")).count() == 0
