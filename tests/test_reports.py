"""Reports on disk, the status log and the schema file."""

import json

from colloquy import rules
from colloquy.operators import reports as rp
from colloquy.sources import replies as rs
from colloquy.sources import results as sr
from colloquy.streaming.flows import stream_job_status


def test_markdown_lines_are_written_in_order(spark, tmp_path):
    summaries = spark.createDataFrame([(1, "All fine."), (2, None)], "meeting_id long, summary string")
    decisions = spark.createDataFrame(
        [(1, 7, "We wait", "Wait", ["Ann"], 0.8), (1, 3, "We go", "Go", [], 0.5)],
        "meeting_id long, item_id long, text string, title string, participants array<string>, confidence double",
    )
    actions = spark.createDataFrame(
        [(1, 1, "send it", "Unclear", None, "high", 0.85), (1, 2, "write it", "Bob", "Friday", "medium", 0.85)],
        "meeting_id long, item_id long, action string, owner string, due_date string, priority string, confidence double",
    )
    risks = spark.createDataFrame(
        [(1, 1, "late", "Unknown", "LOW", 0.4), (1, 2, "broken", "Ann", "HIGH", 0.9)],
        "meeting_id long, item_id long, risk string, mentioned_by string, priority string, confidence double",
    )
    rp.write_lines(rp.markdown_report(summaries, decisions, actions, risks).coalesce(1), str(tmp_path / "md"))
    lines = "\n".join(p.read_text() for p in sorted((tmp_path / "md" / "meeting_id=1").glob("part-*"))).split("\n")
    wanted = [
        "# Meeting Report", "All fine.", "1. **Go**: We go", "2. **Wait**: We wait", "   - Participants: Ann", "### Bob",
        "1. **write it**", "   - Due: Friday", "### Unassigned", "1. **send it**", "   - Priority: HIGH", "1. broken (HIGH PRIORITY)", "2. late (LOW PRIORITY)",
    ]
    places = [lines.index(w) for w in wanted]
    assert places == sorted(places)
    assert "No summary available." in "".join(p.read_text() for p in (tmp_path / "md" / "meeting_id=2").glob("part-*"))


def test_status_log_and_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 1, "queued"), (1, 2, "done"), (2, 1, "queued")], "job_id long, ts long, status string")
    sr.append_job_status(rows.filter("ts = 1"), path)
    sr.append_job_status(rows.filter("ts = 2"), path)
    want = {(1, "done"), (2, "queued")}
    assert {(r.job_id, r.status) for r in sr.latest_status(spark.read.parquet(path)).collect()} == want
    stream = stream_job_status(spark.readStream.schema(rows.schema).parquet(path))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("job_states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {(r.job_id, r.status) for r in spark.table("job_states").collect()} == want


def test_schema_file(spark, tmp_path):
    nested = {}
    for component, criterion, weight in rules.EVAL_SCHEMA:
        nested.setdefault(component, {"weights": {}})["weights"][criterion] = weight
    (tmp_path / "s.json").write_text(json.dumps({"components": nested}, indent=2))
    assert {tuple(r) for r in rs.load_eval_schema(spark, str(tmp_path / "s.json")).collect()} == set(rules.EVAL_SCHEMA)
