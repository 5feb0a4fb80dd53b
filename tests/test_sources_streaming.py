"""Files in and out, and streams that must equal the batch result."""

import json

from pyspark.sql import functions as F

from colloquy.operators import evaluation as ev
from colloquy.operators import extraction as ex
from colloquy.sources import results as sr
from colloquy.sources import transcripts as st
from colloquy.streaming import flows

TXT = "Title line\n\nStone, Bob (Lead)   0:03\nWe decided to wait.\nUntil Friday.\n\nAnn: I will send the full report by Friday.\n"
JSON = {"segments": [{"speaker": "Ann", "text": "There is a risk that the audit is late.", "timestamp": "00:01:00"}]}
SRT = "1\n00:00:01,000 --> 00:00:03,000\nAnn: hello all\n\n2\n00:00:04,000 --> 00:00:06,000\n[Bob] hi\n"


def write_files(folder):
    folder.mkdir(exist_ok=True)
    (folder / "a.txt").write_text(TXT)
    (folder / "b.json").write_text(json.dumps(JSON))
    (folder / "c.srt").write_text(SRT)
    (folder / "d.txt").write_text(SRT)
    (folder / "e.pdf").write_text("no")
    return str(folder)


def test_scan_route_parse(spark, tmp_path):
    files = st.scan_transcripts(spark, write_files(tmp_path / "in"))
    assert {(r.name, r.format) for r in st.route_format(files).collect()} == {("a.txt", "txt"), ("b.json", "json"), ("c.srt", "srt"), ("d.txt", "srt")}
    names = {r.meeting_id: r.name for r in files.collect()}
    rows = sorted((names[r.meeting_id], r.seg_id, r.speaker, r.text) for r in st.parse_transcripts(files).collect())
    assert ("a.txt", 1, "Bob Stone", "We decided to wait. Until Friday.") in rows
    assert ("a.txt", 2, "Ann", "I will send the full report by Friday.") in rows
    assert ("b.json", 0, "Ann", "There is a risk that the audit is late.") in rows
    assert ("c.srt", 1, "Bob", "hi") in rows and ("d.txt", 0, "Ann", "hello all") in rows


def test_results_round_trip_with_a_corrupt_report(spark, tmp_path):
    path = str(tmp_path / "out")
    reports = spark.createDataFrame([(1, "one", 1, 0, 0, 0.5), (2, "two", 0, 2, 0, 0.7)], "meeting_id long, summary string, decisions_count long, actions_count long, risks_count long, avg_confidence double")
    items = spark.createDataFrame([(1, "decision", 1, 1, "x", None, 0.5), (2, "action", 1, 1, "y", "Ann", 0.7), (2, "action", 2, 1, "z", "Ann", 0.7)], sr.ITEMS)
    sr.write_results(reports, items, path, 2)
    good = {r.meeting_id: r for r in sr.read_results(spark, path).collect()}
    assert good[1].summary == "one" and good[2].actions_count == 2 and not good[1].from_fallback
    spark.createDataFrame([(7, '2\t{"meeting_id": 2, "summ'), (7, '1\t' + json.dumps({"meeting_id": 1, "summary": "one", "decisions_count": 1}))], "bucket int, value string").write.mode("overwrite").partitionBy("bucket").text(f"{path}/report")
    bad = {r.meeting_id: r for r in sr.read_results(spark, path).collect()}
    assert bad[2].from_fallback and bad[2].summary == "two" and bad[2].actions_count == 2 and bad[1].decisions_count == 1


def test_stream_transcripts_equals_batch(spark, tmp_path):
    src, out = write_files(tmp_path / "in"), str(tmp_path / "out")
    flows.stream_transcripts(spark, src, out, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    cols = ["meeting_id", "seg_id", "action"]
    got = sorted(map(tuple, spark.read.parquet(f"{out}/actions").select(cols).collect()))
    assert got and got == sorted(map(tuple, ex.extract_actions(st.parse_transcripts(st.scan_transcripts(spark, src))).select(cols).collect()))


def test_stream_status_and_reviews(spark, tmp_path):
    log = spark.createDataFrame([(j, i, "s%d" % i) for j in range(3) for i in range(4)], "job_id long, event_id long, status string")
    log.filter("event_id < 2").write.parquet(str(tmp_path / "log"))
    log.filter("event_id >= 2").write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = stream.writeStream.foreachBatch(flows.status_table_writer(str(tmp_path / "st"), "event_id")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "st").iterdir())
    got = {(r.job_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "st" / f"version={last}")).collect()}
    assert got == {(j, 3) for j in range(3)}

    scores = spark.createDataFrame([(j, "llm", "summary", c, 4.0, "") for j in range(3) for c in ("coverage", "factuality", "clarity")], "job_id long, source string, component string, criterion string, score double, explanation string")
    reviews = spark.range(3).select(F.col("id").alias("job_id"), F.lit("summary").alias("component"), F.lit("r").alias("reviewer_id"), F.timestamp_seconds(F.col("id")).alias("ts"),
                                    F.create_map(F.lit("clarity"), F.lit(8.0)).alias("scores"), F.create_map(F.lit("clarity"), F.lit("ok")).alias("explanations"), F.lit(False).alias("mark_for_retraining"))
    for j in range(3):
        reviews.filter(F.col("job_id") == j).coalesce(1).write.mode("append").parquet(str(tmp_path / "rev"))
    schema = ev.default_eval_schema(spark)
    rs = spark.readStream.schema(reviews.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rev"))
    rs.writeStream.foreachBatch(flows.review_writer(scores, schema, str(tmp_path / "store"), str(tmp_path / "rep"))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    rows = scores.unionByName(ev.review_scores(reviews))
    crit = ev.weighted_criterion_scores(rows)
    want = {(r.job_id, round(r.aggregate_score, 6)) for r in ev.improvement_report(crit, ev.component_scores(crit, schema), rows).collect()}
    assert {(r.job_id, round(r.aggregate_score, 6)) for r in flows.current_reports(spark, str(tmp_path / "rep")).collect()} == want


def test_stream_dedup_items(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Send it", 1), (1, "send it ", 2), (2, "send it", 3)], "meeting_id long, action string, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "i"))
    q = flows.stream_dedup_items(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "i"))).writeStream.format("memory").queryName("kept_items").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("kept_items").groupBy("meeting_id").count().count() == 2 and spark.table("kept_items").count() == 2
