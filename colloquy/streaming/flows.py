"""Continuous versions: new files to items, job status, reviews and item de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.functions import text as tx
from colloquy.operators import evaluation as ev
from colloquy.operators import extraction as ex
from colloquy.sources.results import latest_status
from colloquy.sources.transcripts import files_table, parse_transcripts

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, max_files: int = 10_000, max_bytes: int | None = None) -> DataFrame:
    """New transcript files as they arrive."""
    files = (
        spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.{txt,json,srt}")
        .option("maxFilesPerTrigger", max_files).load(path)
    )
    return files_table(files if max_bytes is None else files.filter(F.col("length") <= max_bytes))


def stream_transcripts(spark: SparkSession, path: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of files becomes segments, decisions, actions and risks.

    A file is one meeting, so a batch holds whole meetings and needs no state. The
    batch number is a folder: a batch that is repeated after a failure overwrites it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        segments = parse_transcripts(batch).persist()
        try:
            for name, df in {
                "segments": segments, "decisions": ex.extract_decisions(segments),
                "actions": ex.extract_actions(segments), "risks": ex.extract_risks(segments),
            }.items():
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            segments.unpersist()

    return stream_files(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_job_status(log: DataFrame, order: str = "ts") -> DataFrame:
    """Streaming current row per job (update or complete mode)."""
    rest = [c for c in log.columns if c != "job_id"]
    return log.groupBy("job_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("job_id", "_r.*")


def status_table_writer(out: str, order: str = "ts"):
    """foreachBatch sink: the table of current states is rewritten as version n from version n-1."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = latest_status(batch, order)
        if batch_id > 0:
            fresh = latest_status(fresh.unionByName(spark.read.parquet(f"{out}/version={batch_id - 1}")), order)
        fresh.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return write


def review_writer(scores: DataFrame, schema: DataFrame, store: str, out: str):
    """foreachBatch sink for reviews(job_id, component, reviewer_id, ts, scores, explanations, …).

    Stores the batch, then recomputes totals and reports for the jobs it touches only.
    scores: the llm and metrics rows known for all jobs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        touched = batch.select("job_id").distinct()
        known = spark.read.option("basePath", store).parquet(store).filter(F.col("batch") <= batch_id).drop("batch")
        latest = ev.latest_review(known.join(touched, "job_id", "left_semi"))
        rows = scores.join(touched, "job_id", "left_semi").unionByName(ev.review_scores(latest))
        criteria = ev.weighted_criterion_scores(rows)
        components = ev.component_scores(criteria, schema)
        report = ev.improvement_report(criteria, components, rows)
        report.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def current_reports(spark: SparkSession, out: str) -> DataFrame:
    """Latest report per job over all batches written by review_writer."""
    rows = spark.read.option("basePath", out).parquet(out)
    rest = [c for c in rows.columns if c not in ("job_id", "batch")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select("job_id", "_r.*")


def stream_dedup_items(items: DataFrame, time_col: str = "ts", delay: str = "1 hour", text: str = "action") -> DataFrame:
    """First item per meeting and lower-cased text; state is dropped `delay` behind the watermark."""
    keyed = items.withColumn("_key", F.lower(tx.strip(F.col(text)))).withWatermark(time_col, delay)
    return keyed.dropDuplicatesWithinWatermark(["meeting_id", "_key"]).drop("_key")
