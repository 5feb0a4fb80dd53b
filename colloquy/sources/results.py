"""Stored results: per-meeting reports, items, summaries and the job-status log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "meeting_id long, summary string, decisions_count long, actions_count long, risks_count long, avg_confidence double, _corrupt string"
ITEMS = "meeting_id long, kind string, item_id long, seg_id long, text string, owner string, confidence double"


def write_results(reports: DataFrame, items: DataFrame, path: str, partitions: int = 64) -> None:
    """report/ (one JSON row per meeting), items/ (one row per item) and summary/.

    Folders are hash buckets of the meeting, so their number does not grow with the data.
    """
    bucket = F.pmod(F.xxhash64("meeting_id"), F.lit(partitions)).alias("bucket")
    cols = [c for c in reports.columns if c != "meeting_id"]
    full = reports.select(bucket, F.to_json(F.struct("meeting_id", *cols)).alias("value"), F.col("meeting_id"))
    full.select("bucket", F.concat_ws("\t", F.col("meeting_id").cast("string"), "value").alias("value")).write.mode("overwrite").partitionBy("bucket").text(f"{path}/report")
    items.select(bucket, "*").write.mode("overwrite").partitionBy("bucket").json(f"{path}/items")
    reports.select(bucket, "meeting_id", "summary").write.mode("overwrite").partitionBy("bucket").json(f"{path}/summary")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Reports; a corrupt report is rebuilt from the stored items and summary."""
    raw = spark.read.text(f"{path}/report").select(
        F.substring_index("value", "\t", 1).cast("long").alias("meeting_id"), F.regexp_extract("value", r"(?s)^[^\t]*\t(.*)$", 1).alias("_json")
    )
    parsed = raw.select(
        "meeting_id", F.from_json("_json", REPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")
    )
    items = spark.read.schema(ITEMS).json(f"{path}/items")
    counts = items.groupBy("meeting_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"_{k}s") for k in ("decision", "action", "risk")], F.avg("confidence").alias("_avg")
    )
    stored = spark.read.schema("meeting_id long, summary string").json(f"{path}/summary").withColumnRenamed("summary", "_summary")
    j = parsed.join(counts, "meeting_id", "left").join(stored, "meeting_id", "left")
    bad = F.col("r._corrupt").isNotNull() | F.col("r.meeting_id").isNull()
    keep = lambda good, fallback: F.when(bad, fallback).otherwise(F.col(good))
    return j.select(
        "meeting_id", keep("r.summary", F.coalesce("_summary", F.lit(""))).alias("summary"),
        keep("r.decisions_count", F.coalesce("_decisions", F.lit(0))).alias("decisions_count"),
        keep("r.actions_count", F.coalesce("_actions", F.lit(0))).alias("actions_count"),
        keep("r.risks_count", F.coalesce("_risks", F.lit(0))).alias("risks_count"),
        keep("r.avg_confidence", F.coalesce("_avg", F.lit(0.0))).alias("avg_confidence"), bad.alias("from_fallback"),
    )


def append_job_status(status: DataFrame, path: str) -> None:
    status.write.mode("append").parquet(path)


def latest_status(log: DataFrame, order: str = "ts") -> DataFrame:
    """Current row per job from the append-only log."""
    rest = [c for c in log.columns if c != "job_id"]
    return log.groupBy("job_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("job_id", "_r.*")
