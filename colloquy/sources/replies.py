"""Model replies (free text around JSON) and the evaluation schema file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK = 5.0


def json_body(reply):
    """From the first { to the last }."""
    return F.regexp_extract(reply, r"(?s)\{.*\}", 0)


def salvage_json(replies: DataFrame, schema: DataFrame) -> DataFrame:
    """replies(job_id, component, reply) → score per criterion; 5.0 for all when the reply does not parse."""
    v = F.try_parse_json(json_body("reply"))
    r = replies.withColumn("parse_error", v.isNull()).withColumn("_s", F.try_variant_get(v, "$.scores", "map<string,double>"))
    return (
        r.join(F.broadcast(schema.select("component", "criterion")), "component")
        .withColumn("score", F.when(F.col("parse_error"), F.lit(FALLBACK)).otherwise(F.try_element_at("_s", F.col("criterion"))))
        .filter("score is not null")
        .select("job_id", "component", "criterion", "score", "parse_error")
    )


def salvage_items(replies: DataFrame, kind: str, item_schema: str) -> DataFrame:
    """Items of one list ('decisions', 'action_items', 'risks') in each reply; none if it does not parse."""
    parsed = F.from_json(json_body("reply"), f"{kind} array<struct<{item_schema}>>")
    return replies.select("job_id", F.posexplode(parsed[kind]).alias("item_no", "item")).select("job_id", "item_no", "item.*")


def load_eval_schema(spark: SparkSession, path: str) -> DataFrame:
    """components → criteria → weights of a JSON schema file as (component, criterion, weight)."""
    raw = spark.read.option("multiLine", "true").schema("components map<string, struct<weights: map<string,double>>>").json(path)
    c = raw.select(F.explode("components").alias("component", "_c"))
    return c.select("component", F.explode("_c.weights").alias("criterion", "weight"))
