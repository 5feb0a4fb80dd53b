"""Sizing of batches and hash buckets, shared by the operators on word windows and shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = (1 << 63) - 1


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, rows: int, per_bucket: int) -> int:
    """A power of two: enough hash buckets for `rows`, and at least one per shuffle partition."""
    return 1 << max(0, (max(partitions(spark), -(-rows // per_bucket)) - 1).bit_length())


def with_ranges(docs: DataFrame, key: str, text: str, limit: int, per_partition: int = 3) -> tuple[DataFrame, int, int]:
    """Number documents by consecutive ranges of `key` of about `limit` bytes of text, in key order.

    Returns the documents with a column `batch`, the number of batches and the bytes of text. Fine ranges come from
    approximate quantiles of the key, their sizes from one aggregate; neighbours are merged. Only range bounds, in number
    proportional to the batches, reach the driver. Equal keys share a batch.
    """
    spark = docs.sparkSession
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")).first()
    limit = max(1, min(limit, -(-total // (per_partition * partitions(spark)))))
    fine = min(max(1, rows), 4 * (-(-total // limit) or 1))
    cuts = docs.agg(F.percentile_approx(key, [i / fine for i in range(1, fine)], 20 * fine)).first()[0] if fine > 1 else []
    cuts = sorted(set(cuts or []))

    def numbered(bounds: list[int]):
        if not bounds:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b < F.col(key)))

    sized = dict(docs.groupBy(numbered(cuts).alias("r")).agg(F.sum(F.octet_length(text))).collect()) if cuts else {}
    bounds, held = [], 0
    for i, cut in enumerate(cuts):
        held += sized.get(i) or 0
        if held + (sized.get(i + 1) or 0) > limit:
            bounds.append(cut)
            held = 0
    return docs.withColumn("batch", numbered(bounds)), len(bounds) + 1, total
