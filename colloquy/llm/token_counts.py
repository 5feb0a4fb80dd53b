"""Token counts as a delta-maintained rollup.

A batch of changes is a table (op, source, lang, version, tokens, old_version, old_tokens): inserts add, deletes subtract,
and revisions take back the old count and add the new one. A batch is summed to one signed row per (source, lang, version)
and written to the rollup's folder as batch=<name>, with a marker row once it is complete; a batch whose marker exists
is skipped, and an unfinished one is written over, so that committing twice is committing once. Totals are the sum of all
committed deltas; groups without documents vanish.

Defined cases: null sources and languages are groups of their own; null counts count as 0 tokens; unknown operations raise.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.tokens import public_path, word_ids
from colloquy.llm.words import binary_list
from colloquy.session import materialize, use_checkpoint_dir

KEYS = ("source", "lang", "version")
TOTALS = "source string, lang string, version string, documents bigint, tokens bigint"


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, source, lang, words (runs between white space), tokens (by the public word-level BPE file)."""
    path = path or public_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).alias("text"))

    def run(batches):
        ids_of = word_ids(path)
        for batch in batches:
            texts = binary_list(batch.column(3))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array([len((t or b"").split()) for t in texts], pa.int64()),
                                              pa.array([len(x) // 4 for x in ids_of.texts_ids(texts)], pa.int64())], names=["doc_id", "source", "lang", "words", "tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, lang string, words bigint, tokens bigint")


def signed(changes: DataFrame) -> DataFrame:
    """One signed row per group of a batch of changes."""
    plus = F.struct("source", "lang", "version", F.lit(1).alias("documents"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    minus = F.struct("source", "lang", "version", F.lit(-1).alias("documents"), (-F.coalesce("tokens", F.lit(0))).cast("bigint").alias("tokens"))
    taken = F.struct("source", "lang", F.col("old_version").alias("version"), F.lit(-1).alias("documents"), (-F.coalesce("old_tokens", F.lit(0))).cast("bigint").alias("tokens"))
    rows = (F.when(F.col("op") == "insert", F.array(plus)).when(F.col("op") == "delete", F.array(minus)).when(F.col("op") == "revise", F.array(taken, plus))
            .otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null"))))))
    return changes.select(F.explode(rows).alias("r")).select("r.*").groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/markers-")

    def committed(self) -> set[str]:
        rows = self.spark.read.schema("batch string").parquet(f"{self.folder}/markers*")
        return {r[0] for r in rows.collect()}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before."""
        if batch in self.committed():
            return False
        signed(changes).coalesce(8).write.mode("overwrite").parquet(f"{self.folder}/delta-{batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/markers-{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens of all committed batches."""
        done = sorted(self.committed())
        if not done:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*[f"{self.folder}/delta-{b}" for b in done])
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 or tokens <> 0")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/rollup-{uuid.uuid4().hex}"


def maintain(docs: DataFrame, withdrawn: DataFrame, folder: str | None = None) -> DataFrame:
    """The life of `docs` in a rollup: words are counted at insertion, the documents of `withdrawn` (doc_id) are deleted, and
    the counts of the rest are revised by the tokenizer. Every batch is offered twice and counts once."""
    spark = docs.sparkSession
    out = withdrawn.select("doc_id").dropna().distinct().withColumn("gone", F.lit(True))
    counted = materialize(count_tokens(docs).join(out, "doc_id", "left"))
    rollup = Rollup(spark, folder or shared_folder(spark))
    none = [F.lit(None).cast("string").alias("old_version"), F.lit(None).cast("bigint").alias("old_tokens")]
    first = [F.lit("words").alias("version"), F.col("words").alias("tokens"), *none]
    batches = {
        "1-insert": counted.select(F.lit("insert").alias("op"), "source", "lang", *first),
        "2-delete": counted.filter("gone").select(F.lit("delete").alias("op"), "source", "lang", *first),
        "3-revise": counted.filter("gone is null").select(F.lit("revise").alias("op"), "source", "lang", F.lit("word_bpe_49k").alias("version"), "tokens",
                                                          F.lit("words").alias("old_version"), F.col("words").alias("old_tokens")),
    }
    for name in [*batches, *batches]:
        rollup.commit(name, batches[name])
    return rollup.totals()
