"""Corpus pipeline: language, near duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last returns pieces of
packed sequences. A stage sees all that the one before kept. Rows that repeat a doc_id stand or fall together where a
decision is made per id; rows of null id are kept by such decisions. Nulls, blank texts and empty tables pass through as
each operator's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.decontamination import contaminated
from colloquy.llm.jaccard_join import link_components
from colloquy.llm.language_id import identify_documents
from colloquy.llm.packing import pack_documents
from colloquy.llm.substring_dedup import remove_repeats
from colloquy.session import materialize, use_checkpoint_dir

BROADCAST_ROWS = 200_000
PASSAGE_WORDS = 50


def _without(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Documents whose `key` is not in `rejected`; a small set is broadcast (its size is checked), a large one is shuffled."""
    rejected = materialize(rejected.dropna().distinct())
    if rejected.count() <= BROADCAST_ROWS:
        rejected = F.broadcast(rejected)
    return docs.join(rejected, key, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification accepts. Rows are told apart by id and text."""
    keyed = docs.withColumn("_row", F.concat_ws(":", "doc_id", F.xxhash64("text")))
    found = identify_documents(keyed, id_col="_row")
    return _without(keyed, found.filter("not kept").select(F.col("id").alias("_row")), "_row").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one of the smallest id."""
    found = materialize(link_components(docs))
    kept = _without(docs, found.filter("component_id <> id").select(F.col("id").alias("doc_id")), "doc_id")
    again = found.filter("component_id = id and n_shingles > 0").groupBy("id").count().filter("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of PASSAGE_WORDS words or more that an earlier one holds; emptied documents go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    safe = {c: f"_rest{i}" for i, c in enumerate(rest)}
    found = remove_repeats(docs.select("doc_id", "text", *[F.col(c).alias(s) for c, s in safe.items()]), window=PASSAGE_WORDS, as_words=False, carry=list(safe.values()))
    found = found.filter("size(removed) = 0 or kept rlike '[^ \\t-\\r]'")
    found = found.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), *[F.col(s).alias(c) for c, s in safe.items()],
                         F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    return found.select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select(F.col("id").alias("doc_id")), "doc_id")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs).drop("ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("benchmark_passages", benchmark_passages), ("packing", packed)]

#: Language posteriors and token ids cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet below the checkpoint folder and read again."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
