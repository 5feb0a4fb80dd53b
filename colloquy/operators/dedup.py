"""First occurrences, unions and near-duplicate merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import text as tx
from colloquy.session import materialize


def first_occurrence(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Smallest row by `order` per key, as an aggregate: it combines before the shuffle."""
    rest = [c for c in items.columns if c not in keys]
    best = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*items.columns)


def dedup_prefix(items: DataFrame, text: str = "text", chars: int = 50, order=("seg_id",)) -> DataFrame:
    """One item per meeting and lower-cased leading characters."""
    keyed = items.withColumn("_key", F.left(F.lower(F.col(text)), F.lit(chars)))
    return first_occurrence(keyed, ["meeting_id", "_key"], list(order)).select(*items.columns)


def chunk_key(kind, text, owner) -> Column:
    action = F.lower(F.concat_ws("-", F.coalesce(owner, F.lit("")), F.left(text, F.lit(50))))
    return F.when(kind == "action", action).otherwise(F.lower(F.left(text, F.lit(100))))


def dedup_across_chunks(items: DataFrame, order=("item_id",)) -> DataFrame:
    """Items(meeting_id, kind, item_id, text, owner) found in overlapping chunks, kept once."""
    keyed = items.withColumn("_key", chunk_key(F.col("kind"), F.col("text"), F.col("owner")))
    return first_occurrence(keyed, ["meeting_id", "kind", "_key"], list(order)).select(*items.columns)


def union_items(decisions: DataFrame, actions: DataFrame, risks: DataFrame) -> DataFrame:
    """(meeting_id, kind, item_id, seg_id, text, owner, confidence) of all three kinds."""

    def part(df, kind, text, owner):
        who = F.col(owner) if owner else F.lit(None).cast("string")
        return df.select("meeting_id", F.lit(kind).alias("kind"), "item_id", "seg_id", F.col(text).alias("text"), who.alias("owner"), "confidence")

    return (
        part(decisions, "decision", "text", None)
        .unionByName(part(actions, "action", "action", "owner"))
        .unionByName(part(risks, "risk", "risk", None))
    )


def word_set_ops(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Shared and combined word sets of two text columns."""
    a, b = (F.array_distinct(tx.words(F.lower(F.col(c)))) for c in (left, right))
    return rows.withColumn("shared_words", F.array_sort(F.array_intersect(a, b))).withColumn(
        "all_words", F.array_sort(F.array_union(a, b))
    )


# --------------------------------------------------------------------------- near duplicates
def similar_pairs(items: DataFrame, keys: list[str], item: str, vec: str, threshold: float, tile: int = 2048) -> DataFrame:
    """(keys…, a, b, similarity) with a < b and cosine above the threshold, exact.

    A key is cut into random tiles of about `tile` vectors; each task compares two
    tiles with one matrix product and returns only the pairs above the threshold.
    """
    sizes = items.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles"))
    placed = items.select(*keys, item, vec).join(sizes, keys).withColumn(
        "_t", F.pmod(F.xxhash64(item), F.col("_tiles")).cast("int")
    )
    spread = placed.withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).select(
        *keys, item, vec, "_t", F.least("_t", "_u").alias("_lo"), F.greatest("_t", "_u").alias("_hi")
    )
    schema = T.StructType(
        [*[items.schema[k] for k in keys], T.StructField("a", items.schema[item].dataType),
         T.StructField("b", items.schema[item].dataType), T.StructField("similarity", T.DoubleType())]
    )

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[-2], key[-1]
        x = pdf[pdf["_t"] == lo]
        y = pdf[pdf["_t"] == hi]

        def units(v):
            m = np.array(v.tolist(), dtype="float64")
            n = np.linalg.norm(m, axis=1, keepdims=True)
            return m / np.where(n == 0, 1, n)

        if x.empty or y.empty:
            return pd.DataFrame(columns=schema.names)
        sim = units(x[vec]) @ units(y[vec]).T
        i, j = np.nonzero(sim > threshold)
        a, b, s = x[item].to_numpy()[i], y[item].to_numpy()[j], sim[i, j]
        keep = a < b if lo == hi else a != b
        a, b, s = a[keep], b[keep], s[keep]
        out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s})
        for name, value in zip(keys, key):
            out[name] = value
        return out[schema.names]

    return spread.groupBy(*keys, "_lo", "_hi").applyInPandas(compare, schema)


def greedy_leaders(nodes: DataFrame, edges: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys…, item, leader): what the in-order greedy loop would group together.

    An item leads if no earlier leader is similar to it. Rounds decide every item
    whose earlier neighbours are all decided; each round is a join, and lineage is
    cut with checkpoint(), so a lost executor costs one round at most.
    """
    e = materialize(edges.select(*keys, "a", "b"))
    followers = e.select(*keys, F.col("b").alias(item)).distinct()
    leaders = nodes.select(*keys, item).join(followers, [*keys, item], "left_anti")
    undecided = followers
    decided = materialize(leaders)
    while True:
        taken = e.join(decided.withColumnRenamed(item, "a"), [*keys, "a"]).select(*keys, F.col("b").alias(item)).distinct()
        open_rows = materialize(undecided.join(taken, [*keys, item], "left_anti"))
        if open_rows.isEmpty():
            break
        blocked = (
            e.join(open_rows.withColumnRenamed(item, "a"), [*keys, "a"]).select(*keys, F.col("b").alias(item)).distinct()
        )
        new = open_rows.join(blocked, [*keys, item], "left_anti")
        decided = materialize(decided.unionByName(new))
        undecided = open_rows.join(decided, [*keys, item], "left_anti")
    follow = (
        e.join(decided.withColumnRenamed(item, "a"), [*keys, "a"])
        .groupBy(*keys, F.col("b").alias(item)).agg(F.min("a").alias("leader"))
        .join(decided, [*keys, item], "left_anti")
    )
    return decided.withColumn("leader", F.col(item)).unionByName(follow.select(*keys, item, "leader"))


def near_duplicate_groups(items: DataFrame, keys: list[str], item: str, vec: str, threshold: float = 0.8) -> DataFrame:
    """(keys…, item, leader). Equal vectors are folded first, so copies cost nothing later."""
    copies = items.groupBy(*keys, vec).agg(F.min(item).alias("_first"))
    firsts = copies.select(*keys, F.col("_first").alias(item), vec)
    groups = greedy_leaders(firsts, similar_pairs(firsts, keys, item, vec, threshold), keys, item)
    return (
        items.select(*keys, item, vec)
        .join(copies, [*keys, vec])
        .join(groups.withColumnRenamed(item, "_first"), [*keys, "_first"])
        .select(*keys, item, "leader")
    )


def near_duplicate_merge(items: DataFrame, threshold: float = 0.8, vec: str = "vec") -> DataFrame:
    """One row per group of similar items: the most confident one, with everybody's participants.

    items(meeting_id, item_id, vec, confidence[, participants]).
    """
    groups = near_duplicate_groups(items, ["meeting_id"], "item_id", vec, threshold)
    rows = items.join(groups, ["meeting_id", "item_id"])
    rest = [c for c in items.columns if c not in ("meeting_id", "participants")]
    best = rows.groupBy("meeting_id", "leader").agg(
        F.min_by(F.struct(*rest), F.struct(-F.col("confidence"), "item_id")).alias("_r"),
        F.count(F.lit(1)).alias("merged_rows"),
    )
    out = best.select("meeting_id", "leader", "_r.*", "merged_rows")
    if "participants" in items.columns:
        people = (
            rows.select("meeting_id", "leader", F.explode("participants").alias("_p")).distinct()
            .groupBy("meeting_id", "leader").agg(F.array_sort(F.collect_list("_p")).alias("participants"))
        )
        out = out.join(people, ["meeting_id", "leader"], "left")
    return out


def merge_owner_actions(actions: DataFrame, threshold: float = 0.75, vec: str = "vec") -> DataFrame:
    """Similar actions of one owner become one: texts joined, best priority, highest confidence.

    The texts of a group are the distinct ones in order, so copies do not lengthen them.
    """
    keys = ["meeting_id", "owner"]
    groups = near_duplicate_groups(actions, keys, "item_id", vec, threshold)
    rows = actions.join(groups, [*keys, "item_id"])
    weight = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "low", 1).otherwise(2)
    facts = rows.groupBy(*keys, "leader").agg(
        F.min_by(F.struct("due_date", "priority"), F.struct(-weight, "item_id")).alias("_b"),
        F.max("confidence").alias("confidence"),
    )
    texts = (
        rows.groupBy(*keys, "leader", "action").agg(F.min("item_id").alias("_i"))
        .groupBy(*keys, "leader").agg(F.array_sort(F.collect_list(F.struct("_i", "action"))).alias("_t"))
    )
    return facts.join(texts, [*keys, "leader"]).select(
        *keys, F.col("leader").alias("item_id"),
        F.array_join(F.transform("_t", lambda t: t["action"]), " and ").alias("action"),
        "_b.due_date", "_b.priority", "confidence",
    )
