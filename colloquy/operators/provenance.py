"""Links from extracted items back to the segments that support them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import text as tx
from colloquy.session import materialize

ITEM = ["meeting_id", "kind", "item_id"]


def _word_sets(rows: DataFrame) -> DataFrame:
    """Adds the set of lower-cased words of `text` as sorted 64-bit hashes, its size and a hash of the whole set; rows without words go."""
    hashes = F.transform(tx.words(F.lower("text")), lambda w: F.xxhash64(w))
    sets = rows.withColumn("_set", F.array_sort(F.array_distinct(hashes))).filter(F.size("_set") > 0)
    return sets.withColumn("_n", F.size("_set")).withColumn("_h", F.xxhash64("_set")).drop("text")


def link_provenance_lexical(items: DataFrame, segments: DataFrame, above: float = 0.1, top: int = 3, tile: int = 1024) -> DataFrame:
    """Per item the `top` segments of its meeting with word-set Jaccard > above.

    items(meeting_id, kind, item_id, text) → (meeting_id, kind, item_id, rank, seg_id, similarity).

    Every row of segments with an id is a candidate, also where ids repeat. Equal word sets are compared once; of copies only the
    first `top` rows can ever be returned. The distinct sets of a meeting are cut into tiles of about `tile`; a task compares a
    tile of items with a tile of segments. A Jaccard index is at most the ratio of the two sizes, so segments no item comes near
    in size are left out before their words are copied to tiles, other pairs before they are intersected. Sizes planned from a
    compressed file say little here: no join may be broadcast.
    """
    seg = _word_sets(segments.select("meeting_id", "seg_id", "text").filter(F.col("seg_id").isNotNull()))
    item = _word_sets(items.select(*ITEM, "text"))
    copies = Window.partitionBy("meeting_id", "_h").orderBy("seg_id")
    first = seg.select("meeting_id", "seg_id", "_h", "_n").withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= top)
    reps = materialize(first.groupBy("meeting_id", "_h", "_n").agg(F.sort_array(F.collect_list("seg_id")).alias("_ids")))
    item_sets = item.select("meeting_id", F.col("_h").alias("_ih"), F.col("_set").alias("_is")).distinct()

    n_tiles = F.ceil(F.count(F.lit(1)) / tile).cast("int")
    sizes = item.groupBy("meeting_id", "_h").agg(F.min("_n").alias("_low"), F.max("_n").alias("_high"))
    sizes = sizes.groupBy("meeting_id").agg(n_tiles.alias("_i_tiles"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    tiles = materialize(sizes.join(reps.groupBy("meeting_id").agg(n_tiles.alias("_s_tiles")).hint("merge"), "meeting_id")).hint("merge")
    wanted = reps.join(tiles, "meeting_id").filter(F.least("_n", "_high") / F.greatest("_n", "_low") > above)
    right = wanted.select("meeting_id", "_h", "_ids", "_i_tiles", F.pmod("_h", "_s_tiles").cast("int").alias("_s")).join(
        seg.groupBy("meeting_id", "_h").agg(F.first("_set").alias("_ss")).hint("merge"), ["meeting_id", "_h"]
    ).select("meeting_id", "_ids", "_ss", F.explode(F.sequence(F.lit(0), F.col("_i_tiles") - 1)).alias("_i"), "_s")
    left = item_sets.join(tiles, "meeting_id").select(
        "meeting_id", "_ih", "_is", F.pmod("_ih", "_i_tiles").cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_s_tiles") - 1)).alias("_s"))

    m, n = F.size("_is"), F.size("_ss")
    similarity = tx.let(F.size(F.array_intersect("_is", "_ss")), lambda shared: shared / (m + n - shared))
    pairs = left.join(right.hint("merge"), ["meeting_id", "_i", "_s"]).filter((F.least(m, n) / F.greatest(m, n) > above) & (similarity > above))
    hits = pairs.select("meeting_id", "_ih", similarity.alias("similarity"), F.explode("_ids").alias("seg_id"))
    w = Window.partitionBy("meeting_id", "_ih").orderBy(F.desc("similarity"), "seg_id")
    best = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    own = item.select(*ITEM, F.col("_h").alias("_ih"))
    return own.join(best.hint("merge"), ["meeting_id", "_ih"]).select(*ITEM, "rank", "seg_id", "similarity")


def _tiles(rows: DataFrame, key: str, item: list[str], tile: int, name: str) -> DataFrame:
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(f"_{name}_tiles"))
    return rows.join(sizes, key).withColumn(f"_{name}", F.pmod(F.xxhash64(*item), F.col(f"_{name}_tiles")).cast("int"))


def nearest_segments(
    items: DataFrame, segments: DataFrame, above: float, top: int, tile: int = 2048
) -> DataFrame:
    """items(meeting_id, kind, item_id, vec) → the `top` segments(meeting_id, seg_id, vec) by cosine > above.

    Items and segments of a meeting are cut into tiles of bounded size. A task
    compares one item tile with one segment tile and returns at most `top` rows per
    item, so neither a meeting nor its pairs ever sit in one place.
    """
    it = _tiles(items.select(*ITEM, "vec"), "meeting_id", ["kind", "item_id"], tile, "i")
    sg = _tiles(segments.select("meeting_id", "seg_id", "vec"), "meeting_id", ["seg_id"], tile, "s")
    seg_tiles = sg.select("meeting_id", "_s_tiles").distinct()
    item_tiles = it.select("meeting_id", "_i_tiles").distinct()
    left = it.join(seg_tiles, "meeting_id").select(
        "meeting_id", "kind", "item_id", F.lit(None).cast(segments.schema["seg_id"].dataType).alias("seg_id"), "vec", "_i",
        F.explode(F.sequence(F.lit(0), F.col("_s_tiles") - 1)).alias("_s"),
    )
    right = sg.join(item_tiles, "meeting_id").select(
        "meeting_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
        "seg_id", "vec", F.explode(F.sequence(F.lit(0), F.col("_i_tiles") - 1)).alias("_i"), "_s",
    )
    schema = T.StructType([
        items.schema["meeting_id"], T.StructField("kind", T.StringType()), items.schema["item_id"],
        segments.schema["seg_id"], T.StructField("similarity", T.DoubleType()),
    ])

    def units(v):
        m = np.array(v.tolist(), dtype="float64")
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["kind"].notna()], pdf[pdf["kind"].isna()].sort_values("seg_id")
        if x.empty or y.empty:
            return pd.DataFrame(columns=schema.names)
        sim = units(x["vec"]) @ units(y["vec"]).T
        ids = y["seg_id"].to_numpy()
        rows = []
        for r, (kind, item) in enumerate(zip(x["kind"], x["item_id"])):
            for j in np.argsort(-sim[r], kind="stable")[:top]:
                if sim[r, j] > above:
                    rows.append((key[0], kind, item, ids[j], float(sim[r, j])))
        return pd.DataFrame(rows, columns=schema.names)

    tops = left.unionByName(right.select(*left.columns)).groupBy("meeting_id", "_i", "_s").applyInPandas(compare, schema)
    w = Window.partitionBy(*ITEM).orderBy(F.desc("similarity"), "seg_id")
    return tops.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(*ITEM, "rank", "seg_id", "similarity")


def link_provenance_vector(items: DataFrame, segments: DataFrame, above: float = 0.3, top: int = 3) -> DataFrame:
    return nearest_segments(items, segments, above, top)


def vector_support(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Highest cosine of an item against the segments of its meeting (0 at least)."""
    best = nearest_segments(items, segments, 0.0, 1).select(*ITEM, F.col("similarity").alias("vector_support"))
    return items.select(*ITEM).join(best, ITEM, "left").na.fill(0.0, ["vector_support"])


def support_status(items: DataFrame, provenance: DataFrame, threshold: float = 0.5) -> DataFrame:
    agg = provenance.groupBy(*ITEM).agg(F.max("similarity").alias("m"), F.count(F.lit(1)).alias("n"))
    m = F.coalesce("m", F.lit(0.0))
    status = (
        F.when(m < 0.3, "Low similarity to source - potential hallucination")
        .when(m >= threshold, "Well-supported by source material")
        .otherwise("Weak support in source material")
    )
    return items.select(*ITEM).join(agg, ITEM, "left").select(
        *ITEM, (m >= threshold).alias("is_valid"), m.alias("max_similarity"),
        F.coalesce("n", F.lit(0)).alias("supporting_segments"), (m < 0.3).alias("potential_hallucination"), status.alias("status"),
    )


def provenance_summary(items: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per meeting: items, coverage, mean similarity of all links, potential hallucinations."""
    per_item = provenance.groupBy(*ITEM).agg(F.max("similarity").alias("m"), F.sum("similarity").alias("s"), F.count(F.lit(1)).alias("n"))
    j = items.select(*ITEM).join(per_item, ITEM, "left")
    g = j.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count("n").alias("items_with_provenance"),
        F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("average_similarity"),
        F.count_if(F.coalesce("m", F.lit(0.0)) < 0.3).alias("potential_hallucinations"),
    )
    return g.withColumn("provenance_coverage", F.col("items_with_provenance") / F.col("total_items")).withColumn(
        "hallucination_rate", F.col("potential_hallucinations") / F.col("total_items")
    )


def boost_confidence(items: DataFrame, provenance: DataFrame, above: float = 0.7) -> DataFrame:
    """Confidence +.1 (at most .95) where the mean link similarity is high."""
    mean = provenance.groupBy(*ITEM).agg(F.avg("similarity").alias("_avg"))
    boosted = F.when(F.col("_avg") > above, F.least(F.col("confidence") + 0.1, F.lit(0.95))).otherwise(F.col("confidence"))
    return items.join(mean, ITEM, "left").withColumn("confidence", boosted).select(*items.columns)


def segment_lookup(wanted: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, seg_id) requests with speaker and text, NULL outside the transcript."""
    return wanted.join(segments.select("meeting_id", "seg_id", "speaker", "text"), ["meeting_id", "seg_id"], "left")


def provenance_detail(provenance: DataFrame, segments: DataFrame) -> DataFrame:
    return provenance.join(segments.select("meeting_id", "seg_id", "speaker", "ts_raw", "text"), ["meeting_id", "seg_id"]).withColumn(
        "similarity_pct", F.floor(F.col("similarity") * 100 + 0.5).cast("long")
    )


def attribute_decision_time(decisions: DataFrame, provenance: DataFrame, segments: DataFrame) -> DataFrame:
    """Time of the best source segment, else the decision's own, else 00:00."""
    first = provenance.filter("rank = 1 and kind = 'decision'").select("meeting_id", "item_id", "seg_id")
    source = first.join(segments.select("meeting_id", "seg_id", F.col("ts_raw").alias("_ts")), ["meeting_id", "seg_id"])
    own = F.col("ts_raw") if "ts_raw" in decisions.columns else F.lit(None)
    return decisions.join(source.select("meeting_id", "item_id", "_ts"), ["meeting_id", "item_id"], "left").withColumn(
        "attributed_ts", F.coalesce(F.nullif("_ts", F.lit("")), F.nullif(own, F.lit("")), F.lit("00:00"))
    ).drop("_ts")


def preview_lists(rows: DataFrame, column: str, k: int) -> DataFrame:
    return rows.withColumn(column, F.slice(column, 1, k))
