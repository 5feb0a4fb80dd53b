"""Cleaning of the segments table: small talk, short turns, fillers, speaker names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx
from colloquy.operators.ordering import near_window, running_sums, scan_states

MEETING = ["meeting_id"]


def drop_small_talk(segments: DataFrame, patterns=rules.SMALL_TALK, single=rules.ACKNOWLEDGEMENTS) -> DataFrame:
    low = tx.strip(F.lower("text"))
    n = tx.word_count(low)
    greeting = low.rlike("|".join(f"(?:{p})" for p in patterns))
    return segments.filter(~(((n <= 3) & greeting) | ((n == 1) & low.isin(single))))


def valid_speaker(c, not_a_name=rules.NOT_A_NAME):
    s = tx.strip(c)
    bad = F.lit(False)
    for p in not_a_name:
        bad = bad | s.rlike(p)
    return (F.length(s) >= 2) & ~bad & s.rlike(rules.NAME_SHAPE)


def null_invalid_speakers(segments: DataFrame, not_speakers: tuple[str, ...] = ()) -> DataFrame:
    """Keep every row, clear speakers that do not look like a name (or are listed)."""
    ok = valid_speaker(F.col("speaker"))
    if not_speakers:
        ok = ok & ~F.col("speaker").isin(*not_speakers)
    return segments.withColumn("speaker", F.when(ok, F.col("speaker")))


def canonicalise_speakers(segments: DataFrame) -> DataFrame:
    """Names sharing their first two words (or the only word) take the longest form."""
    s = F.trim("speaker")
    base = F.array_join(F.slice(tx.words(F.lower(s)), 1, 2), " ")
    variants = segments.filter(F.col("speaker").isNotNull()).select("meeting_id", s.alias("_name"), base.alias("_base")).distinct()
    best = variants.groupBy("meeting_id", "_base").agg(
        F.min_by("_name", F.struct(-F.length("_name"), "_name")).alias("_canonical")
    )
    names = variants.join(best, ["meeting_id", "_base"]).select("meeting_id", "_name", "_canonical")
    return (
        segments.withColumn("_name", s)
        .join(names, ["meeting_id", "_name"], "left")
        .withColumn("speaker", F.coalesce("_canonical", "speaker"))
        .select(*segments.columns)
    )


def normalise_names(segments: DataFrame) -> DataFrame:
    return segments.withColumn("speaker", tx.normalise_name(F.col("speaker")))


def merge_short_turns(segments: DataFrame, min_words: int = 10) -> DataFrame:
    """A turn under `min_words` words takes in the next row of the same known speaker.

    The state is the number of words in the open turn, capped at min_words.
    """
    same = lambda w: F.coalesce(F.lag("speaker").over(w) == F.col("speaker"), F.lit(False))
    rows = near_window(segments, MEETING, "seg_id", 1, {"_same": same}).withColumn("_words", tx.word_count("text"))

    def step(open_words, same_speaker, n):
        joined = same_speaker & (open_words < min_words)
        return np.minimum(np.where(joined, open_words + n, n), min_words)

    scanned = scan_states(rows, MEETING, "seg_id", ["_same", "_words"], min_words + 1, step)
    starts = F.when(F.col("_same") & (F.col("state_before") < min_words), 0).otherwise(1)
    turns = running_sums(scanned, MEETING, "seg_id", {"_turn": starts})
    text = tx.strip("text")
    pieces = F.array_sort(F.collect_list(F.when(text != "", F.struct("seg_id", text.alias("t")))))
    rest = [c for c in segments.columns if c not in ("meeting_id", "seg_id", "text")]
    return (
        turns.groupBy("meeting_id", "_turn")
        .agg(
            F.min("seg_id").alias("seg_id"),
            F.array_join(F.transform(pieces, lambda p: p["t"]), " ").alias("text"),
            *[F.min_by(c, "seg_id").alias(c) for c in rest],
        )
        .select(*segments.columns)
    )


def clean_text(segments: DataFrame, fillers=rules.FILLERS) -> DataFrame:
    """Fillers out, immediate repeats collapsed, empty rows dropped."""
    return segments.withColumn("text", tx.collapse_repeats(tx.strip_fillers(F.col("text"), fillers))).filter("text <> ''")


def count_stages(stages: dict[str, DataFrame]) -> DataFrame:
    """One row per meeting with the row count after every stage."""
    out = None
    for name, df in stages.items():
        n = df.groupBy("meeting_id").agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, "meeting_id", "full_outer")
    return out.na.fill(0, list(stages))
