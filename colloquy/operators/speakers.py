"""Who spoke: interval assignment, calendar mapping, activity, mentions, fuzzy names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.containment import contains_pairs


def assign_speakers_by_time(segments: DataFrame, diarization: DataFrame, bucket_s: int = 60) -> DataFrame:
    """First interval [start_s, end_s] that holds a segment's start_s; else the old speaker.

    Intervals are cut into time buckets, so the range condition gets an equi key.
    """
    cut = diarization.select(
        "meeting_id", "start_s", "end_s", F.col("speaker_id").alias("_who"),
        F.explode(F.sequence(F.floor(F.col("start_s") / bucket_s), F.floor(F.col("end_s") / bucket_s))).alias("_bucket"),
    ).alias("d")
    s = segments.withColumn("_bucket", F.floor(F.col("start_s") / bucket_s)).alias("s")
    hit = (
        s.filter("start_s is not null")
        .join(cut, (F.col("s.meeting_id") == F.col("d.meeting_id")) & (F.col("s._bucket") == F.col("d._bucket"))
              & F.col("s.start_s").between(F.col("d.start_s"), F.col("d.end_s")))
        .groupBy(F.col("s.meeting_id").alias("meeting_id"), F.col("s.seg_id").alias("seg_id"))
        .agg(F.min_by("d._who", F.struct("d.start_s", "d.end_s", "d._who")).alias("_who"))
    )
    return (
        segments.join(hit, ["meeting_id", "seg_id"], "left")
        .withColumn("speaker", F.coalesce("_who", "speaker"))
        .select(*segments.columns)
    )


def speaker_activity(segments: DataFrame) -> DataFrame:
    """Turns per speaker and rank in the meeting (ties by first appearance)."""
    counts = segments.filter("speaker is not null").groupBy("meeting_id", "speaker").agg(
        F.count(F.lit(1)).alias("turns"), F.min("seg_id").alias("first_seg")
    )
    w = Window.partitionBy("meeting_id").orderBy(F.desc("turns"), "first_seg")
    return counts.withColumn("activity_rank", F.row_number().over(w))


def map_speakers_to_participants(segments: DataFrame, calendar: DataFrame) -> DataFrame:
    """k-th most active speaker takes the name of the k-th participant, else Speaker_k.

    Meetings without calendar entries keep their speakers.
    """
    ranked = speaker_activity(segments).select("meeting_id", "speaker", "activity_rank")
    slots = calendar.select("meeting_id", F.posexplode("participants").alias("_pos", "_name"))
    invited = calendar.filter(F.size("participants") > 0).select("meeting_id").distinct().withColumn("_has", F.lit(True))
    mapping = (
        ranked.join(invited, "meeting_id")
        .join(slots.withColumn("activity_rank", F.col("_pos") + 1), ["meeting_id", "activity_rank"], "left")
        .select("meeting_id", "speaker", F.coalesce("_name", F.concat(F.lit("Speaker_"), F.col("activity_rank"))).alias("_new"))
    )
    return (
        segments.join(mapping, ["meeting_id", "speaker"], "left")
        .withColumn("speaker", F.coalesce("_new", "speaker"))
        .select(*segments.columns)
    )


def distinct_speakers(segments: DataFrame) -> DataFrame:
    return segments.filter("speaker is not null").select("meeting_id", F.trim("speaker").alias("speaker")).distinct()


def mention_edges(segments: DataFrame) -> DataFrame:
    """How often a speaker names another one who has already spoken."""
    seen = segments.filter("speaker is not null").groupBy("meeting_id", "speaker").agg(F.min("seg_id").alias("first_seg"))
    needles = seen.select("meeting_id", F.col("speaker").alias("mentioned"), F.lower("speaker").alias("_n"))
    spoken = segments.filter("speaker is not null")
    hay = spoken.select("meeting_id", "seg_id", F.lower("text").alias("_t"))
    pairs = contains_pairs(needles, "mentioned", "_n", hay, "seg_id", "_t", ["meeting_id"])
    return (
        pairs.join(spoken.select("meeting_id", "seg_id", "speaker").hint("merge"), ["meeting_id", "seg_id"])
        .join(seen.select("meeting_id", F.col("speaker").alias("mentioned"), "first_seg").hint("merge"), ["meeting_id", "mentioned"])
        .filter("speaker <> mentioned and first_seg <= seg_id")
        .groupBy("meeting_id", "mentioned", F.col("speaker").alias("mentioned_by"))
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


def fill_speakers_from_entities(segments: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows without a speaker take the first listed person named in their text.

    entities(meeting_id, ent_no, name): persons of the meeting in order of preference.
    """
    needles = entities.select("meeting_id", "ent_no", F.lower("name").alias("_n"))
    hay = segments.filter("speaker is null").select("meeting_id", "seg_id", F.lower("text").alias("_t"))
    pairs = contains_pairs(needles, "ent_no", "_n", hay, "seg_id", "_t", ["meeting_id"])
    first = (
        pairs.groupBy("meeting_id", "seg_id").agg(F.min("ent_no").alias("ent_no"))
        .join(entities.select("meeting_id", "ent_no", "name"), ["meeting_id", "ent_no"])
        .select("meeting_id", "seg_id", "name")
    )
    return (
        segments.join(first, ["meeting_id", "seg_id"], "left")
        .withColumn("speaker", F.coalesce("speaker", "name"))
        .select(*segments.columns)
    )


def _counted_characters(low):
    """Characters with their occurrence number: a string's multiset of characters as a set."""
    chars = F.filter(F.split(low, ""), lambda ch: ch != "")
    return F.transform(chars, lambda ch, i: F.concat(ch, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == ch)).cast("string")))


def _block_candidates(n: DataFrame, s: DataFrame, min_ratio: float) -> DataFrame:
    """Pairs (meeting_id, _a, _b) whose matching-block ratio 2·M / T can exceed min_ratio.

    M is at most the number m of counted characters that both hold. A partner of a string of l characters has more than l·r / (2 - r) of
    them in common with it, so two strings whose ratio exceeds r share one of the rarest l - l·r / (2 - r) of each. Only those are joined on;
    then lengths and the full m are checked.
    """
    both = n.select("meeting_id", F.lit("a").alias("side"), F.col("_a").alias("name")).unionByName(s.select("meeting_id", F.lit("b").alias("side"), F.col("_b").alias("name")))
    both = both.withColumn("chars", _counted_characters(F.lower("name")))
    tokens = both.select("meeting_id", "side", "name", F.size("chars").alias("len"), "chars", F.explode("chars").alias("g"))
    often = tokens.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    least = F.floor(F.col("len") * (min_ratio / (2 - min_ratio)) - 1e-9) + 1
    rank = F.row_number().over(Window.partitionBy("meeting_id", "side", "name").orderBy("df", "g"))  # a window holds one name's characters
    prefix = tokens.join(often, "g").withColumn("rank", rank).filter(F.col("rank") <= F.col("len") - least + 1)
    a = prefix.filter("side = 'a'").select("meeting_id", "g", F.col("name").alias("_a"), F.col("chars").alias("_x"))
    b = prefix.filter("side = 'b'").select("meeting_id", "g", F.col("name").alias("_b"), F.col("chars").alias("_y"))
    total = F.size("_x") + F.size("_y")
    met = a.join(b, ["meeting_id", "g"]).filter(2 * F.least(F.size("_x"), F.size("_y")) > min_ratio * total)
    return met.filter(2 * F.size(F.array_intersect("_x", "_y")) > min_ratio * total).select("meeting_id", "_a", "_b").distinct()


def fuzzy_name_join(names: DataFrame, name: str, speakers: DataFrame, min_ratio: float = 0.7, exact: bool = True) -> DataFrame:
    """Most similar speaker above min_ratio for each (meeting_id, name); of equals the first by name.

    The ratio is that of matching blocks, 2·M / T, without regard to case. exact=False takes 1 - levenshtein / longer length instead; two
    strings that close share a character bigram, so candidates meet on bigrams.
    """
    n = names.select("meeting_id", F.col(name).alias("_a")).filter(F.length("_a") > 0).distinct()
    s = speakers.filter("speaker is not null").select("meeting_id", F.col("speaker").alias("_b")).distinct()
    if exact:

        @F.pandas_udf("double")
        def block_ratio(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

        scored = _block_candidates(n, s, min_ratio).withColumn("similarity", block_ratio(F.lower("_a"), F.lower("_b")))
    else:

        def grams(c):
            padded = F.concat(F.lit("\u0001"), F.lower(c), F.lit("\u0002"))
            return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda p: F.substr(padded, p, F.lit(2))))

        a = n.select("meeting_id", "_a", F.explode(grams("_a")).alias("_g"))
        b = s.select("meeting_id", "_b", F.explode(grams("_b")).alias("_g"))
        longer = F.greatest(F.length("_a"), F.length("_b"))
        scored = (a.join(b, ["meeting_id", "_g"]).select("meeting_id", "_a", "_b").distinct()
                  .withColumn("similarity", 1 - F.levenshtein(F.lower("_a"), F.lower("_b")) / longer))
    return (
        scored.filter(F.col("similarity") > min_ratio)
        .groupBy("meeting_id", F.col("_a").alias(name))
        .agg(F.min_by(F.struct("_b", "similarity"), F.struct(-F.col("similarity"), "_b")).alias("_x"))
        .select("meeting_id", name, F.col("_x._b").alias("close_match"), F.col("_x.similarity").alias("similarity"))
    )
