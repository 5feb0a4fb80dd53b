"""Checks of extracted items against their meeting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx
from colloquy.operators.containment import found_in_meeting
from colloquy.operators.speakers import fuzzy_name_join

ITEM = ["meeting_id", "kind", "item_id"]


def word_overlap(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Share of an item's distinct words that occur as words anywhere in its meeting."""
    vocab = segments.select("meeting_id", F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("_w")).distinct()
    w = items.select(*ITEM, F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("_w"))
    hits = w.join(vocab.withColumn("_hit", F.lit(1)), ["meeting_id", "_w"], "left")
    got = hits.groupBy(*ITEM).agg((F.count("_hit") / F.count(F.lit(1))).alias("word_overlap"))
    return items.select(*ITEM).join(got, ITEM, "left").na.fill(0.0, ["word_overlap"])


def _phrases(text):
    def grams(w, n):
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.slice(w, i, n))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<array<string>>"))

    def useful(w):
        runs = F.concat(*[grams(w, n) for n in (2, 3, 4)])
        return F.filter(runs, lambda g: F.size(F.filter(g, lambda x: ~x.isin(rules.STOPWORDS))) * 2 >= F.size(g))

    return F.transform(tx.let(tx.words(F.lower(text)), useful), lambda g: F.array_join(g, " "))


def phrase_support(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Share of an item's 2–4-word phrases (not mostly stop words) found in the meeting text."""
    p = items.select(*ITEM, F.explode(_phrases(F.col("text"))).alias("phrase"))
    found = found_in_meeting(p, "phrase", segments).withColumn("_hit", F.lit(1))
    got = p.join(found, ["meeting_id", "phrase"], "left").groupBy(*ITEM).agg((F.count("_hit") / F.count(F.lit(1))).alias("phrase_support"))
    return items.select(*ITEM).join(got, ITEM, "left").na.fill(0.0, ["phrase_support"])


def source_support(items: DataFrame, segments: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """word_overlap and source_support, the larger of phrase and vector support."""
    out = word_overlap(items, segments).join(phrase_support(items, segments), ITEM)
    if vectors is None:
        return out.withColumnRenamed("phrase_support", "source_support")
    return (
        out.join(vectors, ITEM, "left")
        .withColumn("source_support", F.greatest("phrase_support", F.coalesce("vector_support", F.lit(0.0))))
        .drop("phrase_support", "vector_support")
    )


def _issue(kind: str, severity: str, message: str):
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))


def contradiction_flags(items: DataFrame) -> DataFrame:
    return items.withColumn("contradiction", tx.contradicts(F.col("text")))


def verb_language_flags(items: DataFrame) -> DataFrame:
    return items.withColumn("clear_action_verb", tx.has_whole_token(F.col("text"), rules.CLEAR_ACTION_VERBS)).withColumn(
        "decision_language", tx.has_whole_token(F.col("text"), rules.DECISION_WORDS)
    )


def completeness_flags(items: DataFrame) -> DataFrame:
    t = F.col("text")
    return (
        items.withColumn("too_short", tx.word_count(t) < 3)
        .withColumn("truncated", t.endswith("...") | t.endswith(" and"))
        .withColumn("missing_owner", F.lower(t).contains("will") & ~tx.names_someone(t))
    )


def item_issues(items: DataFrame) -> DataFrame:
    """Array of (type, severity, message) from the text rules of an item's kind."""
    f = completeness_flags(verb_language_flags(contradiction_flags(items)))
    k = F.col("kind")
    checks = [
        (F.col("contradiction"), _issue("contradiction", "high", "Text contains contradictory statements")),
        ((k == "action") & ~F.col("clear_action_verb"), _issue("unclear_action", "medium", "Action lacks clear verb or actionable language")),
        ((k == "decision") & ~F.col("decision_language"), _issue("unclear_decision", "medium", "Decision lacks decisive language")),
        (F.col("too_short"), _issue("too_short", "medium", "Extracted text is very short and may be incomplete")),
        (F.col("truncated"), _issue("truncated", "medium", "Text appears to be truncated")),
        ((k == "action") & F.col("missing_owner"), _issue("missing_owner", "low", "Action item may be missing clear owner assignment")),
    ]
    return f.withColumn("issues", F.array_compact(F.array(*[F.when(c, i) for c, i in checks]))).select(*items.columns, "issues")


def overall_validity(checked: DataFrame) -> DataFrame:
    """Supported by the source and free of high-severity issues."""
    bad = F.exists("issues", lambda i: i["severity"] == "high")
    return checked.withColumn("is_valid", (F.col("source_support") > 0.3) & ~bad)


def validate_items(items: DataFrame, segments: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    support = source_support(items, segments, vectors)
    return overall_validity(item_issues(items.select(*ITEM, "text")).join(support, ITEM))


def validate_owner(items: DataFrame, owner: str, segments: DataFrame) -> DataFrame:
    """Owner is a speaker, is mentioned in the meeting text, or is close to a speaker's name."""
    owners = items.select("meeting_id", owner).filter(F.length(owner) > 0).distinct()
    speakers = segments.filter("speaker is not null").select("meeting_id", F.col("speaker").alias(owner)).distinct()
    low = owners.withColumn("_low", F.lower(owner))
    mentioned = found_in_meeting(low, "_low", segments).withColumn("mentioned_in_text", F.lit(True))
    close = fuzzy_name_join(owners, owner, segments).select("meeting_id", owner, "close_match")
    return (
        low.join(speakers.withColumn("found_as_speaker", F.lit(True)), ["meeting_id", owner], "left")
        .join(mentioned, ["meeting_id", "_low"], "left")
        .join(close, ["meeting_id", owner], "left")
        .na.fill(False, ["found_as_speaker", "mentioned_in_text"])
        .withColumn("is_valid", F.col("found_as_speaker") | F.col("mentioned_in_text"))
        .withColumn("close_match", F.when(~F.col("found_as_speaker"), F.col("close_match")))
        .drop("_low")
    )


def validate_participants(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, item_id, participant, found_in_source, close_match, confidence)."""
    p = decisions.select("meeting_id", "item_id", F.explode("participants").alias("participant")).distinct()
    checked = validate_owner(p, "participant", segments)
    return p.join(checked, ["meeting_id", "participant"]).select(
        "meeting_id", "item_id", "participant", F.col("is_valid").alias("found_in_source"),
        F.when(~F.col("is_valid"), F.col("close_match")).alias("close_match"),
        F.when(F.col("is_valid"), 0.9).when(F.col("close_match").isNotNull(), 0.5).otherwise(0.1).alias("confidence"),
    )


def participant_validation_rate(validated: DataFrame) -> DataFrame:
    return validated.groupBy("meeting_id", "item_id").agg(F.avg(F.col("found_in_source").cast("int")).alias("validation_rate"))


def quantitative_support(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    """Each extracted date and number with whether the meeting text holds it."""

    def part(kind, value):
        return decisions.select("meeting_id", "item_id", F.lit(kind).alias("value_kind"), F.explode(f"quantitative.{value}").alias("value")).distinct()

    values = part("date", "dates").unionByName(part("number", "numbers")).withColumn("_low", F.lower("value"))
    found = found_in_meeting(values, "_low", segments).withColumn("found", F.lit(True))
    return values.join(found, ["meeting_id", "_low"], "left").na.fill(False, ["found"]).drop("_low")
