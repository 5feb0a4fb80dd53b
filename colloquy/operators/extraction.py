"""Decisions, action items and risks from segments by the published rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx
from colloquy.operators.dedup import dedup_prefix, first_occurrence
from colloquy.operators.ordering import near_window
from colloquy.operators.windows import decision_participants, extend_text

MEETING = ["meeting_id"]


# --------------------------------------------------------------------------- sentences
def tag_intents(segments: DataFrame, min_chars: int = 10) -> DataFrame:
    """(meeting_id, seg_id, sent_id, sentence, intent, confidence) for every longer sentence."""
    s = segments.select(
        *segments.columns, F.posexplode(tx.sentence_list(F.col("text"))).alias("sent_id", "sentence")
    ).filter(F.length("sentence") >= min_chars)
    intent = (
        F.when(tx.has_any("sentence", rules.INTENT_DECISION), "decision")
        .when(tx.has_any("sentence", rules.INTENT_ACTION), "action")
        .when(tx.has_any("sentence", rules.INTENT_RISK), "risk")
        .otherwise("discussion")
    )
    return s.withColumn("intent", intent).withColumn(
        "confidence", F.when(F.col("intent") == "discussion", 0.4).otherwise(0.6)
    )


# --------------------------------------------------------------------------- decisions
def score_decision_segments(segments: DataFrame) -> DataFrame:
    explicit = tx.has_any("text", rules.EXPLICIT_DECISION)
    implicit = tx.has_any("text", rules.IMPLICIT_DECISION)
    timeline = tx.has_any("text", rules.TIMELINE_DECISION)
    return (
        segments.withColumn("confidence", F.when(explicit, 0.8).when(implicit, 0.6).when(timeline, 0.5).otherwise(0.0))
        .withColumn("decision_type", F.when(explicit, "explicit").otherwise("implicit"))
        .filter("confidence > 0.4")
    )


#: item_id = segment, pattern (below 8) and match (below 2**28) in one number; any INT segment fits.
MATCH_STEP = 1 << 28
ITEM_STEP = 1 << 31

def extract_decisions(segments: DataFrame) -> DataFrame:
    """Default decision path: scored segments with title, category, ±1 context and numbers."""
    near = near_window(
        segments, MEETING, "seg_id", 1, {"supporting": lambda w: F.collect_list("text").over(w.rowsBetween(-1, 1))}
    )
    text = tx.strip("text")
    found = score_decision_segments(near).select(
        "meeting_id",
        F.col("seg_id").cast("long").alias("item_id"),
        "seg_id",
        text.alias("text"),
        tx.decision_title(F.col("text")).alias("title"),
        tx.decision_category(F.col("text")).alias("category"),
        F.array_compact(F.array("speaker")).alias("participants"),
        F.col("speaker"),
        "supporting",
        tx.quantitative(F.col("text")).alias("quantitative"),
        "confidence",
        "decision_type",
    )
    return dedup_prefix(found)


def extract_decisions_patterns(segments: DataFrame) -> DataFrame:
    """Keyword gate, continuation over the next rows, core phrase, rationale, participants."""
    rows = decision_participants(extend_text(segments, 2))
    hits = rows.filter(tx.has_any("text", rules.PATTERN_DECISION))
    core = F.coalesce(*[tx.extract(F.col("decision_text"), p, 0) for p in rules.CORE_DECISION], F.col("decision_text"))
    return hits.select(
        "meeting_id",
        F.col("seg_id").cast("long").alias("item_id"),
        "seg_id",
        tx.strip(core).alias("text"),
        tx.rationale(F.col("decision_text")).alias("rationale"),
        "participants",
        F.lit(0.85).alias("confidence"),
    )


def extract_decisions_basic(segments: DataFrame, similarity: str | None = None) -> DataFrame:
    conf = tx.semantic_confidence(F.col(similarity), F.col("text")) if similarity else tx.keyword_confidence(F.col("text"))
    return segments.filter(tx.has_any("text", rules.BASIC_DECISION)).select(
        "meeting_id", "seg_id", "text", "speaker", "ts_raw", conf.alias("confidence")
    )


# --------------------------------------------------------------------------- actions
def extract_actions(segments: DataFrame, patterns=rules.ACTION_PATTERNS, min_chars: int = 10) -> DataFrame:
    """Every match of every pattern, first occurrence of an action text per meeting."""
    text = F.col("text")
    speaker = F.coalesce(F.col("speaker"), F.lit("Unknown"))
    found = []
    for no, (pattern, owner_group, action_group) in enumerate(patterns):
        actions = tx.extract_all(text, pattern, action_group)
        if owner_group:
            owners = tx.extract_all(text, pattern, owner_group)
        else:
            owners = F.transform(actions, lambda a: speaker)
        found.append(_numbered_matches(no, owners, actions))
    rows = segments.filter(text.rlike("|".join(f"(?:{p})" for p, _, _ in patterns))).select(
        "meeting_id", "seg_id", "text", speaker.alias("_who"), F.explode(F.concat(*found)).alias("m")
    )
    rows = rows.select("meeting_id", "seg_id", "text", "_who", "m.*").filter((F.length("a") >= min_chars) & (F.col("o") != ""))
    kept = first_occurrence(
        rows.withColumn("_key", F.lower("a")), ["meeting_id", "_key"], ["seg_id", "pattern_no", "match_no"]
    )
    return kept.select(
        "meeting_id",
        (F.col("seg_id").cast("long") * ITEM_STEP + F.col("pattern_no") * MATCH_STEP + F.col("match_no")).alias("item_id"),
        "seg_id",
        F.col("a").alias("action"),
        tx.clean_owner(F.col("o"), F.col("_who")).alias("owner"),
        tx.due_date(F.col("text")).alias("due_date"),
        tx.priority(F.col("text")).alias("priority"),
        F.lit(0.85).alias("confidence"),
    )


def _numbered_matches(no: int, owners, actions) -> Column:
    return F.transform(
        F.arrays_zip(owners.alias("o"), actions.alias("a")),
        lambda z, i: F.struct(
            F.lit(no).alias("pattern_no"), i.alias("match_no"), z["o"].alias("o"), tx.drop_trailing_marks(tx.strip(z["a"])).alias("a")
        ),
    )


def extract_actions_basic(segments: DataFrame, similarity: str | None = None) -> DataFrame:
    """Verb gate, then four owner patterns in order, due date, priority and confidence."""
    t = F.col("text")
    who = F.col("speaker")
    p1_owner, p1_action = tx.extract(t, rules.BASIC_PERSON_WILL, 1), tx.strip(tx.extract(t, rules.BASIC_PERSON_WILL, 2))
    p2_owner = tx.extract(t, rules.BASIC_ASSIGNED, 1)
    p2_action = tx.strip(tx.extract(t, rules.BASIC_ASSIGNED_ACTION, 1))
    p3_action = tx.strip(tx.extract(t, rules.BASIC_GROUP_WILL, 1))
    p4_owner, p4_action = tx.extract(t, rules.BASIC_PERSON_SHOULD, 1), tx.strip(tx.extract(t, rules.BASIC_PERSON_SHOULD, 2))

    def undecided(owner):
        return owner.isNull() | owner.eqNullSafe(who)

    rows = segments.filter(tx.has_any("text", rules.ACTION_VERBS))
    rows = rows.withColumn("_o1", F.when(tx.looks_like_name(p1_owner), p1_owner).otherwise(who)).withColumn("_a1", p1_action)
    use2 = undecided(F.col("_o1")) & p2_owner.isNotNull()
    rows = rows.withColumn("_o2", F.when(use2, p2_owner).otherwise(F.col("_o1"))).withColumn(
        "_a2", F.when(use2, F.coalesce(p2_action, "_a1")).otherwise(F.col("_a1"))
    )
    use3 = F.col("_a2").isNull() & p3_action.isNotNull()
    rows = rows.withColumn("_o3", F.when(use3, F.coalesce("_o2", F.lit("Team"))).otherwise(F.col("_o2"))).withColumn(
        "_a3", F.coalesce("_a2", p3_action)
    )
    use4 = undecided(F.col("_o3")) & p4_owner.isNotNull()
    rows = rows.withColumn("owner", F.when(use4 & tx.looks_like_name(p4_owner), p4_owner).otherwise(F.col("_o3"))).withColumn(
        "action", F.coalesce(F.when(use4, p4_action), "_a3", "text")
    )
    conf = (
        tx.semantic_confidence(F.col(similarity), F.col("action")) if similarity else tx.keyword_confidence(F.col("action"))
    )
    return rows.select(
        "meeting_id", "seg_id", "action", "owner",
        tx.first_extract(t, rules.DUE_DATE_BASIC).alias("due_date"),
        tx.priority(F.col("action"), rules.HIGH_PRIORITY_BASIC, rules.LOW_PRIORITY_BASIC).alias("priority"),
        conf.alias("confidence"),
    )


def action_owner_candidates(segments: DataFrame) -> DataFrame:
    """Distinct owner names per segment, in pattern order."""
    found = F.array_distinct(F.flatten(F.array(*[tx.extract_all(F.col("text"), p, 1) for p in rules.ACTION_OWNER_CANDIDATES])))
    return segments.select("meeting_id", "seg_id", F.posexplode(F.transform(found, tx.strip)).alias("owner_no", "owner"))


# --------------------------------------------------------------------------- risks
def extract_risks(segments: DataFrame) -> DataFrame:
    rows = segments.filter(tx.has_any("text", rules.RISK_WORDS)).select(
        "meeting_id", F.col("seg_id").cast("long").alias("item_id"), "seg_id",
        tx.risk_description(F.col("text")).alias("risk"),
        F.coalesce("speaker", F.lit("Unknown")).alias("mentioned_by"),
    ).filter("risk is not null")
    kept = first_occurrence(rows.withColumn("_key", F.lower("risk")), ["meeting_id", "_key"], ["seg_id"])
    return kept.select(
        "meeting_id", "item_id", "seg_id", "risk", tx.risk_category(F.col("risk")).alias("category"),
        "mentioned_by", F.lit(0.85).alias("confidence"),
    )


def extract_risks_basic(segments: DataFrame, similarity: str | None = None) -> DataFrame:
    conf = tx.semantic_confidence(F.col(similarity), F.col("text")) if similarity else tx.keyword_confidence(F.col("text"))
    return segments.filter(tx.has_any("text", rules.BASIC_RISK)).select(
        "meeting_id", "seg_id", F.col("text").alias("risk"), F.col("speaker").alias("mentioned_by"), conf.alias("confidence")
    )


# --------------------------------------------------------------------------- intent-driven variants
def _intent_sentences(
    rows: DataFrame, intent: str, fewer_than: int, topup_words, topup_confidence: float
) -> DataFrame:
    """Tagged sentences, topped up with keyword segments where a meeting has too few.

    Only fewer_than tagged sentences per meeting are ever gathered: that many are
    enough to know that no top-up is due.
    """
    tagged = tag_intents(rows).filter((F.col("intent") == intent) & (F.col("confidence") > 0.5))
    w = Window.partitionBy("meeting_id").orderBy("seg_id", "sent_id")
    few = (
        tagged.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= fewer_than)
        .groupBy("meeting_id").agg(F.collect_list("sentence").alias("_known"))
    )
    extra = (
        rows.filter(tx.has_any("text", topup_words))
        .join(few, "meeting_id", "left")
        .filter(F.coalesce(F.size("_known") < fewer_than, F.lit(True)))
        .filter(~F.coalesce(F.exists("_known", lambda s: F.contains(F.col("text"), s)), F.lit(False)))
        .drop("_known")
        .withColumn("sentence", F.col("text"))
        .withColumn("sent_id", F.lit(-1))
        .withColumn("confidence", F.lit(topup_confidence))
        .withColumn("_late", F.lit(1))
    )
    both = tagged.drop("intent").withColumn("_late", F.lit(0)).unionByName(extra)
    keyed = both.withColumn("_key", tx.strip(F.left(F.lower("sentence"), F.lit(50))))
    return first_occurrence(keyed, ["meeting_id", "_key"], ["_late", "seg_id", "sent_id"]).drop("_key", "_late")


def _texts(first: int, last: int):
    return lambda w: F.array_join(F.collect_list("text").over(w.rowsBetween(first, last)), " ")


def extract_decisions_from_intents(segments: DataFrame) -> DataFrame:
    """Decision sentences (top-up below 3 per meeting) with extended text and participants ±3."""
    rows = decision_participants(
        extend_text(segments, 3, rules.LEGACY_CONTINUATION), "text", 3, rules.GROUP_WORDS_LEGACY, None
    )
    s = _intent_sentences(rows, "decision", 3, rules.TOPUP_DECISION, 0.7)
    # the tail added to the segment is what extends the sentence too
    tail = F.substr("decision_text", F.length("text") + 1)
    text = F.concat("sentence", tail)
    people = F.when(
        F.col("participants") == F.array(F.lit("Meeting participants")), F.array(F.lit("Unclear"))
    ).otherwise(F.array_sort("participants"))
    conf = F.col("confidence") + F.when(tx.has_any("sentence", rules.LEGACY_EXPLICIT_DECISION), 0.15).otherwise(0.0)
    conf = F.least(conf + F.when(F.size("participants") > 1, 0.05).otherwise(0.0), F.lit(1.0))
    title = tx.strip(tx.first_extract(text, rules.LEGACY_DECISION_TITLE))
    return s.select(
        "meeting_id", "seg_id", "sent_id", text.alias("text"),
        F.when(F.length(title) > 50, F.concat(F.left(title, F.lit(50)), F.lit("..."))).otherwise(title).alias("title"),
        tx.rationale(text, rules.RATIONALE_LEGACY).alias("rationale"),
        "speaker", people.alias("participants"), F.round(conf, 2).alias("confidence"),
    )


def owner_from_context(sentence, speaker, context3, previous, persons=None) -> Column:
    """Ordered owner rules over the sentence, its ±3 context and the five previous segments.

    previous: array of structs (text, speaker), oldest first. persons: optional array of
    person names known for the context.
    """

    def named(pattern, where):
        name = F.rtrim(tx.strip(tx.extract(where, pattern, 1)), F.lit(","))
        return F.when(tx.looks_like_name(name), name)

    me = F.coalesce(speaker, F.lit("Unclear"))
    earlier = F.filter(previous, lambda p: F.lower(p["text"]).rlike(rules.OWNER_EARLIER) & p["speaker"].isNotNull())
    options = []
    if persons is not None:
        def assigned(p):
            q = F.concat(F.lit("\\b\\Q"), p, F.lit("\\E\\b"))
            return F.rlike(context3, F.concat(F.lit("(?i)"), q, F.lit(rules.PERSON_AFTER))) | F.rlike(
                context3, F.concat(F.lit("(?i)" + rules.PERSON_BEFORE), q)
            )

        options.append(F.get(F.filter(persons, assigned), F.lit(0)))
    options += [
        named(rules.OWNER_SENTENCE_START, sentence),
        named(rules.OWNER_ASSIGNED, context3),
        tx.extract(context3, rules.OWNER_RESPONSIBLE, 1),
        named(rules.OWNER_CAN_YOU, context3),
        named(rules.OWNER_WANT_YOU, sentence),
        F.when(sentence.rlike(rules.OWNER_FIRST_PERSON), me),
        F.get(earlier, F.lit(0))["speaker"],
        me,
    ]
    return F.coalesce(*options)


def quick_owner(text, speaker) -> Column:
    me = F.coalesce(speaker, F.lit("Unclear"))
    return F.when(text.rlike(rules.OWNER_QUICK_FIRST_PERSON), me).otherwise(
        F.coalesce(tx.extract(text, rules.OWNER_QUICK_NAME, 1), me)
    )


def action_with_details(sentence, owner, context5) -> Column:
    """Action clause plus purpose, people and time phrase found around it."""
    full = F.concat(context5, F.lit("\n"), sentence)
    named = F.when(owner != "Unclear", F.regexp_replace(sentence, F.concat(F.lit("(?i)^\\Q"), owner, F.lit("\\E[,\\s]+")), F.lit("")))
    action = F.coalesce(
        tx.strip(tx.first_extract(full, ["(?i)" + rules.ASK_PHRASE, "(?i)" + rules.DUTY_PHRASE, rules.SELF_DUTY])),
        named, sentence,
    )
    purpose = tx.strip(tx.extract(full, rules.PURPOSE_PHRASE, 1))

    def add_purpose(a):
        low = F.lower(a)
        new = purpose.isNotNull() & ~F.contains(low, purpose) & ~low.contains("for ")
        return F.when(new, F.concat(a, F.lit(" for "), purpose)).otherwise(a)

    contact = F.filter(F.split(full, r"\."), lambda s: F.lower(s).rlike(tx.alternation(rules.CONTACT_WORDS)))
    names = F.flatten(
        F.transform(contact, lambda s: F.array(tx.extract_all(s, rules.TWO_NAMES, 1), tx.extract_all(s, rules.TWO_NAMES + r",\s+", 1)))
    )

    def insert(text, name):
        tagged = F.concat(F.lit("("), name, F.lit(")"))

        def at(parts, left, right):
            return F.concat(F.get(parts, F.lit(0)), F.lit(left), tagged, F.lit(right), F.get(parts, F.lit(1)))

        w = tx.words(text)
        near_end = F.concat_ws(" ", F.array_join(F.slice(w, 1, F.size(w) - 1), " "), tagged, F.element_at(w, -1))
        return (
            F.when(name.isNull(), text)
            .when(text.contains(" by "), at(F.split(text, " by ", 2), " ", " by "))
            .when(text.contains("account manager"), at(F.split(text, "account manager", 2), "account manager ", ""))
            .when(F.size(w) > 3, near_end)
            .otherwise(F.concat_ws(" ", text, tagged))
        )

    def put(text, found):
        new = F.get(F.filter(found, lambda m: ~F.contains(F.lower(text), F.lower(m))), F.lit(0))
        return tx.let(new, lambda name: insert(text, name))

    when_ = tx.strip(tx.extract(full, rules.TIME_PHRASE, 0))

    def add_time(a):
        new = when_.isNotNull() & ~F.lower(a).contains("by ") & ~F.contains(a, when_)
        return F.when(new, F.concat_ws(" ", a, when_)).otherwise(a)

    # one entry per look-up in a clause; at most one name of each is put in
    named_action = F.aggregate(names, tx.let(action, add_purpose), put)
    return tx.clean_action_text(tx.let(named_action, add_time))


def extract_actions_from_intents(segments: DataFrame) -> DataFrame:
    """Action sentences (top-up below 5 per meeting), compound split, owner and details from context."""
    previous = lambda w: F.collect_list(F.struct("text", "speaker")).over(w.rowsBetween(-5, -1))
    rows = near_window(
        segments, MEETING, "seg_id", 5, {"_c3": _texts(-3, 3), "_c5": _texts(-5, 5), "_prev": previous}
    )
    s = _intent_sentences(rows, "action", 5, rules.TOPUP_ACTION, 0.65)
    parts = tx.compound_parts(F.col("sentence"))
    s = s.withColumn("_parts", parts).withColumn("_split", F.size("_parts") > 0)
    s = s.select(
        *[c for c in s.columns if c != "_parts"],
        F.posexplode(F.when(F.col("_split"), F.col("_parts")).otherwise(F.array("sentence"))).alias("part_no", "_part"),
    )
    single_owner = owner_from_context(F.col("sentence"), F.col("speaker"), F.col("_c3"), F.col("_prev"))
    s = s.withColumn("owner", F.when(F.col("_split"), quick_owner(F.col("_part"), F.col("speaker"))).otherwise(single_owner))
    full = F.concat("_c5", F.lit("\n"), "_part")
    s = (
        s.withColumn("action", action_with_details(F.col("_part"), F.col("owner"), F.col("_c5")))
        .withColumn("due_date", tx.due_date_legacy(full))
        .withColumn("priority", tx.priority(full, rules.HIGH_PRIORITY_LEGACY, rules.LOW_PRIORITY_LEGACY))
    )
    dated = F.when(F.col("due_date").isNotNull(), 0.05).otherwise(0.0)
    split_conf = F.lit(0.7) + F.when(F.col("owner") != "Unclear", 0.1).otherwise(0.0) + dated
    conf = F.least(F.col("confidence") + F.when(tx.has_any("sentence", rules.LEGACY_EXPLICIT_ACTION), 0.1).otherwise(0.0), F.lit(1.0))
    unclear = F.col("owner") == "Unclear"
    conf = (
        F.when(unclear & ~F.col("_c5").rlike(rules.LEGACY_UNASSIGNED), F.greatest(conf - 0.15, F.lit(0.3)))
        .when(~unclear, F.least(conf + 0.05, F.lit(1.0)))
        .otherwise(conf)
    )
    rich = (F.length("action") > 50) & F.lower("action").rlike(r"\(|for|by")
    conf = F.least(F.least(conf + dated, F.lit(1.0)) + F.when(rich, 0.05).otherwise(0.0), F.lit(1.0))
    return s.filter("action <> ''").select(
        "meeting_id", "seg_id", "sent_id", "part_no", "action", "owner", "due_date", "priority",
        F.round(F.when(F.col("_split"), split_conf).otherwise(conf), 2).alias("confidence"),
    )


def risk_mitigations(full, following, limit: int = 5) -> Column:
    """Up to five distinct strategies from the context and the next rows (array of texts)."""

    def fits(t):
        return F.length(t).between(10, 150)

    def found(pattern):
        return F.filter(F.transform(tx.extract_all(full, pattern, 1), tx.strip), fits)

    def from_next(t):
        clause = F.when(t.rlike(rules.MITIGATION_FOR), tx.strip(tx.extract(t, rules.MITIGATION_FOR, 1)))
        we = F.when(t.rlike(rules.MITIGATION_WE_NEXT), tx.strip(tx.extract(t, rules.MITIGATION_WE_NEXT, 1)))
        whole = F.when(F.length(t) <= 150, tx.strip(t))
        text = F.when(t.rlike(rules.MITIGATION_FOR), F.when(fits(clause), clause)).when(
            t.rlike(rules.MITIGATION_WE_NEXT), F.when(fits(we), we)
        ).otherwise(whole)
        return F.when(tx.has_any(t, rules.MITIGATION_GATE), text)

    everything = F.concat(
        found(rules.MITIGATION_FOR), found(rules.MITIGATION_BULLET), found(rules.MITIGATION_WE),
        F.array_compact(F.transform(following, from_next)),
    )

    def distinct(found):
        first = lambda low: F.filter(found, lambda m, i: F.array_position(low, F.lower(m)) == i + 1)
        return F.slice(tx.let(F.transform(found, F.lower), first), 1, limit)

    return tx.let(everything, distinct)


def risk_owners(full) -> Column:
    groups = []
    for pattern, n in rules.RISK_OWNER:
        groups += [tx.strip(tx.extract(full, pattern, g + 1)) for g in range(n)]
    listed = F.split(F.regexp_extract(full, rules.RISK_OWNER_LIST, 1), r"\s+and\s+|\s*,\s*")
    people = F.array_compact(F.concat(F.array(*groups), listed))
    return F.array_distinct(F.filter(people, lambda p: (p != "") & tx.looks_like_name(p)))


def extract_risks_from_intents(segments: DataFrame) -> DataFrame:
    """Risk sentences (top-up below 3 per meeting) with title, impact, mitigations and owners."""
    rows = near_window(
        segments, MEETING, "seg_id", 8,
        {"_c8": _texts(-8, 8), "_next": lambda w: F.collect_list("text").over(w.rowsBetween(1, 7))},
    )
    s = _intent_sentences(rows, "risk", 3, rules.TOPUP_RISK, 0.65)
    s = s.withColumn("_full", F.concat("_c8", F.lit("\n"), "sentence"))
    full = F.col("_full")
    s = (
        s.withColumn("risk", tx.clean_risk_text(F.col("sentence"), full))
        .withColumn("title", tx.risk_title(full))
        .withColumn("impact", tx.risk_impact(full))
        .withColumn("mitigation", risk_mitigations(full, F.col("_next")))
        .withColumn("owners", risk_owners(full))
    )
    conf = F.col("confidence") + F.when(tx.has_any("sentence", rules.LEGACY_EXPLICIT_RISK), 0.15).otherwise(0.0)
    conf = conf + F.when(F.size("mitigation") > 0, 0.1).otherwise(0.0) + F.when(F.col("impact").isNotNull(), 0.05).otherwise(0.0)
    conf = F.least(conf + F.when(F.col("title").isNotNull(), 0.05).otherwise(0.0), F.lit(1.0))
    return s.filter("risk <> ''").select(
        "meeting_id", "seg_id", "sent_id", "risk", "title", tx.argmax_category(full).alias("category"),
        tx.risk_priority(full).alias("priority"), "impact", "mitigation", "owners",
        F.coalesce("speaker", F.lit("Unclear")).alias("mentioned_by"), F.round(conf, 2).alias("confidence"),
    )


# --------------------------------------------------------------------------- output shape
def filter_confidence(items: DataFrame, minimum: float = 0.4) -> DataFrame:
    return items.filter(F.col("confidence") >= minimum)


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def decisions_output(d: DataFrame) -> DataFrame:
    first = F.get("participants", F.lit(0))
    return d.select(
        "meeting_id", "item_id", "text", first.alias("speaker"), _col(d, "ts_raw").alias("timestamp"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"), _col(d, "rationale").alias("rationale"),
        *[F.col(c) for c in ("title", "category", "participants", "quantitative", "decision_type") if c in d.columns],
    )


def actions_output(a: DataFrame) -> DataFrame:
    return a.select(
        "meeting_id", "item_id", F.coalesce("action", F.lit("")).alias("action"), F.coalesce("owner", F.lit("Unknown")).alias("owner"),
        "due_date", F.coalesce("priority", F.lit("medium")).alias("priority"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
    )


def risks_output(r: DataFrame) -> DataFrame:
    return r.select(
        "meeting_id", "item_id", F.coalesce("risk", F.lit("")).alias("risk"), "category", "mentioned_by",
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"), _col(r, "impact").alias("impact"),
        _col(r, "mitigation", "array<string>").alias("mitigation"), _col(r, "owner").alias("owner"), _col(r, "priority").alias("priority"),
    )


def clean_model_actions(items: DataFrame) -> DataFrame:
    """Model-made actions: both texts present, owner cleaned, priority in its domain, confidence set."""
    p = F.lower(F.coalesce("priority", F.lit("medium")))
    who = tx.strip(F.regexp_replace("owner", r"Dr\.|Mr\.|Ms\.", ""))
    who = F.when(F.lower(who).isin(rules.PLACEHOLDER_OWNERS), "Unclear").otherwise(who)
    return items.filter("action <> '' and owner <> ''").withColumn("confidence", F.coalesce("confidence", F.lit(0.8))).withColumn(
        "owner", who
    ).withColumn("priority", F.when(p.isin(rules.PRIORITY_DOMAIN), p).otherwise("medium"))


def clean_model_risks(items: DataFrame) -> DataFrame:
    return items.filter(F.length("risk") > 10).withColumn("confidence", F.coalesce("confidence", F.lit(0.8))).withColumn(
        "category", F.when(F.col("category").isin(rules.RISK_DOMAIN), F.col("category")).otherwise("Other")
    )


def default_model_fields(items: DataFrame, confidence: float = 0.9, priority: str = "medium") -> DataFrame:
    return items.withColumn("confidence", F.coalesce("confidence", F.lit(confidence))).withColumn(
        "priority", F.coalesce("priority", F.lit(priority))
    )
