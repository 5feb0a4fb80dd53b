"""Segment-level queries: cleaning, speakers, neighbourhoods, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import temporal as tp
from colloquy.functions import text as tx
from colloquy.operators import cleaning as cl
from colloquy.operators import extraction as ex
from colloquy.operators import reports as rp
from colloquy.operators import speakers as sp
from colloquy.operators import windows as wi
from colloquy.plans import flow
from colloquy.plans.catalog import CTES, all_of, any_match, cases, ext, first_ext, has, lit, matches, register, strip, title_case, words

SEG = "meeting_id, seg_id"


def _list(terms):
    return "[" + ", ".join(lit(t) for t in terms) + "]"


# ------------------------------------------------------------------ B: filters
_QUIET = f"""
SELECT * FROM seg WHERE NOT (
  (len({words(strip('lower(text)'))}) <= 3 AND {any_match(strip('lower(text)'), rules.SMALL_TALK)})
  OR (len({words(strip('lower(text)'))}) = 1 AND {strip('lower(text)')} IN ({', '.join(lit(x) for x in rules.ACKNOWLEDGEMENTS)})))"""
CTES["quiet"] = _QUIET


@register("drop_small_talk", "SELECT meeting_id, seg_id, speaker, text FROM quiet")
def _(t):
    return cl.drop_small_talk(t.segments).select("meeting_id", "seg_id", "speaker", "text")


_BAD = " OR ".join(matches("trim(speaker)", p) for p in rules.NOT_A_NAME)
CTES["named"] = f"""
SELECT meeting_id, seg_id, ts_raw, text,
  CASE WHEN length(trim(speaker)) >= 2 AND NOT ({_BAD}) AND {matches('trim(speaker)', rules.NAME_SHAPE)} THEN speaker END AS speaker
FROM seg"""


@register("null_invalid_speakers", "SELECT meeting_id, seg_id, speaker FROM named")
def _(t):
    return cl.null_invalid_speakers(t.segments).select("meeting_id", "seg_id", "speaker")


@register("lexicon_match", f"""SELECT meeting_id, seg_id, {has('text', rules.BASIC_DECISION)} AS decision_word,
  {has('text', rules.ACTION_VERBS)} AS action_word, {has('text', rules.BASIC_RISK)} AS risk_word FROM seg""")
def _(t):
    return t.segments.select(
        "meeting_id", "seg_id", tx.has_any("text", rules.BASIC_DECISION).alias("decision_word"),
        tx.has_any("text", rules.ACTION_VERBS).alias("action_word"), tx.has_any("text", rules.BASIC_RISK).alias("risk_word"),
    )


CTES["sentences"] = r"""
SELECT meeting_id, seg_id, speaker, text, u.i - 1 AS sent_id, parts[u.i] AS sentence FROM (
  SELECT *, string_split_regex(text, '[.!?]+\s+') AS parts FROM seg) s, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u
WHERE length(parts[u.i]) >= 10"""
CTES["intents"] = f"""
SELECT *, CASE WHEN intent = 'discussion' THEN 0.4 ELSE 0.6 END::DOUBLE AS confidence FROM (
  SELECT *, CASE WHEN {has('sentence', rules.INTENT_DECISION)} THEN 'decision' WHEN {has('sentence', rules.INTENT_ACTION)} THEN 'action'
    WHEN {has('sentence', rules.INTENT_RISK)} THEN 'risk' ELSE 'discussion' END AS intent FROM sentences) x"""


@register("tag_intents", "SELECT meeting_id, seg_id, sent_id, sentence, intent, confidence FROM intents")
def _(t):
    return ex.tag_intents(t.segments).select("meeting_id", "seg_id", "sent_id", "sentence", "intent", "confidence")


CTES["scored"] = f"""
SELECT *, CASE WHEN {has('text', rules.EXPLICIT_DECISION)} THEN 0.8 WHEN {has('text', rules.IMPLICIT_DECISION)} THEN 0.6
    WHEN {has('text', rules.TIMELINE_DECISION)} THEN 0.5 END::DOUBLE AS confidence,
  CASE WHEN {has('text', rules.EXPLICIT_DECISION)} THEN 'explicit' ELSE 'implicit' END AS decision_type
FROM seg WHERE {has('text', rules.EXPLICIT_DECISION + rules.IMPLICIT_DECISION + rules.TIMELINE_DECISION)}"""


@register("score_decision_segments", "SELECT meeting_id, seg_id, confidence, decision_type FROM scored")
def _(t):
    return ex.score_decision_segments(t.segments).select("meeting_id", "seg_id", "confidence", "decision_type")


_NAME = rf"(len({words('speaker')}) BETWEEN 1 AND 3 AND regexp_matches({words('speaker')}[1], '^\p{{Lu}}.'))"


@register("looks_like_name", f"SELECT meeting_id, seg_id, coalesce({_NAME}, false) AS is_name FROM seg")
def _(t):
    return t.segments.select("meeting_id", "seg_id", F.coalesce(tx.looks_like_name(F.col("speaker")), F.lit(False)).alias("is_name"))


@register("date_format_valid", f"SELECT meeting_id, seg_id, {any_match('lower(text)', rules.DATE_FORMATS)} AS format_valid FROM seg")
def _(t):
    return t.segments.select("meeting_id", "seg_id", tx.date_format_valid(F.col("text")).alias("format_valid"))


@register("segment_lookup", """SELECT w.meeting_id, w.seg_id, s.speaker, s.text FROM (SELECT DISTINCT meeting_id, seg_id + 3 AS seg_id FROM seg) w
  LEFT JOIN seg s ON s.meeting_id = w.meeting_id AND s.seg_id = w.seg_id""")
def _(t):
    from colloquy.operators.provenance import segment_lookup

    wanted = t.segments.select("meeting_id", (F.col("seg_id") + 3).alias("seg_id")).distinct()
    return segment_lookup(wanted, t.segments)


# ------------------------------------------------------------------ C: speakers
CTES["diarized"] = """SELECT conv_id AS meeting_id, 20.0 * turn - 5 AS start_s, 20.0 * turn + 10 AS end_s, concat('spk', turn % 3) AS speaker_id
  FROM conversations WHERE turn % 4 <> 1"""


@register("assign_speakers_by_time", """
SELECT s.meeting_id, s.seg_id, coalesce(d.who, s.speaker) AS speaker FROM seg s LEFT JOIN (
  SELECT s.meeting_id, s.seg_id, arg_min(d.speaker_id, d.start_s) AS who FROM seg s JOIN diarized d
  ON s.meeting_id = d.meeting_id AND s.start_s BETWEEN d.start_s AND d.end_s GROUP BY ALL) d
ON s.meeting_id = d.meeting_id AND s.seg_id = d.seg_id""")
def _(t):
    d = _diarization(t)
    return sp.assign_speakers_by_time(t.segments, d).select("meeting_id", "seg_id", "speaker")


def _diarization(t):
    turn = F.col("turn")
    return t.read("conversations").filter(turn % 4 != 1).select(
        F.col("conv_id").alias("meeting_id"), (turn * 20.0 - 5).alias("start_s"), (turn * 20.0 + 10).alias("end_s"),
        F.concat(F.lit("spk"), (turn % 3).cast("string")).alias("speaker_id"),
    )


def _calendar(t):
    """Suppliers of nation meeting_id % 25, in key order, as the invited people."""
    s = t.read("supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_name")
    people = s.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), 1, 2).alias("p"))
    meetings = t.segments.select("meeting_id", (F.col("meeting_id") % 25).cast("int").alias("k")).distinct()
    return meetings.join(people, "k").select("meeting_id", F.transform("p", lambda x: x["s_name"]).alias("participants"))


CTES["activity"] = """SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY turns DESC, first_seg) AS activity_rank FROM (
  SELECT meeting_id, speaker, count(*) AS turns, min(seg_id) AS first_seg FROM seg WHERE speaker IS NOT NULL GROUP BY ALL) a"""
CTES["calendar"] = """SELECT m.meeting_id, p.people[1:2] AS participants FROM (SELECT DISTINCT meeting_id FROM seg) m
  JOIN (SELECT s_nationkey AS k, list(s_name ORDER BY s_suppkey) AS people FROM supplier GROUP BY 1) p ON m.meeting_id % 25 = p.k"""


@register("map_speakers_to_participants", """
SELECT s.meeting_id, s.seg_id, CASE WHEN c.meeting_id IS NOT NULL AND s.speaker IS NOT NULL
   THEN coalesce(c.participants[a.activity_rank], concat('Speaker_', a.activity_rank)) ELSE s.speaker END AS speaker
FROM seg s LEFT JOIN activity a ON a.meeting_id = s.meeting_id AND a.speaker = s.speaker LEFT JOIN calendar c ON c.meeting_id = s.meeting_id""")
def _(t):
    return sp.map_speakers_to_participants(t.segments, _calendar(t)).select("meeting_id", "seg_id", "speaker")


@register("speaker_activity", "SELECT meeting_id, speaker, turns, first_seg, activity_rank FROM activity")
def _(t):
    return sp.speaker_activity(t.segments)


@register("distinct_speakers", "SELECT DISTINCT meeting_id, trim(speaker) AS speaker FROM seg WHERE speaker IS NOT NULL")
def _(t):
    return sp.distinct_speakers(t.segments)


_BASE = "array_to_string(list_filter(string_split_regex(lower(trim(speaker)), '\\s+'), lambda w: w <> '')[1:2], ' ')"
CTES["canonical"] = f"""
SELECT s.meeting_id, s.seg_id, coalesce(b.canonical, s.speaker) AS speaker FROM seg s LEFT JOIN (
  SELECT meeting_id, {_BASE} AS base, arg_min(trim(speaker), (-length(trim(speaker)), trim(speaker))) AS canonical
  FROM seg WHERE speaker IS NOT NULL GROUP BY ALL) b ON b.meeting_id = s.meeting_id AND b.base = {_BASE.replace('speaker', 's.speaker')}"""


@register("canonicalise_speakers", "SELECT meeting_id, seg_id, speaker FROM canonical")
def _(t):
    return cl.canonicalise_speakers(t.segments).select("meeting_id", "seg_id", "speaker")


CTES["talk"] = """SELECT meeting_id, seg_id, CASE WHEN speaker = 'Ann Lee' THEN 'Ann' WHEN speaker = 'Bob Stone' THEN 'Bob' ELSE speaker END AS speaker, text FROM seg"""


def _talk(t):
    """Segments with short speaker names, so that texts mention them."""
    s = F.col("speaker")
    return t.segments.withColumn("speaker", F.when(s == "Ann Lee", "Ann").when(s == "Bob Stone", "Bob").otherwise(s))


@register("mention_edges", """
SELECT s.meeting_id, f.speaker AS mentioned, s.speaker AS mentioned_by, count(*) AS mentions FROM talk s JOIN (
  SELECT meeting_id, speaker, min(seg_id) AS first_seg FROM talk WHERE speaker IS NOT NULL GROUP BY ALL) f
ON f.meeting_id = s.meeting_id AND f.speaker <> s.speaker AND f.first_seg <= s.seg_id AND contains(lower(s.text), lower(f.speaker)) GROUP BY ALL""")
def _(t):
    return sp.mention_edges(_talk(t))


@register("fill_speaker_from_entities", """
SELECT s.meeting_id, s.seg_id, coalesce(s.speaker, e.name) AS speaker FROM seg s LEFT JOIN (
  SELECT s.meeting_id, s.seg_id, arg_min(e.name, e.ent_no) AS name FROM seg s JOIN people e
  ON e.meeting_id = s.meeting_id AND contains(lower(s.text), lower(e.name)) WHERE s.speaker IS NULL GROUP BY ALL) e
ON e.meeting_id = s.meeting_id AND e.seg_id = s.seg_id""")
def _(t):
    return sp.fill_speakers_from_entities(t.segments, _people(t)).select("meeting_id", "seg_id", "speaker")


def _people(t):
    """First word of every segment that has a speaker, numbered by its first segment."""
    first = F.regexp_extract("text", r"^[A-Z][a-z]+", 0)
    return t.segments.filter("speaker is not null").select("meeting_id", first.alias("name"), "seg_id").filter("name <> ''").groupBy(
        "meeting_id", "name"
    ).agg(F.min("seg_id").alias("ent_no"))


CTES["people"] = """SELECT meeting_id, regexp_extract(text, '^[A-Z][a-z]+') AS name, min(seg_id) AS ent_no FROM seg
  WHERE speaker IS NOT NULL AND regexp_extract(text, '^[A-Z][a-z]+') <> '' GROUP BY ALL"""


@register("fuzzy_name_join", """
SELECT meeting_id, name, arg_min(b, (-sim, b)) AS close_match, max(sim) AS similarity FROM (
  SELECT n.meeting_id, n.name, s.speaker AS b, 1 - levenshtein(lower(n.name), lower(s.speaker)) / greatest(length(n.name), length(s.speaker))::DOUBLE AS sim
  FROM typos n JOIN (SELECT DISTINCT meeting_id, speaker FROM seg WHERE speaker IS NOT NULL) s ON s.meeting_id = n.meeting_id) x
WHERE sim > 0.7 GROUP BY meeting_id, name""")
def _(t):
    return sp.fuzzy_name_join(_typos(t), "name", t.segments, exact=False)


def _typos(t):
    return t.segments.filter("speaker is not null").select("meeting_id", F.regexp_replace("speaker", "o", "oo").alias("name")).distinct()


CTES["typos"] = "SELECT DISTINCT meeting_id, regexp_replace(speaker, 'o', 'oo', 'g') AS name FROM seg WHERE speaker IS NOT NULL"


#: All names that are compared anywhere, against all speakers, in lower case.
CTES["name_pairs"] = """
SELECT DISTINCT n.a, lower(s.speaker) AS b FROM (SELECT lower(name) AS a FROM typos UNION SELECT lower(owner) FROM actions WHERE owner <> ''
  UNION SELECT lower(participant) FROM typo_participants) n, (SELECT DISTINCT speaker FROM seg WHERE speaker IS NOT NULL) s"""
#: Longest common block of a[x0:x1] and b[y0:y1], the first in a, then in b.
_BLOCK = """list_aggregate(flatten(list_transform(range(x0, x1), lambda i: list_transform(range(y0, y1), lambda j:
  {'k': len(list_filter(range(1, least(x1 - i, y1 - j) + 1), lambda n: a[i + 1:i + n] = b[j + 1:j + n])), 'i': -i, 'j': -j}))), 'max')"""
CTES["name_blocks"] = f"""
SELECT *, {_BLOCK} AS m FROM (SELECT a, b, 0::BIGINT AS x0, length(a) AS x1, 0::BIGINT AS y0, length(b) AS y1 FROM name_pairs) x UNION ALL
SELECT *, {_BLOCK} AS m FROM (
  SELECT a, b, CASE WHEN h = 0 THEN x0 ELSE m.k - m.i END AS x0, CASE WHEN h = 0 THEN -m.i ELSE x1 END AS x1,
    CASE WHEN h = 0 THEN y0 ELSE m.k - m.j END AS y0, CASE WHEN h = 0 THEN -m.j ELSE y1 END AS y1
  FROM name_blocks, (VALUES (0), (1)) v(h) WHERE m.k > 0) y WHERE x0 < x1 AND y0 < y1"""
CTES["name_ratios"] = "SELECT a, b, 2.0::DOUBLE * sum(m.k) / (length(a) + length(b)) AS ratio FROM name_blocks GROUP BY a, b"


@register("fuzzy_name_join_blocks", """
SELECT meeting_id, name, arg_min(b, (-ratio, b)) AS close_match, max(ratio) AS similarity FROM (
  SELECT n.meeting_id, n.name, s.speaker AS b, r.ratio FROM typos n JOIN (SELECT DISTINCT meeting_id, speaker FROM seg WHERE speaker IS NOT NULL) s ON s.meeting_id = n.meeting_id
  JOIN name_ratios r ON r.a = lower(n.name) AND r.b = lower(s.speaker)) x WHERE ratio > 0.7 GROUP BY meeting_id, name""")
def _(t):
    """Same with the matching-block ratio."""
    return sp.fuzzy_name_join(_typos(t), "name", t.segments)


# ------------------------------------------------------------------ H: cleaning functions
_F1 = [f for f in rules.FILLERS if " " not in f]
_F2 = [f for f in rules.FILLERS if " " in f]
_FILL = f"""array_to_string(list_filter(w, lambda x, i:
   NOT (list_contains({_list(_F2)}, lower(x || ' ' || coalesce(w[i+1], '~~'))) OR list_contains({_list(_F2)}, lower(coalesce(CASE WHEN i > 1 THEN w[i-1] END, '~~') || ' ' || x))
        OR list_contains({_list(_F1)}, rtrim(lower(x), '.,!?;:')))), ' ')"""


@register("strip_fillers", f"SELECT * FROM (SELECT meeting_id, seg_id, {_FILL} AS text FROM (SELECT *, {words('text')} AS w FROM seg) s) x WHERE text <> ''")
def _(t):
    return t.segments.select("meeting_id", "seg_id", tx.strip_fillers(F.col("text")).alias("text")).filter("text <> ''")


@register("collapse_repeats")
def _(t):
    return t.segments.select("meeting_id", "seg_id", tx.collapse_repeats(F.col("text")).alias("text"))


@register("restore_punctuation")
def _(t):
    return t.segments.select("meeting_id", "seg_id", tx.restore_punctuation(F.lower(F.regexp_replace("text", "[.,!?]", ""))).alias("text"))


_N = f"array_to_string({words('n')}, ' ')"
_NORM = rf"""CASE WHEN len(string_split({_N}, ',')) = 2 THEN trim(string_split({_N}, ',')[2]) || ' ' || trim(string_split({_N}, ',')[1])
  ELSE trim(regexp_replace(regexp_replace({_N}, '\b[A-Z]\.\s*', '', 'g'), '(?i)\b(Dr|Mr|Ms|Mrs)\.\s*', '', 'g')) END"""


@register("normalise_name", f"SELECT c_custkey, {_NORM} AS name FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('Stone,  ', c_name) WHEN 1 THEN concat('Dr. J. ', c_name) WHEN 2 THEN concat('Mrs.  Ann   ', c_name) ELSE c_name END AS n FROM customer) c")
def _(t):
    k = F.col("c_custkey") % 4
    n = F.when(k == 0, F.concat(F.lit("Stone,  "), "c_name")).when(k == 1, F.concat(F.lit("Dr. J. "), "c_name")).when(
        k == 2, F.concat(F.lit("Mrs.  Ann   "), "c_name")
    ).otherwise(F.col("c_name"))
    return t.read("customer").select("c_custkey", tx.normalise_name(n).alias("name"))


@register("clean_owner", rf"""
SELECT meeting_id, seg_id, CASE WHEN o IS NULL OR o = '' THEN 'Unclear' WHEN lower({strip('o')}) IN ('i', 'i''ll', 'i''m') THEN coalesce(speaker, 'Unknown')
  WHEN lower({strip('o')}) = 'you' THEN 'Unclear' ELSE {title_case("regexp_replace(" + strip('o') + ", " + lit(rules.TITLES) + ", '')")} END AS owner
FROM (SELECT *, regexp_extract(text, '(?i)^(dr\. \w+|\w+)') AS o FROM seg) s""")
def _(t):
    o = F.regexp_extract("text", r"(?i)^(dr\. \w+|\w+)", 0)
    return t.segments.select("meeting_id", "seg_id", tx.clean_owner(o, F.coalesce("speaker", F.lit("Unknown"))).alias("owner"))


@register("timestamp_to_seconds", """SELECT meeting_id, seg_id, CASE len(string_split(ts, ':')) WHEN 2 THEN try_cast(string_split(ts, ':')[1] AS INT) * 60 + try_cast(string_split(ts, ':')[2] AS INT)
   WHEN 3 THEN try_cast(string_split(ts, ':')[1] AS INT) * 3600 + try_cast(string_split(ts, ':')[2] AS INT) * 60 + try_cast(string_split(ts, ':')[3] AS INT)
   WHEN 1 THEN try_cast(ts AS DOUBLE) END::DOUBLE AS seconds
FROM (SELECT meeting_id, seg_id, CASE seg_id % 3 WHEN 0 THEN ts_raw WHEN 1 THEN concat('1:', ts_raw) ELSE concat(seg_id, '.5') END AS ts FROM seg) s""")
def _(t):
    k = F.col("seg_id") % 3
    ts = F.when(k == 0, F.col("ts_raw")).when(k == 1, F.concat(F.lit("1:"), "ts_raw")).otherwise(F.concat(F.col("seg_id").cast("string"), F.lit(".5")))
    return t.segments.select("meeting_id", "seg_id", tx.timestamp_to_seconds(ts).alias("seconds"))


@register("label_by_keyword", """
SELECT meeting_id, seg_id, label, score, row_number() OVER (PARTITION BY meeting_id, seg_id ORDER BY score DESC, n) AS label_rank FROM (
  SELECT meeting_id, seg_id, l.label, l.n, CASE WHEN contains(lower(text), l.label) THEN 0.7 ELSE 0.3 / 4 END::DOUBLE AS score
  FROM seg, (VALUES (0, 'risk'), (1, 'budget'), (2, 'review'), (3, 'launch')) l(n, label)) x""")
def _(t):
    scored = t.segments.select("meeting_id", "seg_id", F.posexplode(tx.label_scores(F.col("text"), ["risk", "budget", "review", "launch"])).alias("p", "l"))
    return scored.select("meeting_id", "seg_id", "l.label", "l.score", (F.col("p") + 1).alias("label_rank"))


@register("tidy_summary", rf"SELECT doc_id, regexp_replace({strip(r'''regexp_replace(text, '\s+', ' ', 'g')''')}, '\.\s+\.', '.', 'g') AS text FROM documents")
def _(t):
    return t.read("documents").select("doc_id", tx.tidy_summary(F.col("text")).alias("text"))


# ------------------------------------------------------------------ H25, H26: dates
_REF = "TIMESTAMP '2025-03-14 10:30:00' + to_days(CAST(meeting_id % 7 AS INT))"
_PHRASES = ["today", "tomorrow", "next week", "next month", "next quarter", "next year", "in 3 days", "in 2 weeks", "in 5 months", "EOD", "ASAP", "last month", "someday", "yesterday"]


def _ref():
    return F.expr("TIMESTAMP '2025-03-14 10:30:00' + make_dt_interval(CAST(meeting_id % 7 AS INT))")


@register("resolve_relative_date", f"""
SELECT meeting_id, seg_id, phrase, strftime(CASE lower(phrase) WHEN 'today' THEN ref WHEN 'tomorrow' THEN ref + INTERVAL 1 DAY WHEN 'yesterday' THEN ref - INTERVAL 1 DAY
   WHEN 'next week' THEN ref + INTERVAL 7 DAY WHEN 'next month' THEN ref + INTERVAL 1 MONTH WHEN 'next quarter' THEN ref + INTERVAL 3 MONTH WHEN 'next year' THEN ref + INTERVAL 1 YEAR
   WHEN 'in 3 days' THEN ref + INTERVAL 3 DAY WHEN 'in 2 weeks' THEN ref + INTERVAL 14 DAY WHEN 'in 5 months' THEN ref + INTERVAL 5 MONTH WHEN 'last month' THEN ref - INTERVAL 1 MONTH
   WHEN 'eod' THEN date_trunc('day', ref) + INTERVAL 17 HOUR WHEN 'asap' THEN ref + INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS resolved
FROM (SELECT meeting_id, seg_id, {_REF} AS ref, {_list(_PHRASES)}[CAST((meeting_id + seg_id) % {len(_PHRASES)} AS INT) + 1] AS phrase FROM seg) s""")
def _(t):
    phrase = F.element_at(tx.lit_array(_PHRASES), ((F.col("meeting_id") + F.col("seg_id")) % len(_PHRASES)).cast("int") + 1)
    return t.segments.select("meeting_id", "seg_id", phrase.alias("phrase"), tp.resolve_relative_date(phrase, _ref()).alias("resolved"))


@register("business_day_add", """
SELECT event_id, isodow(d) < 6 AS is_business_day, strftime((SELECT min(x) FROM (SELECT d + CAST(g AS INT) AS x, sum(CASE WHEN isodow(d + CAST(g AS INT)) < 6 THEN 1 ELSE 0 END) OVER (ORDER BY g) AS n
   FROM (SELECT unnest(range(1, 30)) AS g) gg) y WHERE y.n = k), '%Y-%m-%d') AS due FROM (SELECT event_id, CAST(ts AS DATE) AS d, event_id % 9 + 1 AS k FROM events) e""")
def _(t):
    d = F.to_date("ts")
    return t.read("events").select(
        "event_id", tp.is_business_day(d).alias("is_business_day"), tp.business_day_add(d, (F.col("event_id") % 9 + 1).cast("int")).alias("due")
    )


# ------------------------------------------------------------------ E: windows
@register("context_window", r"""
SELECT meeting_id, seg_id, array_to_string(list(text) OVER (PARTITION BY meeting_id ORDER BY seg_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '|') AS context FROM seg""")
def _(t):
    return wi.context_window(t.segments, 2).select("meeting_id", "seg_id", "context")


_STEP = f"(t{{0}} IS NOT NULL AND (s{{0}} IS NOT DISTINCT FROM speaker OR {has('t{0}', rules.CONTINUATION_WORDS)}))"
CTES["extended"] = f"""
SELECT meeting_id, seg_id, speaker, ts_raw, text, text || CASE WHEN {_STEP.format(1)} THEN ' ' || t1 || CASE WHEN {_STEP.format(2)} THEN ' ' || t2 ELSE '' END ELSE '' END AS decision_text
FROM (SELECT *, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(speaker, 1) OVER w AS s1, lead(speaker, 2) OVER w AS s2
      FROM seg WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_id)) x"""


@register("extend_decision_text", "SELECT meeting_id, seg_id, decision_text FROM extended")
def _(t):
    return wi.extend_text(t.segments).select("meeting_id", "seg_id", "decision_text")


CTES["with_people"] = f"""
SELECT *, CASE WHEN len(p) > 0 THEN p ELSE ['Meeting participants'] END AS participants FROM (
 SELECT *, CASE WHEN {matches('lower(decision_text)', rules.GROUP_WORDS)} THEN (list_reduce(list_concat([[]::VARCHAR[]], list_transform(list_concat(own, near), lambda q: [q])),
     lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END))[1:5] ELSE own END AS p
 FROM (SELECT *, CASE WHEN speaker IS NULL THEN []::VARCHAR[] ELSE [speaker] END AS own, coalesce(list(speaker) FILTER (speaker IS NOT NULL) OVER (PARTITION BY meeting_id ORDER BY seg_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), []::VARCHAR[]) AS near FROM extended) x) y"""


@register("decision_participants", "SELECT meeting_id, seg_id, array_to_string(participants, '|') AS participants FROM with_people")
def _(t):
    return wi.decision_participants(wi.extend_text(t.segments)).select("meeting_id", "seg_id", "participants")


@register("budget_prefix", f"""
SELECT meeting_id, seg_id, line, words_so_far FROM (
  SELECT meeting_id, seg_id, line, CAST(sum(len({words('line')})) OVER (PARTITION BY meeting_id ORDER BY seg_id) AS BIGINT) AS words_so_far
  FROM (SELECT *, coalesce(speaker, 'Speaker') || ': ' || text AS line FROM seg) s) x WHERE words_so_far * 1.3 <= 100""")
def _(t):
    return wi.budget_prefix(t.segments, 100).select("meeting_id", "seg_id", "line", "words_so_far")


@register("word_chunks", f"""
SELECT doc_id, i AS chunk_no, array_to_string(w[i*75+1 : i*75+75], ' ') AS chunk FROM (
  SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil(len(w) / 75.0) AS BIGINT), 1))) AS i FROM (SELECT doc_id, {words('text')} AS w FROM documents) d) x""")
def _(t):
    return wi.word_chunks(t.read("documents"), "doc_id", 100)


_PRO = _list(rules.PRONOUNS)


@register("resolve_pronouns", f"""
SELECT meeting_id, seg_id, CASE WHEN speaker IS NULL OR text = '' THEN text WHEN len(others) = 1
   THEN array_to_string(list_transform({words('text')}, lambda x: CASE WHEN list_contains({_PRO}, trim(lower(x), '.,!?')) THEN others[1] ELSE x END), ' ')
   ELSE array_to_string({words('text')}, ' ') END AS text
FROM (SELECT *, list_distinct(list_filter(near, lambda s: s IS NOT NULL AND s <> speaker)) AS others FROM (
  SELECT *, coalesce(list(speaker) OVER (PARTITION BY meeting_id ORDER BY seg_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []::VARCHAR[]) AS near FROM seg) x) y""")
def _(t):
    return wi.resolve_pronouns(t.segments).select("meeting_id", "seg_id", "text")


@register("merge_short_turns")
def _(t):
    return cl.merge_short_turns(t.segments).select("meeting_id", "seg_id", "speaker", "text")


@register("budget_chunks")
def _(t):
    return wi.budget_chunks(t.segments, 60).select("meeting_id", "seg_id", "chunk_no")


@register("overlap_chunks")
def _(t):
    return wi.overlap_chunks(t.read("documents"), "doc_id", 2000, 200)


# ------------------------------------------------------------------ A7, L1, L2, D22
@register("render_text", r"""
SELECT meeting_id, CAST(seg_id // 1000 AS BIGINT) AS part_no, string_agg(CASE WHEN speaker IS NULL THEN text ELSE speaker || ': ' || text END, chr(10) ORDER BY seg_id) AS text
FROM seg GROUP BY ALL""")
def _(t):
    return rp.render_text(t.segments)


@register("preprocess")
def _(t):
    return flow.preprocess(t.segments).select("meeting_id", "seg_id", "speaker", "text")


@register("preprocessing_counters")
def _(t):
    return flow.preprocess_counters(t.segments)


@register("enhanced_preprocess")
def _(t):
    return flow.enhanced_preprocess(t.segments, _diarization(t), _calendar(t)).select("meeting_id", "seg_id", "speaker", "text")
