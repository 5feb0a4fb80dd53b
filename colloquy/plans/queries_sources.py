"""Source-level queries: transcript formats, reports, status log, model replies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colloquy import rules
from colloquy.operators import evaluation as ev
from colloquy.operators import reports as rp
from colloquy.plans.catalog import CTES, ext, has, lit, matches, register, strip, title_case
from colloquy.session import use_checkpoint_dir
from colloquy.sources import replies as rs
from colloquy.sources import results as sr
from colloquy.sources import transcripts as st

CHEN = "Chen, David (Lead)   0:"


def _files(t, body):
    """Documents as transcript files: every line is dressed by its number."""
    lines = F.split("text", "\n")
    return t.read("documents").select(F.col("doc_id").alias("meeting_id"), body(lines).alias("content"))


def _text_files(t):
    def dress(line, i):
        k = i % 5
        return (
            F.when(k == 0, F.concat(F.lit(CHEN), F.lpad((i % 60).cast("string"), 2, "0")))
            .when(k == 2, F.concat(F.lit("Ann Lee: "), line)).when(k == 3, F.lit("")).otherwise(line)
        )

    return _files(t, lambda lines: F.array_join(F.transform(lines, dress), "\n"))


CTES["text_files"] = f"""
SELECT doc_id AS meeting_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i-1) % 5 WHEN 0 THEN {lit(CHEN)} || lpad(CAST((i-1) % 60 AS VARCHAR), 2, '0')
   WHEN 2 THEN 'Ann Lee: ' || x WHEN 3 THEN '' ELSE x END), chr(10)) AS content FROM documents"""
_HDR = lambda c, g: f"coalesce({ext(c, rules.HEADER_LAST_FIRST, g)}, {ext(c, rules.HEADER_FIRST_LAST, g)})"
CTES["text_lines"] = f"""
SELECT *, CASE WHEN line = '' THEN 'blank' WHEN {matches('line', rules.HEADER_LAST_FIRST)} OR {matches('line', rules.HEADER_FIRST_LAST)} THEN 'header'
   WHEN {matches('line', rules.SPEAKER_COLON)} THEN 'colon' WHEN {matches('line', rules.BARE_TIMESTAMP)} THEN 'time' ELSE 'plain' END AS kind
FROM (SELECT meeting_id, pos, {strip('raw')} AS line FROM (SELECT meeting_id, unnest(string_split(content, chr(10))) AS raw, unnest(range(len(string_split(content, chr(10))))) AS pos FROM text_files) x) y"""
CTES["text_marked"] = f"""
SELECT *, sum(CASE WHEN kind IN ('blank', 'header', 'colon') THEN 1 ELSE 0 END) OVER w AS turn,
   nullif(last_value(who IGNORE NULLS) OVER w, '') AS speaker, nullif(last_value(ts IGNORE NULLS) OVER w, '') AS ts_raw FROM (
  SELECT *, CASE WHEN cleared THEN '' WHEN kind = 'header' THEN CASE WHEN len(string_split(nm, ',')) = 2 THEN {strip("string_split(nm, ',')[2]")} || ' ' || {strip("string_split(nm, ',')[1]")} ELSE nm END
     WHEN kind = 'colon' THEN regexp_extract(line, {lit(rules.SPEAKER_COLON)}, 1) END AS who,
     CASE WHEN cleared THEN '' WHEN kind = 'header' THEN {_HDR('line', 2)} WHEN kind = 'time' THEN line END AS ts,
     CASE WHEN kind = 'colon' THEN trim(regexp_extract(line, {lit(rules.SPEAKER_COLON)}, 2), ']') ELSE line END AS piece
  FROM (SELECT *, kind = 'blank' AND coalesce(lag(kind IN ('colon', 'plain')) OVER (PARTITION BY meeting_id ORDER BY pos), false) AS cleared,
        regexp_replace({strip(_HDR('line', 1))}, '\\s*\\([^)]+\\)$', '') AS nm FROM text_lines) a) b
WINDOW w AS (PARTITION BY meeting_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"""
_TURNS = """
SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY turn) - 1 AS seg_id, speaker, ts_raw, text FROM (
  SELECT meeting_id, turn, arg_min(speaker, pos) AS s0, first(speaker ORDER BY pos) AS speaker, first(ts_raw ORDER BY pos) AS ts_raw, {text} AS text
  FROM {src} WHERE {cond} GROUP BY meeting_id, turn) t WHERE text <> ''"""


@register("segments_from_text", _TURNS.format(src="text_marked", cond="kind IN ('colon', 'plain')", text=strip("string_agg(piece, ' ' ORDER BY pos)")))
def _(t):
    return st.segments_from_text(_text_files(t)).drop("start_s")


def _speaker_files(t):
    def dress(line, i):
        k = i % 4
        return F.when(k == 1, F.concat(F.lit("Ann Lee: "), line)).when(k == 3, F.concat(F.lit("[Bob] "), line)).otherwise(line)

    return _files(t, lambda lines: F.array_join(F.transform(lines, dress), "\n"))


_SPK = "coalesce(" + ", ".join(ext("line", p, 1) for p in rules.LINE_SPEAKER) + ")"
_BARE = "line"
for _p in rules.LINE_SPEAKER:
    _BARE = strip(f"regexp_replace({_BARE}, {lit(_p)}, '')")
_BARE = strip(f"regexp_replace({_BARE}, '^:+', '')")
CTES["spoken_lines"] = f"""
SELECT meeting_id, pos, CASE WHEN spk IS NULL THEN line ELSE {_BARE} END AS piece, sum(CASE WHEN spk IS NULL THEN 0 ELSE 1 END) OVER w AS turn, last_value(spk IGNORE NULLS) OVER w AS speaker, NULL AS ts_raw
FROM (SELECT *, {_SPK} AS spk FROM (SELECT meeting_id, pos, {strip('raw')} AS line FROM (
   SELECT doc_id AS meeting_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i-1) % 4 WHEN 1 THEN 'Ann Lee: ' || x WHEN 3 THEN '[Bob] ' || x ELSE x END)) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) a) b WHERE line <> '') c
WINDOW w AS (PARTITION BY meeting_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"""


@register("segments_from_speaker_lines", _TURNS.format(src="spoken_lines", cond="turn >= 1 AND piece <> ''", text=strip("string_agg(piece, ' ' ORDER BY pos)")))
def _(t):
    return st.segments_from_speaker_lines(_speaker_files(t)).drop("start_s")


def _json_files(t):
    k = F.col("doc_id") % 3
    lines = F.split("text", "\n")
    items = F.transform(lines, lambda x, i: F.struct(x.alias("text"), F.concat(F.lit("S"), (i % 3).cast("string")).alias("speaker"), F.concat((i % 50).cast("string"), F.lit(":05")).alias("timestamp")))
    body = (
        F.when(k == 0, F.to_json(F.struct(items.alias("transcript"))))
        .when(k == 1, F.to_json(F.struct(items.alias("segments"))))
        .otherwise(F.to_json(F.struct(lines.alias("transcript"), F.array(F.lit("Ann"), F.lit("Bob")).alias("speakers"))))
    )
    return t.read("documents").select(F.col("doc_id").alias("meeting_id"), body.alias("content"))


CTES["json_files"] = """
SELECT doc_id AS meeting_id, CASE doc_id % 3 WHEN 0 THEN CAST(to_json({'transcript': items}) AS VARCHAR) WHEN 1 THEN CAST(to_json({'segments': items}) AS VARCHAR)
   ELSE CAST(to_json({'transcript': string_split(text, chr(10)), 'speakers': ['Ann', 'Bob']}) AS VARCHAR) END AS content
FROM (SELECT *, list_transform(string_split(text, chr(10)), lambda x, i: {'text': x, 'speaker': 'S' || ((i-1) % 3), 'timestamp': ((i-1) % 50) || ':05'}) AS items FROM documents) d"""


@register("segments_from_json", f"""
SELECT meeting_id, i AS seg_id, coalesce(json_extract_string(item, '$.speaker'), json_extract_string(content, '$.speakers[' || i || ']')) AS speaker,
   json_extract_string(item, '$.timestamp') AS ts_raw, {strip("CASE WHEN json_type(item) = 'OBJECT' THEN coalesce(json_extract_string(item, '$.text'), json_extract_string(item, '$.content'), '') ELSE json_extract_string(item, '$') END")} AS text
FROM (SELECT meeting_id, content, unnest(l) AS item, unnest(range(len(l))) AS i FROM (
   SELECT *, CASE WHEN json_exists(content, '$.transcript') THEN json_extract(content, '$.transcript[*]') ELSE json_extract(content, '$.segments[*]') END AS l FROM json_files) a) b""")
def _(t):
    return st.segments_from_json(_json_files(t)).drop("start_s")


def _srt_files(t):
    def cue(x, i):
        who = F.when(i % 3 == 0, "[Ann Lee] ").when(i % 3 == 1, "Bob: ").otherwise("")
        return F.concat((i + 1).cast("string"), F.lit("\n00:00:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(",000 --> 00:00:59,500\n"), who, x)

    return _files(t, lambda lines: F.array_join(F.transform(lines, cue), "\n\n"))


CTES["srt_files"] = r"""
SELECT doc_id AS meeting_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CAST(i AS VARCHAR) || chr(10) || '00:00:' || lpad(CAST((i-1) % 60 AS VARCHAR), 2, '0') || ',000 --> 00:00:59,500' || chr(10)
   || CASE (i-1) % 3 WHEN 0 THEN '[Ann Lee] ' WHEN 1 THEN 'Bob: ' ELSE '' END || x), chr(10) || chr(10)) AS content FROM documents"""
_T2 = f"coalesce({ext('t', rules.SRT_BRACKET, 2)}, {ext('t', rules.SRT_COLON, 2)}, t)"


@register("segments_from_srt", rf"""
SELECT meeting_id, seg_id, coalesce({ext('t', rules.SRT_BRACKET, 1)}, {ext('t', rules.SRT_COLON, 1)}) AS speaker, CASE WHEN {matches('l[2]', '^' + rules.SRT_ARROW)} THEN l[2] END AS ts_raw, {strip(_T2)} AS text FROM (
 SELECT meeting_id, seg_id, l, array_to_string(list_filter(list_transform(l[3:], lambda x: {strip('x')}), lambda x: x <> ''), ' ') AS t FROM (
  SELECT meeting_id, unnest(cues) AS l, unnest(range(len(cues))) AS seg_id FROM (
   SELECT meeting_id, list_filter(list_transform(string_split_regex({strip('content')}, '\n\s*\n'), lambda b: string_split({strip('b')}, chr(10))), lambda c: len(c) >= 2) AS cues FROM srt_files) a) b) c""")
def _(t):
    return st.segments_from_srt(_srt_files(t)).drop("start_s")


@register("route_format", f"""
SELECT doc_id, CASE WHEN ext = 'json' THEN 'json' WHEN ext = 'srt' THEN 'srt' WHEN ext = 'txt' AND {matches('head', rules.SRT_ARROW)} THEN 'srt' ELSE 'txt' END AS format FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'srt' ELSE 'txt' END AS ext, CASE WHEN doc_id % 4 = 2 THEN '1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || text ELSE array_to_string(string_split(text, chr(10))[1:5], chr(10)) END AS head FROM documents) d""")
def _(t):
    k = F.col("doc_id") % 4
    f = t.read("documents").select(
        "doc_id", F.concat(F.lit("m"), "doc_id", F.when(k == 0, ".json").when(k == 1, ".srt").otherwise(".txt")).alias("name"),
        F.when(k == 2, F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n"), "text")).otherwise(F.col("text")).alias("content"),
    )
    return st.route_format(f).select("doc_id", "format")


@register("latest_status", """SELECT job_id, status, event_id, value FROM (SELECT user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, event_id, value,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) e WHERE rn = 1""")
def _(t):
    return sr.latest_status(t.status_log, "event_id").select("job_id", "status", "event_id", "value")


CTES["eval_schema"] = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}', {i}, {w}::DOUBLE)" for i, (c, k, w) in enumerate(rules.EVAL_SCHEMA)) + ") v(component, criterion, criterion_no, weight)"
CTES["replies"] = """SELECT doc_id AS job_id, CASE doc_id % 2 WHEN 0 THEN 'summary' ELSE 'decisions' END AS component,
  CASE doc_id % 5 WHEN 0 THEN 'no json here' WHEN 1 THEN '```json' || chr(10) || '{"scores": {"clarity": ' || (doc_id % 10) || ', "completeness": 7.5, "coverage": 3}}' || chr(10) || '```'
   WHEN 2 THEN 'My scores: {"scores": {"clarity": 8, "specificity": ' || (doc_id % 7) || ', "factuality": 6.5}} as asked' WHEN 3 THEN '{"scores": {"clarity": 8, "broken' ELSE '{"scores": {"clarity": 1, "coverage": 9}}' END AS reply FROM labels"""


def _replies(t):
    d = F.col("doc_id")
    s = lambda c: c.cast("string")
    reply = (
        F.when(d % 5 == 0, "no json here")
        .when(d % 5 == 1, F.concat(F.lit('```json\n{"scores": {"clarity": '), s(d % 10), F.lit(', "completeness": 7.5, "coverage": 3}}\n```')))
        .when(d % 5 == 2, F.concat(F.lit('My scores: {"scores": {"clarity": 8, "specificity": '), s(d % 7), F.lit(', "factuality": 6.5}} as asked')))
        .when(d % 5 == 3, '{"scores": {"clarity": 8, "broken').otherwise('{"scores": {"clarity": 1, "coverage": 9}}')
    )
    return t.read("labels").select(d.alias("job_id"), F.when(d % 2 == 0, "summary").otherwise("decisions").alias("component"), reply.alias("reply"))


@register("salvage_json", r"""
SELECT job_id, component, criterion, score, parse_error FROM (
 SELECT r.job_id, r.component, s.criterion, r.body IS NULL AS parse_error, CASE WHEN r.body IS NULL THEN 5.0 ELSE CAST(json_extract(r.body, '$.scores.' || s.criterion) AS DOUBLE) END AS score
 FROM (SELECT *, try_cast(nullif(regexp_extract(reply, '(?s)\{.*\}'), '') AS JSON) AS body FROM replies) r JOIN eval_schema s ON s.component = r.component) x WHERE score IS NOT NULL""")
def _(t):
    return rs.salvage_json(_replies(t), t.eval_schema)


@register("salvage_items", r"""
SELECT job_id, i AS item_no, json_extract_string(d, '$.decision') AS decision, CAST(json_extract(d, '$.confidence') AS DOUBLE) AS confidence FROM (
  SELECT job_id, unnest(l) AS d, unnest(range(len(l))) AS i FROM (SELECT doc_id AS job_id, [json_object('decision', 'take lot ' || doc_id, 'confidence', 0.5), json_object('decision', 'wait', 'confidence', 0.25)] AS l FROM labels WHERE doc_id % 3 <> 0) a) b""")
def _(t):
    d = F.col("doc_id")
    good = F.concat(F.lit('Here you go: {"decisions": [{"decision": "take lot '), d.cast("string"), F.lit('", "confidence": 0.5}, {"decision": "wait", "confidence": 0.25}]} done'))
    r = t.read("labels").select(d.alias("job_id"), F.when(d % 3 == 0, "nothing {").otherwise(good).alias("reply"))
    return rs.salvage_items(r, "decisions", "decision: string, confidence: double")


@register("load_eval_schema", "SELECT s.component, s.criterion, s.weight, count(e.job_id) AS scored_jobs FROM eval_schema s LEFT JOIN (SELECT DISTINCT job_id, component, criterion FROM eval_scores) e ON e.component = s.component AND e.criterion = s.criterion GROUP BY ALL")
def _(t):
    """The schema, written as the JSON file that users bring, and read by the loader."""
    use_checkpoint_dir(t.spark)
    path = f"{t.spark.sparkContext.getCheckpointDir()}/schema-{uuid.uuid4().hex}"
    weights = t.eval_schema.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("criterion", "weight"))).alias("weights"))
    weights.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("component", F.struct("weights")))).alias("components")).coalesce(1).write.json(path)
    used = t.eval_scores.select("job_id", "component", "criterion").distinct()
    schema = rs.load_eval_schema(t.spark, path)
    return schema.join(used, ["component", "criterion"], "left").groupBy("component", "criterion", "weight").agg(F.count("job_id").alias("scored_jobs"))


_BADGE = "'   ' || CASE WHEN confidence >= 0.8 THEN '🟢 High' WHEN confidence >= 0.6 THEN '🟡 Medium' ELSE '🔴 Low' END || ' Confidence'"


def _unroll(sel, lines, src):
    return f"SELECT meeting_id, {sel}, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT *, list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL) AS l FROM ({src}) q) z"


@register("markdown_report", f"""
{_unroll("0 AS section, '' AS grp, 0 AS item_no", ["'# Meeting Report'", "'## Summary'", "summary"], "SELECT * FROM summaries")}
UNION ALL SELECT DISTINCT meeting_id, 1, '', 0, 0, '## Decisions' FROM decisions
UNION ALL {_unroll("1, '', n", ["n || '. **' || title || '**: ' || text", "'   - Participants: ' || speaker", _BADGE], "SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY item_id) AS n FROM decisions")}
UNION ALL SELECT DISTINCT meeting_id, 2, '', 0, 0, '## Action Items' FROM actions
UNION ALL SELECT DISTINCT meeting_id, 2, CASE WHEN b = 'Unassigned' THEN '~' ELSE b END, 0, 0, '### ' || b FROM (SELECT *, CASE WHEN owner IN ('Unclear', 'Unassigned') THEN 'Unassigned' ELSE owner END AS b FROM actions) a
UNION ALL {_unroll("2, g, n", ["n || '. **' || action || '**'", "'   - Due: ' || due_date", "CASE WHEN priority <> 'medium' THEN '   - Priority: ' || upper(priority) END", _BADGE],
  "SELECT *, row_number() OVER (PARTITION BY meeting_id, g ORDER BY item_id) AS n FROM (SELECT *, CASE WHEN owner IN ('Unclear', 'Unassigned') THEN '~' ELSE owner END AS g FROM actions) a")}
UNION ALL SELECT DISTINCT meeting_id, 3, '', 0, 0, '## Risks' FROM risks
UNION ALL {_unroll("3, '', n", ["n || '. ' || risk || ' (MEDIUM PRIORITY)'", "CASE WHEN mentioned_by <> 'Unknown' THEN '   - Mentioned by: ' || mentioned_by END", _BADGE], "SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY item_id) AS n FROM risks")}""")
def _(t):
    return rp.markdown_report(t.summaries, t.decisions, t.actions, t.risks)


@register("evaluation_report")
def _(t):
    report = ev.improvement_report(t.criterion_scores, t.components, t.eval_scores)
    todo = ev.priority_improvements(ev.recommendations(t.criterion_scores, t.components, t.eval_scores))
    return rp.evaluation_report(t.components, t.criterion_scores, report, todo)
