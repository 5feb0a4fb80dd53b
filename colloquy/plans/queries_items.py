"""Item-level queries: extraction, field rules, provenance, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx
from colloquy.operators import dedup as dd
from colloquy.operators import evaluation as ev
from colloquy.operators import extraction as ex
from colloquy.operators import mentions as mn
from colloquy.operators import provenance as pv
from colloquy.operators import reports as rp
from colloquy.operators import validation as va
from colloquy.operators.ordering import near_window
from colloquy.plans.catalog import CTES, all_of, any_match, cases, ext, first_ext, has, lit, matches, register, strip, title_case, words
from colloquy.plans.queries_segments import _list, _ref

# ------------------------------------------------------------------ SQL of the field rules


def sql_title(c):
    head = f"{words(c)}[1:4]"
    low = f"lower({c})"
    return f"""CASE WHEN contains({low}, 'launch') AND regexp_matches({low}, 'date|timeline') THEN 'Launch Date Change'
      WHEN contains({low}, 'feature') AND regexp_matches({low}, 'cut|remove') THEN 'Feature Set Reduction'
      WHEN regexp_matches({low}, 'budget|cost|\\$') THEN 'Budget Allocation' WHEN regexp_matches({low}, 'security|audit') THEN 'Security Audit Decision'
      WHEN regexp_matches({low}, 'meeting|checkpoint') THEN 'Communication Process'
      ELSE array_to_string({head}, ' ') || CASE WHEN len({head}) = 4 THEN '...' ELSE '' END END"""


def sql_due(c):
    parts = [f"CASE WHEN {matches(c, p)} THEN {lit(v)} END" if v else strip(ext(c, p, 1)) for p, v in rules.DUE_DATE]
    return "coalesce(" + ", ".join(parts) + ")"


def sql_priority(c, high=rules.HIGH_PRIORITY, low=rules.LOW_PRIORITY):
    return f"CASE WHEN {has(c, high)} THEN 'high' WHEN {has(c, low)} THEN 'low' ELSE 'medium' END"


def sql_owner(o, speaker):
    return f"""CASE WHEN lower({strip(o)}) IN ('i', 'i''ll', 'i''m') THEN {speaker} WHEN lower({strip(o)}) = 'you' THEN 'Unclear'
      ELSE {title_case("regexp_replace(" + strip(o) + ", " + lit(rules.TITLES) + ", '')")} END"""


def sql_boost(c):
    one = lambda ps, v: f"CASE WHEN {any_match(c, ps)} THEN {v} ELSE 0.0 END::DOUBLE"
    return f"({one(rules.BOOST_DATES, 0.1)} + {one(rules.BOOST_COUNTS, 0.1)} + {one(rules.BOOST_COMPARISONS, 0.05)})"


def sql_keyword_conf(c):
    return f"least(CASE WHEN {has(c, rules.CERTAIN_WORDS)} THEN 0.9 WHEN {has(c, rules.TENTATIVE_WORDS)} THEN 0.7 ELSE 0.5 END::DOUBLE + {sql_boost(c)}, 0.95::DOUBLE)"


def sql_risk_text(c):
    opts = []
    for p, n in rules.RISK_DESCRIPTION:
        joined = "concat_ws(' ', " + ", ".join(strip(ext(c, p, g + 1)) for g in range(n)) + ")"
        cut = f"regexp_replace(regexp_replace({joined}, '(?i)^(that|is|with)\\s+', ''), '[.,]+$', '')"
        opts.append(f"CASE WHEN length({cut}) > 15 THEN {cut} END")
    whole = f"regexp_replace({strip(f'''regexp_replace({c}, '^\\s*\\w+:\\s*', '')''')}, '[.,]+$', '')"
    opts.append(f"CASE WHEN {has(c, rules.RISK_FALLBACK_WORDS)} AND length({whole}) > 20 AND length({whole}) < 200 THEN {whole} END")
    return "coalesce(" + ", ".join(opts) + ")"


CTES["decisions"] = f"""
SELECT * FROM (SELECT s.meeting_id, s.seg_id AS item_id, s.seg_id, {strip('s.text')} AS text, {sql_title('s.text')} AS title,
   {cases('s.text', rules.DECISION_CATEGORIES, 'other')} AS category, s.speaker, s.confidence, s.decision_type, n.near AS supporting, s.ts_raw,
   list_concat({all_of('s.text', rules.MONTH_DATE)}, {all_of('s.text', rules.SLASH_DATE)}) AS dates, {all_of('s.text', rules.WHOLE_NUMBER)} AS numbers,
   CASE WHEN {matches('s.text', rules.FROM_TO)} THEN {strip(f"regexp_extract(s.text, {lit(rules.FROM_TO)}, 1)")} || ' → ' || {strip(f"regexp_extract(s.text, {lit(rules.FROM_TO)}, 2)")} END AS change,
   row_number() OVER (PARTITION BY s.meeting_id, lower({strip('s.text')})[1:50] ORDER BY s.seg_id) AS rn
 FROM scored s JOIN (SELECT meeting_id, seg_id, list(text) OVER (PARTITION BY meeting_id ORDER BY seg_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM seg) n
   ON n.meeting_id = s.meeting_id AND n.seg_id = s.seg_id) d WHERE rn = 1"""

_pats = []
for _no, (_p, _og, _ag) in enumerate(rules.ACTION_PATTERNS):
    _o = f"unnest({all_of('text', _p, _og)})" if _og else "coalesce(speaker, 'Unknown')"
    _a = all_of("text", _p, _ag)
    _pats.append(
        f"SELECT meeting_id, seg_id, speaker, text, {_no} AS pattern_no, {_o} AS o, regexp_replace({strip(f'unnest({_a})')}, '[.,]+$', '') AS a, unnest(range(len({_a}))) AS match_no FROM seg"
    )
CTES["actions"] = f"""
SELECT meeting_id, seg_id::BIGINT * 2147483648 + pattern_no * 268435456 + match_no AS item_id, seg_id, a AS action, {sql_owner('o', "coalesce(speaker, 'Unknown')")} AS owner,
   {sql_due('text')} AS due_date, {sql_priority('text')} AS priority, 0.85::DOUBLE AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, lower(a) ORDER BY seg_id, pattern_no, match_no) AS rn
      FROM ({' UNION ALL '.join(_pats)}) m WHERE length(a) >= 10 AND o <> '') x WHERE rn = 1"""
CTES["risks"] = f"""
SELECT meeting_id, seg_id AS item_id, seg_id, risk, {cases('risk', rules.RISK_CATEGORIES, 'Other')} AS category, coalesce(speaker, 'Unknown') AS mentioned_by, 0.85::DOUBLE AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, lower(risk) ORDER BY seg_id) AS rn FROM (
   SELECT meeting_id, seg_id, speaker, {sql_risk_text('text')} AS risk FROM seg WHERE {has('text', rules.RISK_WORDS)}) r WHERE risk IS NOT NULL) x WHERE rn = 1"""
CTES["items"] = """
SELECT meeting_id, 'decision' AS kind, item_id, seg_id, text, NULL::VARCHAR AS owner, confidence FROM decisions
UNION ALL SELECT meeting_id, 'action', item_id, seg_id, action, owner, confidence FROM actions
UNION ALL SELECT meeting_id, 'risk', item_id, seg_id, risk, NULL, confidence FROM risks"""


# ------------------------------------------------------------------ I: extractors
@register("extract_decisions", """SELECT meeting_id, item_id, text, title, category, speaker, confidence, decision_type, array_to_string(supporting, '|') AS supporting,
  array_to_string(dates, '|') AS dates, array_to_string(numbers, '|') AS numbers, coalesce(change, '') AS changes FROM decisions""")
def _(t):
    return t.decisions.select(
        "meeting_id", "item_id", "text", "title", "category", "speaker", "confidence", "decision_type", "supporting",
        "quantitative.dates", "quantitative.numbers", "quantitative.changes",
    )


@register("extract_actions", "SELECT meeting_id, item_id, action, owner, due_date, priority, confidence FROM actions")
def _(t):
    return t.actions.drop("seg_id")


@register("extract_risks", "SELECT meeting_id, item_id, risk, category, mentioned_by, confidence FROM risks")
def _(t):
    return t.risks.drop("seg_id")


_CORE = "coalesce(" + ", ".join(ext("decision_text", p, 0) for p in rules.CORE_DECISION) + ", decision_text)"
CTES["pattern_decisions"] = f"""SELECT meeting_id, seg_id, {strip(_CORE)} AS text, {strip(first_ext('decision_text', rules.RATIONALE))} AS rationale, participants, 0.85::DOUBLE AS confidence
  FROM with_people WHERE {has('text', rules.PATTERN_DECISION)}"""


@register("extract_decisions_patterns", "SELECT meeting_id, seg_id, text, rationale, array_to_string(participants, '|') AS participants, confidence FROM pattern_decisions")
def _(t):
    return ex.extract_decisions_patterns(t.segments).drop("item_id")


@register("extract_decisions_basic", f"SELECT meeting_id, seg_id, text, speaker, ts_raw, {sql_keyword_conf('text')} AS confidence FROM seg WHERE {has('text', rules.BASIC_DECISION)}")
def _(t):
    return ex.extract_decisions_basic(t.segments)


@register("extract_risks_basic", f"SELECT meeting_id, seg_id, text AS risk, speaker AS mentioned_by, {sql_keyword_conf('text')} AS confidence FROM seg WHERE {has('text', rules.BASIC_RISK)}")
def _(t):
    return ex.extract_risks_basic(t.segments)


_LIKE = lambda c: rf"(len({words(c)}) BETWEEN 1 AND 3 AND regexp_matches({words(c)}[1], '^\p{{Lu}}.'))"


@register("extract_actions_basic", f"""
SELECT meeting_id, seg_id, action, owner, due_date, {sql_priority('action', rules.HIGH_PRIORITY_BASIC, rules.LOW_PRIORITY_BASIC)} AS priority, {sql_keyword_conf('action')} AS confidence FROM (
 SELECT *, CASE WHEN use4 AND {_LIKE('o4p')} THEN o4p ELSE o3 END AS owner, coalesce(CASE WHEN use4 THEN a4p END, a3, text) AS action, {first_ext('text', rules.DUE_DATE_BASIC)} AS due_date FROM (
  SELECT *, (o3 IS NULL OR o3 IS NOT DISTINCT FROM speaker) AND o4p IS NOT NULL AS use4 FROM (
   SELECT *, CASE WHEN a2 IS NULL AND a3p IS NOT NULL THEN coalesce(o2, 'Team') ELSE o2 END AS o3, coalesce(a2, a3p) AS a3 FROM (
    SELECT *, CASE WHEN use2 THEN o2p ELSE o1 END AS o2, CASE WHEN use2 THEN coalesce(a2p, a1p) ELSE a1p END AS a2 FROM (
     SELECT *, (o1 IS NULL OR o1 IS NOT DISTINCT FROM speaker) AND o2p IS NOT NULL AS use2 FROM (
      SELECT *, CASE WHEN {_LIKE('o1p')} THEN o1p ELSE speaker END AS o1 FROM (
       SELECT *, {ext('text', rules.BASIC_PERSON_WILL, 1)} AS o1p, {strip(ext('text', rules.BASIC_PERSON_WILL, 2))} AS a1p, {ext('text', rules.BASIC_ASSIGNED, 1)} AS o2p,
         {strip(ext('text', rules.BASIC_ASSIGNED_ACTION, 1))} AS a2p, {strip(ext('text', rules.BASIC_GROUP_WILL, 1))} AS a3p,
         {ext('text', rules.BASIC_PERSON_SHOULD, 1)} AS o4p, {strip(ext('text', rules.BASIC_PERSON_SHOULD, 2))} AS a4p
       FROM seg WHERE {has('text', rules.ACTION_VERBS)}) x1) x2) x3) x4) x5) x6) x7""")
def _(t):
    return ex.extract_actions_basic(t.segments)


@register("extract_decisions_from_intents")
def _(t):
    return ex.extract_decisions_from_intents(t.segments)


@register("extract_actions_from_intents")
def _(t):
    return ex.extract_actions_from_intents(t.segments)


@register("extract_risks_from_intents")
def _(t):
    return ex.extract_risks_from_intents(t.segments)


_CAND = " || ".join(all_of("text", p, 1) for p in rules.ACTION_OWNER_CANDIDATES)


@register("action_owner_candidates", f"""
SELECT meeting_id, seg_id, owner, row_number() OVER (PARTITION BY meeting_id, seg_id ORDER BY i) - 1 AS owner_no FROM (
  SELECT meeting_id, seg_id, {strip('l[i]')} AS owner, i, list_position(l, l[i]) AS first_i FROM (SELECT *, {_CAND} AS l FROM seg) s, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u) x
WHERE i = first_i""")
def _(t):
    return ex.action_owner_candidates(t.segments)


def _sql_parse_date(c, ref):
    months = _list("january february march april may june july august september october november december".split())
    pm = r"(january|february|march|april|may|june|july|august|september|october|november|december)\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?"
    low = f"lower({c})"
    md = (
        f"try_cast(printf('%04d-%02d-%02d', coalesce(try_cast(regexp_extract({low}, {lit(pm)}, 3) AS INT), year({ref})), coalesce(list_position({months}, regexp_extract({low}, {lit(pm)}, 1)), 0), "
        f"coalesce(try_cast(regexp_extract({low}, {lit(pm)}, 2) AS INT), 0)) AS TIMESTAMP)"
    )
    dow = f"CASE regexp_extract({low}, '\\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun)\\b', 1)[1:3] " + " ".join(
        f"WHEN '{d}' THEN {i + 1}" for i, d in enumerate(["mon", "tue", "wed", "thu", "fri", "sat", "sun"])
    ) + " END"
    named = f"(date_trunc('day', {ref}) + to_days(CAST((({dow}) - isodow({ref}) + 7) % 7 AS INT)))"
    inn = lambda g: f"regexp_extract(trim({low}), '^in (\\d+) (days?|weeks?|months?|years?)', {g})"
    rel = f"""CASE WHEN trim({low}) IN ('eod','cob') THEN date_trunc('day', {ref}) + INTERVAL 17 HOUR WHEN trim({low}) = 'asap' THEN {ref} + INTERVAL 1 HOUR
      WHEN contains({low}, 'today') THEN {ref} WHEN contains({low}, 'tomorrow') THEN {ref} + INTERVAL 1 DAY WHEN contains({low}, 'yesterday') THEN {ref} - INTERVAL 1 DAY
      WHEN contains({low}, 'next week') THEN {ref} + INTERVAL 7 DAY WHEN contains({low}, 'last week') THEN {ref} - INTERVAL 7 DAY WHEN contains({low}, 'this week') THEN {ref}
      WHEN contains({low}, 'next month') THEN {ref} + INTERVAL 1 MONTH WHEN contains({low}, 'last month') THEN {ref} - INTERVAL 1 MONTH WHEN contains({low}, 'this month') THEN {ref}
      WHEN contains({low}, 'next quarter') THEN {ref} + INTERVAL 3 MONTH WHEN contains({low}, 'next year') THEN {ref} + INTERVAL 12 MONTH
      WHEN {inn(2)} LIKE 'day%' THEN {ref} + to_days(CAST({inn(1)} AS INT)) WHEN {inn(2)} LIKE 'week%' THEN {ref} + to_days(CAST({inn(1)} AS INT) * 7)
      WHEN {inn(2)} LIKE 'month%' THEN {ref} + to_months(CAST({inn(1)} AS INT)) WHEN {inn(2)} LIKE 'year%' THEN {ref} + to_months(CAST({inn(1)} AS INT) * 12) END"""
    iso = f"try_cast(regexp_extract({low}, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS TIMESTAMP)"
    return f"coalesce({iso}, {md}, {rel}, {named})"


_DL = " UNION ALL ".join(
    f"SELECT meeting_id, seg_id, {i} AS pattern_no, unnest(range(len({all_of('text', p, 1)}))) AS match_no, {strip('unnest(' + all_of('text', p, 1) + ')')} AS action, {strip('unnest(' + all_of('text', p, 2) + ')')} AS deadline_text FROM seg"
    for i, p in enumerate(rules.ACTION_DEADLINES)
)
_REFSQL = "(TIMESTAMP '2025-03-14 10:30:00' + to_days(CAST(meeting_id % 7 AS INT)))"


@register("action_deadlines", f"""
SELECT meeting_id, seg_id, pattern_no, match_no, action, deadline_text, strftime(d, '%Y-%m-%d %H:%M:%S') AS deadline_date, CASE WHEN d IS NULL THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence
FROM (SELECT *, {_sql_parse_date('deadline_text', _REFSQL)} AS d FROM ({_DL}) x) y""")
def _(t):
    return mn.action_deadlines(t.segments, _ref())


@register("temporal_mentions")
def _(t):
    return mn.temporal_mentions(t.segments, _ref())


@register("entity_mentions")
def _(t):
    return mn.entity_mentions(t.segments)


# ------------------------------------------------------------------ H: field rules on every segment
def _rule(name, sql, expr, cols=("meeting_id", "seg_id")):
    @register(name, sql)
    def _(t):
        return t.segments.select(*cols, *[c.alias(n) for n, c in expr().items()])


_T = F.col
_rule("extract_due_date", f"SELECT meeting_id, seg_id, {sql_due('text')} AS due_date FROM seg", lambda: {"due_date": tx.due_date(F.col("text"))})
_found = strip(first_ext("text", rules.DUE_DATE_LEGACY))
_rule(
    "extract_due_date_legacy",
    f"SELECT meeting_id, seg_id, CASE WHEN {_found} IS NOT NULL AND contains(lower(text), 'end of day') AND contains(lower(text), 'tomorrow') THEN 'end of day tomorrow' ELSE {_found} END AS due_date FROM seg",
    lambda: {"due_date": tx.due_date_legacy(F.col("text"))},
)
_rule("classify_priority", f"SELECT meeting_id, seg_id, {sql_priority('text')} AS priority FROM seg", lambda: {"priority": tx.priority(F.col("text"))})
_rule("decision_title", f"SELECT meeting_id, seg_id, {sql_title('text')} AS title FROM seg", lambda: {"title": tx.decision_title(F.col("text"))})
_rule("decision_category", f"SELECT meeting_id, seg_id, {cases('text', rules.DECISION_CATEGORIES, 'other')} AS category FROM seg", lambda: {"category": tx.decision_category(F.col("text"))})
_rule(
    "quantitative_data",
    f"""SELECT meeting_id, seg_id, array_to_string(list_concat({all_of('text', rules.MONTH_DATE)}, {all_of('text', rules.SLASH_DATE)}), '|') AS dates, array_to_string({all_of('text', rules.WHOLE_NUMBER)}, '|') AS numbers,
    CASE WHEN {matches('text', rules.FROM_TO)} THEN {strip(f"regexp_extract(text, {lit(rules.FROM_TO)}, 1)")} || ' → ' || {strip(f"regexp_extract(text, {lit(rules.FROM_TO)}, 2)")} ELSE '' END AS changes FROM seg""",
    lambda: {k: tx.quantitative(F.col("text"))[k] for k in ("dates", "numbers", "changes")},
)
_rule("quantitative_boost", f"SELECT meeting_id, seg_id, {sql_boost('text')} AS boost FROM seg", lambda: {"boost": tx.quantitative_boost(F.col("text"))})
_rule("keyword_confidence", f"SELECT meeting_id, seg_id, {sql_keyword_conf('text')} AS confidence FROM seg", lambda: {"confidence": tx.keyword_confidence(F.col("text"))})
_rule(
    "assignment_confidence",
    f"""SELECT meeting_id, seg_id, least(0.5::DOUBLE + CASE WHEN {has('text', rules.ASSIGNMENT_PHRASES)} THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN {has('text', rules.AFFIRMATIONS)} THEN 0.1 ELSE 0 END::DOUBLE
      + CASE WHEN {matches('text', rules.WHO_WILL)} THEN 0.1 ELSE 0 END::DOUBLE, 1.0::DOUBLE) AS confidence FROM seg""",
    lambda: {"confidence": tx.assignment_confidence(F.col("text"))},
)
_rule("rationale", f"SELECT meeting_id, seg_id, {strip(first_ext('text', rules.RATIONALE))} AS rationale FROM seg", lambda: {"rationale": tx.rationale(F.col("text"))})
_rule("rationale_legacy", f"SELECT meeting_id, seg_id, {strip(first_ext('text', rules.RATIONALE_LEGACY))} AS rationale FROM seg", lambda: {"rationale": tx.rationale(F.col("text"), rules.RATIONALE_LEGACY)})
_rule("risk_description", f"SELECT meeting_id, seg_id, {sql_risk_text('text')} AS risk FROM seg", lambda: {"risk": tx.risk_description(F.col("text"))})
_rule("risk_category", f"SELECT meeting_id, seg_id, {cases('text', rules.RISK_CATEGORIES, 'Other')} AS category FROM seg", lambda: {"category": tx.risk_category(F.col("text"))})
_cnt = {k: "(" + " + ".join(f"CAST(contains(lower(text), {lit(w)}) AS INT)" for w in v) + ")" for k, v in rules.RISK_CATEGORIES_LEGACY.items()}
_rule(
    "argmax_category",
    f"SELECT meeting_id, seg_id, CASE WHEN greatest({', '.join(_cnt.values())}) = 0 THEN 'Other' " + " ".join(f"WHEN {v} = greatest({', '.join(_cnt.values())}) THEN '{k}'" for k, v in _cnt.items()) + " END AS category FROM seg",
    lambda: {"category": tx.argmax_category(F.col("text"))},
)
_rule("risk_title", None, lambda: {"title": tx.risk_title(F.col("text"))})
_imp = ", ".join(f"CASE WHEN length({strip(ext('text', p, 1))}) > 10 AND length({strip(ext('text', p, 1))}) < 200 THEN {strip(ext('text', p, 1))} END" for p in rules.RISK_IMPACT)
_rule(
    "risk_priority_impact",
    f"""SELECT meeting_id, seg_id, CASE WHEN {has('text', rules.RISK_HIGH)} THEN 'HIGH' WHEN {has('text', rules.RISK_MEDIUM)} THEN 'MEDIUM' WHEN {has('text', rules.RISK_LOW)} THEN 'LOW' ELSE 'MEDIUM' END AS priority,
      coalesce({_imp}) AS impact FROM seg""",
    lambda: {"priority": tx.risk_priority(F.col("text")), "impact": tx.risk_impact(F.col("text"))},
)
_up = lambda c: f"(upper({c}[1:1]) || {c}[2:])"
_clean = _up(strip(f"regexp_replace(text, {lit(rules.RISK_LEADING_FILLER)}, '')"))
_ctx = ", ".join(f"CASE WHEN length({strip(ext('text', p, 1))}) BETWEEN 15 AND 200 THEN {_up(strip(ext('text', p, 1)))} END" for p in rules.RISK_CONTEXT_DESCRIPTION)
_rule(
    "clean_risk_text", f"SELECT meeting_id, seg_id, CASE WHEN length({_clean}) >= 20 THEN {_clean} ELSE coalesce({_ctx}, '') END AS risk FROM seg",
    lambda: {"risk": tx.clean_risk_text(F.col("text"), F.col("text"))},
)
_act = f"(upper(regexp_replace(text, {lit(rules.TRAILING_FILLER)}, '')[1:1]) || regexp_replace(text, {lit(rules.TRAILING_FILLER)}, '')[2:])"
_rule(
    "clean_action_text", rf"SELECT meeting_id, seg_id, {strip(f'''CASE WHEN NOT regexp_matches({_act}, '[.!?]$') AND len({words(_act)}) > 5 THEN {_act} || '.' ELSE {_act} END''')} AS action FROM seg",
    lambda: {"action": tx.clean_action_text(F.col("text"))},
)


@register("split_compound_actions", rf"""
SELECT meeting_id, seg_id, unnest(range(len(parts))) AS part_no, unnest(parts) AS part FROM (
  SELECT meeting_id, seg_id, CASE WHEN len(acting) > 1 THEN acting WHEN (starts_with(lower(text), 'also') OR contains(lower(text), ', also')) AND bare <> text THEN [{strip('bare')}] ELSE [] END AS parts FROM (
    SELECT *, list_filter(list_transform(string_split_regex(text, '(?i)\s+and\s+'), lambda p: {strip('p')}), lambda p: {has('p', rules.COMPOUND_VERBS)}) AS acting,
      regexp_replace(text, '(?i)^(?:also|and)\s*[,]?\s*', '') AS bare FROM seg) x) y""")
def _(t):
    return t.segments.select("meeting_id", "seg_id", F.posexplode(tx.compound_parts(F.col("text"))).alias("part_no", "part"))


def _around(t, k):
    join = lambda a, b: lambda w: F.array_join(F.collect_list("text").over(w.rowsBetween(a, b)), " ")
    return near_window(t.segments, ["meeting_id"], "seg_id", k, {
        "ctx": join(-k, k), "prev": lambda w: F.collect_list(F.struct("text", "speaker")).over(w.rowsBetween(-5, -1)),
        "next": lambda w: F.collect_list("text").over(w.rowsBetween(1, 7)),
    })


@register("owner_from_context")
def _(t):
    r = _around(t, 5)
    return r.select("meeting_id", "seg_id", ex.owner_from_context(F.col("text"), F.col("speaker"), F.col("ctx"), F.col("prev")).alias("owner"))


@register("action_text_with_details")
def _(t):
    r = _around(t, 5).filter(tx.has_any("text", rules.TOPUP_ACTION))
    owner = ex.quick_owner(F.col("text"), F.col("speaker"))
    return r.select("meeting_id", "seg_id", ex.action_with_details(F.col("text"), owner, F.col("ctx")).alias("action"))


@register("risk_mitigations")
def _(t):
    r = _around(t, 8).filter(tx.has_any("text", rules.TOPUP_RISK))
    return r.select("meeting_id", "seg_id", ex.risk_mitigations(F.concat("ctx", F.lit("\n"), "text"), F.col("next")).alias("mitigations"))


@register("risk_owners")
def _(t):
    return t.segments.select("meeting_id", "seg_id", ex.risk_owners(F.col("text")).alias("owners"))


# ------------------------------------------------------------------ B: item filters and output
@register("filter_confidence", "SELECT meeting_id, kind, item_id, confidence FROM items WHERE confidence >= 0.6")
def _(t):
    return ex.filter_confidence(t.items, 0.6).select("meeting_id", "kind", "item_id", "confidence")


@register("to_output_schema", """SELECT meeting_id, item_id, text, coalesce(owner, 'Unknown') AS owner, coalesce(priority, 'medium') AS priority, confidence, kind FROM (
  SELECT meeting_id, item_id, text, speaker AS owner, NULL AS priority, confidence, 'decision' AS kind FROM decisions
  UNION ALL SELECT meeting_id, item_id, action, owner, priority, confidence, 'action' FROM actions
  UNION ALL SELECT meeting_id, item_id, risk, NULL, NULL, confidence, 'risk' FROM risks) x""")
def _(t):
    d, a, r = ex.decisions_output(t.decisions), ex.actions_output(t.actions), ex.risks_output(t.risks)
    part = lambda df, kind, text, owner, prio: df.select(
        "meeting_id", "item_id", F.col(text).alias("text"), F.coalesce(owner, F.lit("Unknown")).alias("owner"),
        F.coalesce(prio, F.lit("medium")).alias("priority"), "confidence", F.lit(kind).alias("kind"),
    )
    return part(d, "decision", "text", F.col("speaker"), F.lit(None)).unionByName(part(a, "action", "action", F.col("owner"), F.col("priority"))).unionByName(
        part(r, "risk", "risk", F.col("owner"), F.col("priority"))
    )


@register("confidence_band", "SELECT meeting_id, kind, item_id, CASE WHEN confidence >= 0.8 THEN 'High' WHEN confidence >= 0.6 THEN 'Medium' ELSE 'Low' END AS band FROM items")
def _(t):
    return t.items.select("meeting_id", "kind", "item_id", tx.confidence_band(F.col("confidence")).alias("band"))


def _model_actions(t):
    """Actions with gaps, as a model would return them."""
    k = F.col("item_id") % 5
    return t.actions.select(
        "meeting_id", "item_id", F.when(k == 1, "").otherwise(F.col("action")).alias("action"),
        F.when(k == 2, "Dr. Stone").when(F.col("seg_id") % 4 == 3, "Current Speaker").otherwise(F.col("owner")).alias("owner"),
        F.when(k == 3, "ASAP").when(k == 4, F.lit(None)).otherwise(F.upper("priority")).alias("priority"),
        F.when(F.col("seg_id") % 2 == 0, F.lit(None).cast("double")).otherwise(F.col("confidence")).alias("confidence"),
    )


CTES["model_actions"] = """SELECT meeting_id, item_id, CASE WHEN item_id % 5 = 1 THEN '' ELSE action END AS action,
  CASE WHEN item_id % 5 = 2 THEN 'Dr. Stone' WHEN seg_id % 4 = 3 THEN 'Current Speaker' ELSE owner END AS owner,
  CASE WHEN item_id % 5 = 3 THEN 'ASAP' WHEN item_id % 5 = 4 THEN NULL ELSE upper(priority) END AS priority, CASE WHEN seg_id % 2 = 0 THEN NULL ELSE confidence END AS confidence FROM actions"""


@register("clean_model_items", r"""
SELECT meeting_id, item_id, action, CASE WHEN lower(o) IN ('current speaker', '[current speaker]', 'speaker') THEN 'Unclear' ELSE o END AS owner,
  CASE WHEN p IN ('high','medium','low') THEN p ELSE 'medium' END AS priority, coalesce(confidence, 0.8) AS confidence
FROM (SELECT *, trim(regexp_replace(owner, 'Dr\.|Mr\.|Ms\.', '', 'g')) AS o, lower(coalesce(priority, 'medium')) AS p FROM model_actions WHERE action <> '' AND owner <> '') x""")
def _(t):
    return ex.clean_model_actions(_model_actions(t))


@register("clean_model_risks", """
SELECT meeting_id, item_id, risk, CASE WHEN category IN ('Timeline','Technical','Resource','Regulatory','Business','Other') THEN category ELSE 'Other' END AS category, coalesce(confidence, 0.8) AS confidence
FROM (SELECT meeting_id, item_id, CASE WHEN seg_id % 3 = 0 THEN risk[1:9] ELSE risk END AS risk, CASE WHEN seg_id % 2 = 0 THEN 'Weather' ELSE category END AS category,
  CASE WHEN seg_id % 5 = 0 THEN NULL ELSE confidence END AS confidence FROM risks) r WHERE length(risk) > 10""")
def _(t):
    s = F.col("seg_id")
    r = t.risks.select(
        "meeting_id", "item_id", F.when(s % 3 == 0, F.left("risk", F.lit(9))).otherwise(F.col("risk")).alias("risk"),
        F.when(s % 2 == 0, "Weather").otherwise(F.col("category")).alias("category"),
        F.when(s % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("confidence")).alias("confidence"),
    )
    return ex.clean_model_risks(r)


@register("default_model_fields", "SELECT meeting_id, item_id, action, owner, coalesce(priority, 'medium') AS priority, coalesce(confidence, 0.9) AS confidence FROM model_actions")
def _(t):
    return ex.default_model_fields(_model_actions(t))


# ------------------------------------------------------------------ G: dedup
@register("union_items", "SELECT meeting_id, kind, item_id, seg_id, text, owner, confidence FROM items")
def _(t):
    return t.items


@register("first_occurrence", "SELECT meeting_id, seg_id, text FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, lower(text) ORDER BY seg_id) AS rn FROM seg) s WHERE rn = 1")
def _(t):
    k = t.segments.select("meeting_id", "seg_id", "text", F.lower("text").alias("_k"))
    return dd.first_occurrence(k, ["meeting_id", "_k"], ["seg_id"]).drop("_k")


@register("dedup_prefix50", "SELECT meeting_id, seg_id, text FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, lower(text)[1:50] ORDER BY seg_id) AS rn FROM scored) s WHERE rn = 1")
def _(t):
    return dd.dedup_prefix(ex.score_decision_segments(t.segments)).select("meeting_id", "seg_id", "text")


@register("dedup_across_chunks", """
SELECT meeting_id, kind, item_id, text FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, kind, CASE WHEN kind = 'action' THEN lower(coalesce(owner, '') || '-' || text[1:50]) ELSE lower(text[1:100]) END ORDER BY item_id) AS rn FROM (
  SELECT * FROM items UNION ALL SELECT meeting_id, kind, item_id + 1000000, seg_id, text || ' again and again', owner, confidence FROM items) x) y WHERE rn = 1""")
def _(t):
    again = t.items.withColumn("item_id", F.col("item_id") + 1000000).withColumn("text", F.concat("text", F.lit(" again and again")))
    return dd.dedup_across_chunks(t.items.unionByName(again)).select("meeting_id", "kind", "item_id", "text")


@register("word_set_ops", f"""SELECT meeting_id, seg_id, array_to_string(list_sort(list_intersect(a, b)), '|') AS shared_words, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS all_words
FROM (SELECT meeting_id, seg_id, list_distinct({words('lower(text)')}) AS a, list_distinct({words('lower(coalesce(decision_text, text))')}) AS b FROM (
   SELECT meeting_id, seg_id, text, lead(text) OVER (PARTITION BY meeting_id ORDER BY seg_id) AS decision_text FROM seg) s) x""")
def _(t):
    r = near_window(t.segments, ["meeting_id"], "seg_id", 1, {"nxt": lambda w: F.coalesce(F.lead("text").over(w), F.col("text"))})
    return dd.word_set_ops(r, "text", "nxt").select("meeting_id", "seg_id", "shared_words", "all_words")


# ------------------------------------------------------------------ C, F: provenance
CTES["links"] = f"""
SELECT meeting_id, kind, item_id, rank, seg_id, similarity FROM (
 SELECT *, row_number() OVER (PARTITION BY meeting_id, kind, item_id ORDER BY similarity DESC, seg_id) AS rank FROM (
  SELECT i.meeting_id, i.kind, i.item_id, s.seg_id, len(list_intersect(iw, sw)) / len(list_distinct(list_concat(iw, sw)))::DOUBLE AS similarity
  FROM (SELECT meeting_id, kind, item_id, list_distinct({words('lower(text)')}) AS iw FROM items) i
  JOIN (SELECT meeting_id, seg_id, list_distinct({words('lower(text)')}) AS sw FROM seg) s ON s.meeting_id = i.meeting_id) x WHERE similarity > 0.1) y WHERE rank <= 3"""


@register("link_provenance_lexical", "SELECT meeting_id, kind, item_id, rank, seg_id, similarity FROM links")
def _(t):
    return t.provenance


@register("topk_sources", "SELECT meeting_id, kind, item_id, seg_id, similarity FROM links")
def _(t):
    return pv.link_provenance_lexical(t.items, t.segments, top=3).select("meeting_id", "kind", "item_id", "seg_id", "similarity")


CTES["support"] = """SELECT i.meeting_id, i.kind, i.item_id, coalesce(max(l.similarity), 0) AS m, count(l.seg_id) AS n, sum(l.similarity) AS s FROM items i
  LEFT JOIN links l ON l.meeting_id = i.meeting_id AND l.kind = i.kind AND l.item_id = i.item_id GROUP BY ALL"""


@register("support_status", """SELECT meeting_id, kind, item_id, m >= 0.5 AS is_valid, m AS max_similarity, n AS supporting_segments, m < 0.3 AS potential_hallucination,
  CASE WHEN m < 0.3 THEN 'Low similarity to source - potential hallucination' WHEN m >= 0.5 THEN 'Well-supported by source material' ELSE 'Weak support in source material' END AS status FROM support""")
def _(t):
    return pv.support_status(t.items, t.provenance)


@register("provenance_summary", """SELECT meeting_id, count(*) AS total_items, count(*) FILTER (n > 0) AS items_with_provenance, coalesce(sum(s) / sum(n), 0) AS average_similarity, count(*) FILTER (m < 0.3) AS potential_hallucinations,
  count(*) FILTER (n > 0) / count(*)::DOUBLE AS provenance_coverage, count(*) FILTER (m < 0.3) / count(*)::DOUBLE AS hallucination_rate FROM support GROUP BY 1""")
def _(t):
    return pv.provenance_summary(t.items, t.provenance)


@register("provenance_detail", "SELECT l.meeting_id, l.kind, l.item_id, l.rank, l.seg_id, s.speaker, s.ts_raw, s.text, CAST(floor(l.similarity * 100 + 0.5) AS BIGINT) AS similarity_pct FROM links l JOIN seg s ON s.meeting_id = l.meeting_id AND s.seg_id = l.seg_id")
def _(t):
    return pv.provenance_detail(t.provenance, t.segments).drop("similarity")


@register("attribute_decision_time", """SELECT d.meeting_id, d.item_id, coalesce(nullif(s.ts_raw, ''), '00:00') AS attributed_ts FROM decisions d
  LEFT JOIN links l ON l.meeting_id = d.meeting_id AND l.item_id = d.item_id AND l.kind = 'decision' AND l.rank = 1 LEFT JOIN seg s ON s.meeting_id = l.meeting_id AND s.seg_id = l.seg_id""")
def _(t):
    return pv.attribute_decision_time(t.decisions, t.provenance, t.segments).select("meeting_id", "item_id", "attributed_ts")


@register("mean_similarity_boost", """SELECT i.meeting_id, i.kind, i.item_id, CASE WHEN s.n > 0 AND s.s / s.n > 0.7 THEN least(i.confidence + 0.1::DOUBLE, 0.95::DOUBLE) ELSE i.confidence END AS confidence
  FROM items i JOIN support s ON s.meeting_id = i.meeting_id AND s.kind = i.kind AND s.item_id = i.item_id WHERE i.kind = 'decision'""")
def _(t):
    return pv.boost_confidence(t.items.filter("kind = 'decision'"), t.provenance).select("meeting_id", "kind", "item_id", "confidence")


@register("rank_decisions", """SELECT meeting_id, item_id, confidence, split_part(ts_raw, ':', 1)::DOUBLE * 60 + split_part(ts_raw, ':', 2)::DOUBLE AS time_s,
  row_number() OVER (PARTITION BY meeting_id ORDER BY confidence DESC, seg_id) AS decision_rank FROM decisions""")
def _(t):
    from pyspark.sql import Window

    own = t.segments.select("meeting_id", "seg_id", "ts_raw")
    r = rp.rank_decisions(t.decisions.join(own, ["meeting_id", "seg_id"]), "ts_raw")
    w = Window.partitionBy("meeting_id").orderBy(F.desc("confidence"), "time_s", "item_id")
    return r.select("meeting_id", "item_id", "confidence", "time_s", F.row_number().over(w).alias("decision_rank"))


@register("rank_risks", """SELECT meeting_id, item_id, risk, CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM-HIGH' THEN 1 WHEN 'LOW' THEN 3 ELSE 2 END::BIGINT AS priority_order
  FROM (SELECT *, CASE item_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN NULL ELSE 'MEDIUM-HIGH' END AS priority FROM risks) r""")
def _(t):
    k = F.col("item_id") % 4
    r = t.risks.withColumn("priority", F.when(k == 0, "HIGH").when(k == 1, "LOW").when(k == 3, "MEDIUM-HIGH"))
    return rp.rank_risks(r).select("meeting_id", "item_id", "risk", "priority_order")


@register("preview_lists", "SELECT meeting_id, item_id, array_to_string(supporting[1:2], '|') AS supporting FROM decisions")
def _(t):
    return pv.preview_lists(t.decisions, "supporting", 2).select("meeting_id", "item_id", "supporting")


@register("actions_by_owner", """SELECT meeting_id, item_id, owner_bucket, row_number() OVER (PARTITION BY meeting_id, owner_bucket ORDER BY item_id) AS action_no FROM (
  SELECT *, CASE WHEN owner IS NULL OR owner IN ('', 'Unclear', 'Unassigned') THEN 'Unassigned' ELSE owner END AS owner_bucket FROM actions) a""")
def _(t):
    return rp.actions_by_owner(t.actions).select("meeting_id", "item_id", "owner_bucket", "action_no")


# ------------------------------------------------------------------ C, B: validation
@register("word_overlap", f"""
SELECT i.meeting_id, i.kind, i.item_id, coalesce(len(list_filter(iw, lambda w: list_contains(v.vocab, w))) / nullif(len(iw), 0)::DOUBLE, 0) AS word_overlap
FROM (SELECT *, list_distinct({words('lower(text)')}) AS iw FROM items) i
JOIN (SELECT meeting_id, list_distinct(flatten(list({words('lower(text)')}))) AS vocab FROM seg GROUP BY 1) v ON v.meeting_id = i.meeting_id""")
def _(t):
    return va.word_overlap(t.items, t.segments)


CTES["meeting_text"] = "SELECT meeting_id, string_agg(text, ' ' ORDER BY seg_id) AS full_text FROM seg GROUP BY 1"
_GRAMS = "list_concat(" + ", ".join(
    f"list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: w[i:i+{n - 1}])" for n in (2, 3, 4)
) + ")"
CTES["phrases"] = f"""
SELECT i.meeting_id, i.kind, i.item_id, coalesce(len(list_filter(p, lambda x: contains(lower(m.full_text), x))) / nullif(len(p), 0)::DOUBLE, 0) AS phrase_support FROM (
  SELECT *, list_transform(list_filter({_GRAMS}, lambda g: len(list_filter(g, lambda x: NOT list_contains({_list(rules.STOPWORDS)}, x))) * 2 >= len(g)), lambda g: array_to_string(g, ' ')) AS p
  FROM (SELECT *, {words('lower(text)')} AS w FROM items) x) i JOIN meeting_text m ON m.meeting_id = i.meeting_id"""


@register("phrase_support", "SELECT meeting_id, kind, item_id, phrase_support FROM phrases")
def _(t):
    return va.phrase_support(t.items, t.segments)


_CONTRA = "(" + " OR ".join(f"{matches('lower(text)', a)} OR {matches('lower(text)', b)}" for a, b in rules.CONTRADICTIONS) + ")"
_TOK = lambda terms: f"list_has_any({words('lower(text)')}, {_list(terms)})"
_SHORT = f"len({words('text')}) < 3"
_TRUNC = "(ends_with(text, '...') OR ends_with(text, ' and'))"
_NOOWN = f"(contains(lower(text), 'will') AND NOT ({matches('text', rules.HAS_OWNER[0])} OR {matches('text', rules.HAS_OWNER[1])}))"


@register("contradiction_flags", f"SELECT meeting_id, seg_id, {_CONTRA} AS contradiction FROM seg")
def _(t):
    return va.contradiction_flags(t.segments).select("meeting_id", "seg_id", "contradiction")


@register("verb_language_flags", f"SELECT meeting_id, seg_id, {_TOK(rules.CLEAR_ACTION_VERBS)} AS clear_action_verb, {_TOK(rules.DECISION_WORDS)} AS decision_language FROM seg")
def _(t):
    return va.verb_language_flags(t.segments).select("meeting_id", "seg_id", "clear_action_verb", "decision_language")


@register("completeness_flags", f"SELECT meeting_id, kind, item_id, {_SHORT} AS too_short, {_TRUNC} AS truncated, {_NOOWN} AS missing_owner FROM items")
def _(t):
    return va.completeness_flags(t.items).select("meeting_id", "kind", "item_id", "too_short", "truncated", "missing_owner")


@register("overall_validity", f"""
SELECT i.meeting_id, i.kind, i.item_id, p.phrase_support AS source_support, p.phrase_support > 0.3 AND NOT {_CONTRA.replace('text', 'i.text')} AS is_valid,
  {_CONTRA.replace('text', 'i.text')}::INT + (i.kind = 'action' AND NOT {_TOK(rules.CLEAR_ACTION_VERBS).replace('text', 'i.text')})::INT + (i.kind = 'decision' AND NOT {_TOK(rules.DECISION_WORDS).replace('text', 'i.text')})::INT
   + ({_SHORT.replace('text', 'i.text')})::INT + {_TRUNC.replace('text', 'i.text')}::INT + (i.kind = 'action' AND {_NOOWN.replace('text', 'i.text')})::INT AS n_issues
FROM items i JOIN phrases p ON p.meeting_id = i.meeting_id AND p.kind = i.kind AND p.item_id = i.item_id""")
def _(t):
    v = va.validate_items(t.items, t.segments)
    return v.select("meeting_id", "kind", "item_id", "source_support", "is_valid", F.size("issues").alias("n_issues"))


CTES["owner_checks"] = """
SELECT o.meeting_id, o.owner, s.speaker IS NOT NULL AS found_as_speaker, contains(lower(m.full_text), lower(o.owner)) AS mentioned_in_text FROM (SELECT DISTINCT meeting_id, owner FROM actions WHERE owner <> '') o
LEFT JOIN (SELECT DISTINCT meeting_id, speaker FROM seg) s ON s.meeting_id = o.meeting_id AND s.speaker = o.owner JOIN meeting_text m ON m.meeting_id = o.meeting_id"""


CTES["owner_matches"] = """
SELECT o.meeting_id, o.owner, arg_min(s.speaker, (-r.ratio, s.speaker)) AS close_match FROM owner_checks o
JOIN (SELECT DISTINCT meeting_id, speaker FROM seg WHERE speaker IS NOT NULL) s ON s.meeting_id = o.meeting_id JOIN name_ratios r ON r.a = lower(o.owner) AND r.b = lower(s.speaker)
WHERE r.ratio > 0.7 AND NOT o.found_as_speaker GROUP BY 1, 2"""


@register("validate_owner", """SELECT o.meeting_id, o.owner, found_as_speaker, mentioned_in_text, found_as_speaker OR mentioned_in_text AS is_valid, m.close_match
FROM owner_checks o LEFT JOIN owner_matches m ON m.meeting_id = o.meeting_id AND m.owner = o.owner""")
def _(t):
    return va.validate_owner(t.actions, "owner", t.segments)


def _with_typo(t):
    p = F.transform("participants", lambda p: F.when(F.col("item_id") % 2 == 0, F.regexp_replace(p, "n", "nn")).otherwise(p))
    return t.decisions.withColumn("participants", p)


CTES["typo_participants"] = "SELECT meeting_id, item_id, CASE WHEN item_id % 2 = 0 THEN regexp_replace(speaker, 'n', 'nn', 'g') ELSE speaker END AS participant FROM decisions WHERE speaker IS NOT NULL"
CTES["participant_checks"] = """
SELECT p.meeting_id, p.item_id, p.participant, coalesce(bool_or(s.speaker = p.participant), false) OR contains(lower(m.full_text), lower(p.participant)) AS found_in_source,
  CASE WHEN NOT coalesce(bool_or(s.speaker = p.participant), false) THEN arg_min(s.speaker, (-r.ratio, s.speaker)) FILTER (r.ratio > 0.7) END AS near
FROM typo_participants p JOIN meeting_text m ON m.meeting_id = p.meeting_id LEFT JOIN (SELECT DISTINCT meeting_id, speaker FROM seg WHERE speaker IS NOT NULL) s ON s.meeting_id = p.meeting_id
LEFT JOIN name_ratios r ON r.a = lower(p.participant) AND r.b = lower(s.speaker) GROUP BY p.meeting_id, p.item_id, p.participant, m.full_text"""


@register("validate_participants", """SELECT meeting_id, item_id, participant, found_in_source, CASE WHEN NOT found_in_source THEN near END AS close_match,
  CASE WHEN found_in_source THEN 0.9 WHEN near IS NOT NULL THEN 0.5 ELSE 0.1 END::DOUBLE AS confidence FROM participant_checks""")
def _(t):
    return va.validate_participants(_with_typo(t), t.segments)


@register("participant_validation_rate", "SELECT meeting_id, item_id, avg(found_in_source::INT) AS validation_rate FROM participant_checks GROUP BY 1, 2")
def _(t):
    return va.participant_validation_rate(va.validate_participants(_with_typo(t), t.segments))


@register("quantitative_support", """
SELECT v.meeting_id, v.item_id, v.value_kind, v.value, contains(lower(m.full_text), lower(v.value)) AS found FROM (
  SELECT DISTINCT meeting_id, item_id, 'date' AS value_kind, unnest(dates) AS value FROM decisions UNION ALL SELECT DISTINCT meeting_id, item_id, 'number', unnest(numbers) || (CASE WHEN item_id % 3 = 0 THEN '77' ELSE '' END) FROM decisions) v
JOIN meeting_text m ON m.meeting_id = v.meeting_id""")
def _(t):
    q = F.col("quantitative")
    numbers = F.transform(q["numbers"], lambda n: F.concat(n, F.when(F.col("item_id") % 3 == 0, "77").otherwise("")))
    d = t.decisions.withColumn("quantitative", F.struct(q["dates"].alias("dates"), numbers.alias("numbers")))
    return va.quantitative_support(d, t.segments)


# ------------------------------------------------------------------ flagship
@register("meeting_overview", """
SELECT d.meeting_id, count(*) AS decisions, count(*) FILTER (l.n > 0) AS decisions_with_source, avg(d.confidence) AS avg_confidence, max(l.best) AS best_similarity
FROM decisions d LEFT JOIN (SELECT meeting_id, item_id, count(*) AS n, max(similarity) AS best FROM links WHERE kind = 'decision' GROUP BY 1, 2) l ON l.meeting_id = d.meeting_id AND l.item_id = d.item_id GROUP BY 1""")
def _(t):
    """Decisions, their best sources, and one row per meeting."""
    items = dd.union_items(t.decisions, t.actions, t.risks).filter("kind = 'decision'")
    links = pv.link_provenance_lexical(items, t.segments).groupBy("meeting_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("best"))
    return items.join(links, ["meeting_id", "item_id"], "left").groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("decisions"), F.count("n").alias("decisions_with_source"), F.avg("confidence").alias("avg_confidence"), F.max("best").alias("best_similarity")
    )
