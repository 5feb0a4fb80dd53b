"""Evaluation queries: combined scores, reviews, metrics, gold matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import rules
from colloquy.operators import evaluation as ev
from colloquy.operators import summaries as sm
from colloquy.plans.catalog import CRITERIA, CTES, has, lit, register, strip, title_case, words

_SRC = ", ".join(f"('{s}', {i})" for i, s in enumerate(ev.SOURCES))
CTES["eval_scores"] = f"""
SELECT doc_id AS job_id, s.source, c.component, c.criterion, ((doc_id * 7 + c.criterion_no * 3 + s.sn * 5) % 11)::DOUBLE AS score,
  CASE WHEN (doc_id + c.criterion_no + s.sn) % 3 = 0 THEN 'note ' || c.criterion_no ELSE '' END AS explanation
FROM labels, eval_schema c, (VALUES {_SRC}) s(source, sn) WHERE NOT (s.source = 'human' AND doc_id % 3 = 0)"""
CTES["combined"] = "SELECT job_id, component, criterion, " + ", ".join(f"max(score) FILTER (source = '{s}') AS {s}" for s in ev.SOURCES) + " FROM eval_scores GROUP BY ALL"
CTES["criterion_scores"] = """
SELECT job_id, component, criterion, (coalesce(llm * wl, 0) + coalesce(human * wh, 0) + coalesce(metrics * wm, 0)) / (CASE WHEN llm IS NULL THEN 0 ELSE wl END + CASE WHEN human IS NULL THEN 0 ELSE wh END + CASE WHEN metrics IS NULL THEN 0 ELSE wm END) AS score
FROM (SELECT *, CASE WHEN job_id % 3 = 0 THEN 0.5 ELSE 0.4 END::DOUBLE AS wl, CASE WHEN job_id % 3 = 0 THEN 0.3 ELSE 0.4 END::DOUBLE AS wh, 0.2::DOUBLE AS wm FROM combined) x"""
CTES["components"] = "SELECT c.job_id, c.component, sum(c.score * s.weight) AS overall_score FROM criterion_scores c JOIN eval_schema s ON s.component = c.component AND s.criterion = c.criterion GROUP BY 1, 2"
_LEVEL = lambda c: "CASE " + " ".join(f"WHEN {c} >= {a} AND {c} < {b} THEN '{n}'" for a, b, n in rules.SCORE_LEVELS) + " ELSE 'Unknown' END"


@register("combine_sources", "SELECT job_id, component, criterion, llm, human, metrics FROM combined")
def _(t):
    return ev.combine_sources(t.eval_scores)


@register("join_weights", "SELECT e.job_id, e.source, e.component, e.criterion, e.score, s.weight FROM (SELECT *, CASE WHEN job_id % 5 = 0 THEN 'humour' ELSE criterion END AS c2 FROM eval_scores) e JOIN eval_schema s ON s.component = e.component AND s.criterion = e.c2")
def _(t):
    e = t.eval_scores.withColumn("criterion", F.when(F.col("job_id") % 5 == 0, "humour").otherwise(F.col("criterion")))
    return ev.join_weights(e, t.eval_schema).drop("explanation")


@register("weighted_criterion_scores", "SELECT job_id, component, criterion, round(score, 6) AS score FROM criterion_scores")
def _(t):
    return t.criterion_scores.withColumn("score", F.round("score", 6))


@register("component_scores", "SELECT job_id, component, round(overall_score, 6) AS overall_score FROM components")
def _(t):
    return t.components.withColumn("overall_score", F.round("overall_score", 6))


@register("weighted_llm_score", "SELECT e.job_id, e.component, sum(e.score * s.weight) AS overall_score FROM eval_scores e JOIN eval_schema s ON s.component = e.component AND s.criterion = e.criterion WHERE e.source = 'llm' GROUP BY 1, 2")
def _(t):
    return ev.weighted_llm_score(t.eval_scores, t.eval_schema)


CTES["totals"] = "SELECT job_id, avg(overall_score) AS aggregate_score FROM components GROUP BY 1"


@register("aggregate_score", f"SELECT job_id, aggregate_score, {_LEVEL('aggregate_score')} AS quality_level FROM totals")
def _(t):
    return ev.aggregate_score(t.components)


@register("source_agreement", """
SELECT j.job_id, a.agreement, CASE WHEN a.agreement >= 0.8 THEN 'high' WHEN a.agreement >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT DISTINCT job_id FROM eval_scores) j LEFT JOIN (
  SELECT l.job_id, avg(1 - abs(l.s - h.s) / 10) AS agreement FROM (SELECT e.job_id, e.component, sum(e.score * s.weight) AS s FROM eval_scores e JOIN eval_schema s ON s.component = e.component AND s.criterion = e.criterion WHERE e.source = 'llm' GROUP BY 1, 2) l
  JOIN (SELECT job_id, component, avg(score) AS s FROM eval_scores WHERE source = 'human' GROUP BY 1, 2) h ON h.job_id = l.job_id AND h.component = l.component GROUP BY 1) a ON a.job_id = j.job_id""")
def _(t):
    return ev.source_agreement(t.eval_scores, t.eval_schema)


@register("score_table", "SELECT c.job_id, c.component, c.overall_score, " + ", ".join(f"max(s.score) FILTER (s.criterion = '{k}') AS {k}" for k in CRITERIA) + " FROM components c JOIN criterion_scores s ON s.job_id = c.job_id AND s.component = c.component GROUP BY ALL")
def _(t):
    return ev.score_table(t.criterion_scores, t.components, CRITERIA)


@register("below_pass_scores", f"SELECT job_id, component, criterion, score, {title_case('component')} || ' - ' || criterion || ': Score ' || score || '/10. ' || explanation AS suggestion FROM eval_scores WHERE source = 'llm' AND score < 6")
def _(t):
    return ev.below_pass_scores(t.eval_scores)


_REC = "CASE " + " ".join(f"WHEN c.component = '{a}' AND c.criterion = '{b}' THEN {lit(x)}" for a, b, x in rules.RECOMMENDATIONS) + " ELSE 'Improve ' || c.criterion || ' for ' || c.component END"
CTES["recs"] = f"""
SELECT c.job_id, c.component, c.criterion, c.score, {_REC} AS recommendation, (10 - c.score) * 0.1 AS impact_score,
  coalesce((SELECT nullif(max(explanation), '') FROM eval_scores e WHERE e.job_id = c.job_id AND e.component = c.component AND e.criterion = c.criterion AND e.source = 'llm'),
           (SELECT nullif(max(explanation), '') FROM eval_scores e WHERE e.job_id = c.job_id AND e.component = c.component AND e.criterion = c.criterion AND e.source = 'human'), '') AS details
FROM criterion_scores c JOIN components o ON o.job_id = c.job_id AND o.component = c.component WHERE o.overall_score < 6 AND c.score < 5"""


@register("recommendation_lookup", "SELECT job_id, component, criterion, round(score, 6) AS score, recommendation, details, round(impact_score, 6) AS impact_score FROM recs")
def _(t):
    r = ev.recommendations(t.criterion_scores, t.components, t.eval_scores)
    return r.withColumn("score", F.round("score", 6)).withColumn("impact_score", F.round("impact_score", 6))


@register("priority_improvements", """SELECT job_id, component, criterion, round(impact_score, 6) AS impact_score, priority_no FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY round(impact_score, 9) DESC, component, criterion) AS priority_no FROM recs) x WHERE priority_no <= 5""")
def _(t):
    r = ev.recommendations(t.criterion_scores, t.components, t.eval_scores).withColumn("impact_score", F.round("impact_score", 9))
    return ev.priority_improvements(r).select("job_id", "component", "criterion", F.round("impact_score", 6).alias("impact_score"), "priority_no")


@register("improvement_report", f"""
SELECT t.job_id, round(t.aggregate_score, 6) AS aggregate_score, n_strengths, n_weaknesses, strengths, weaknesses, coalesce(r.n, 0) AS n_recommendations,
  'Overall extraction quality: ' || {_LEVEL('t.aggregate_score')} || ' (' || printf('%.2f', floor(round(t.aggregate_score, 9) * 100 + 0.5) / 100) || '/10). Found ' || n_strengths || ' strong areas and ' || n_weaknesses || ' areas for improvement. '
   || CASE WHEN t.aggregate_score >= 7 THEN 'The system is performing well overall.' WHEN t.aggregate_score >= 5 THEN 'The system shows acceptable performance with room for improvement.' ELSE 'Significant improvements are needed for production readiness.' END AS summary
FROM totals t JOIN (SELECT job_id, count(*) FILTER (overall_score >= 6) AS n_strengths, count(*) FILTER (overall_score < 6) AS n_weaknesses,
   coalesce(string_agg(component, ', ' ORDER BY component) FILTER (overall_score >= 6), '') AS strengths, coalesce(string_agg(component, ', ' ORDER BY component) FILTER (overall_score < 6), '') AS weaknesses FROM components GROUP BY 1) c ON c.job_id = t.job_id
LEFT JOIN (SELECT job_id, count(*) AS n FROM recs GROUP BY 1) r ON r.job_id = t.job_id""")
def _(t):
    return ev.improvement_report(t.criterion_scores, t.components, t.eval_scores).withColumn("aggregate_score", F.round("aggregate_score", 6))


# ------------------------------------------------------------------ reviews and jobs
CTES["reviews"] = """
SELECT *, CASE component WHEN 'summary' THEN 'coverage' WHEN 'decisions' THEN 'specificity' ELSE 'impact' END AS first_criterion, quality * 10.0::DOUBLE AS q, quality * 10.0::DOUBLE - n + 1 AS clarity FROM (
  SELECT doc_id AS job_id, quality, toxic, n, CASE WHEN doc_id % 2 = 0 THEN 'summary' WHEN n = 0 THEN 'decisions' ELSE 'risks' END AS component, 'r' || n AS reviewer_id, make_timestamp((1700000000 + doc_id * 60 + n) * 1000000) AS ts
  FROM labels, (VALUES (0), (1)) v(n)) x"""
CTES["latest_reviews"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, component ORDER BY ts DESC) AS rn FROM reviews) x WHERE rn = 1"


@register("latest_review", "SELECT job_id, component, reviewer_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, toxic = 1 AS mark_for_retraining FROM latest_reviews")
def _(t):
    return ev.latest_review(t.reviews).select("job_id", "component", "reviewer_id", "ts", "mark_for_retraining")


@register("human_overall", "SELECT job_id, component, reviewer_id, (q + clarity) / 2 AS overall_score FROM reviews")
def _(t):
    return ev.human_overall(t.reviews).select("job_id", "component", "reviewer_id", "overall_score")


@register("retraining_candidates", "SELECT job_id, component, reviewer_id FROM reviews WHERE toxic = 1")
def _(t):
    return ev.retraining_candidates(t.reviews).select("job_id", "component", "reviewer_id")


@register("reviews_for_job", "SELECT job_id, count(*) AS n_reviews, string_agg(DISTINCT component, ',' ORDER BY component) AS components_reviewed FROM reviews WHERE job_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY 1")
def _(t):
    jobs = t.read("documents").filter("lang = 'en'").select(F.col("doc_id").alias("job_id"))
    return ev.reviews_for_jobs(t.reviews, jobs)


@register("jobs_missing_results", "SELECT doc_id AS job_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    jobs = t.read("documents").select(F.col("doc_id").alias("job_id"), "lang")
    return ev.jobs_missing_results(jobs, t.read("labels").select(F.col("doc_id").alias("job_id")))


@register("jobs_with_review_flag", "SELECT d.doc_id AS job_id, d.lang, r.doc_id IS NOT NULL AS has_human_review FROM documents d LEFT JOIN labels r ON r.doc_id = d.doc_id")
def _(t):
    return ev.jobs_with_review_flag(t.read("documents").select(F.col("doc_id").alias("job_id"), "lang"), t.reviews)


@register("page_jobs", """SELECT user_id AS job_id, event_id, CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events WHERE event_type = 'error' ORDER BY ts DESC, user_id LIMIT 20 OFFSET 40""")
def _(t):
    return ev.page_jobs(t.status_log, "failed", 20, 40).select("job_id", "event_id", "status")


@register("default_review_grid", """
SELECT d.job_id, s.component, s.criterion, coalesce(CASE WHEN s.criterion = r.first_criterion THEN r.q WHEN s.criterion = 'clarity' THEN r.clarity END, 5.0) AS score,
  coalesce(CASE WHEN s.criterion = r.first_criterion THEN 'seen by ' || r.reviewer_id END, '') AS explanation
FROM (SELECT doc_id AS job_id FROM documents) d, eval_schema s LEFT JOIN latest_reviews r ON r.job_id = d.job_id AND r.component = s.component""")
def _(t):
    return ev.default_review_grid(t.read("documents").select(F.col("doc_id").alias("job_id")), ev.latest_review(t.reviews))


# ------------------------------------------------------------------ item metrics
CTES["gold"] = "SELECT meeting_id, kind, item_id AS gold_id, CASE WHEN seg_id % 2 = 1 THEN reverse(text) WHEN seg_id % 4 = 0 THEN text[4:] ELSE 'note: ' || text END AS text FROM items"
CTES["matched"] = "SELECT DISTINCT i.meeting_id, i.kind, i.item_id FROM items i JOIN gold g ON g.meeting_id = i.meeting_id AND g.kind = i.kind AND (contains(lower(g.text), lower(i.text)) OR contains(lower(i.text), lower(g.text)))"


@register("match_items_to_gold", "SELECT meeting_id, kind, item_id FROM matched")
def _(t):
    return ev.match_items_to_gold(t.items, t.gold)


@register("match_documents_to_benchmark", "SELECT DISTINCT d.doc_id AS item_id FROM documents d JOIN benchmark b ON contains(lower(b.text), lower(d.text)) OR contains(lower(d.text), lower(b.text))")
def _(t):
    """Documents that hold a benchmark passage (or lie inside one), by whole texts."""
    docs = t.read("documents").select(F.col("doc_id").alias("item_id"), "text")
    gold = t.read("benchmark").select(F.col("item_id").alias("gold_id"), "text")
    return ev.match_items_to_gold(docs, gold, ())


@register("precision_recall_f1", """
SELECT meeting_id, kind, n_predicted, n_gold, matches, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (
 SELECT *, CASE WHEN n_predicted > 0 THEN matches / n_predicted::DOUBLE ELSE 0 END AS p, CASE WHEN n_gold > 0 THEN matches / n_gold::DOUBLE ELSE 0 END AS r FROM (
  SELECT i.meeting_id, i.kind, i.n AS n_predicted, coalesce(g.n, 0) AS n_gold, coalesce(m.n, 0) AS matches FROM (SELECT meeting_id, kind, count(*) AS n FROM items GROUP BY 1, 2) i
  LEFT JOIN (SELECT meeting_id, kind, count(*) AS n FROM gold GROUP BY 1, 2) g ON g.meeting_id = i.meeting_id AND g.kind = i.kind LEFT JOIN (SELECT meeting_id, kind, count(*) AS n FROM matched GROUP BY 1, 2) m ON m.meeting_id = i.meeting_id AND m.kind = i.kind) x) y""")
def _(t):
    return ev.precision_recall_f1(t.items, t.gold)


_long = lambda src, comp, cols: f"SELECT meeting_id, '{comp}' AS component, unnest([{', '.join(lit(c) for c in cols)}, 'overall']) AS metric, unnest([{', '.join(cols)}, ({' + '.join(cols)}) / 3]) AS value FROM (SELECT meeting_id, {src} GROUP BY 1) x"
CTES["completeness"] = " UNION ALL ".join([
    _long("avg((length(text) > 20)::INT) AS description_quality, 0.0::DOUBLE AS rationale_coverage, 0.0::DOUBLE AS ownership_coverage FROM decisions", "decisions", ["description_quality", "rationale_coverage", "ownership_coverage"]),
    _long("avg((owner <> '')::INT) AS owner_coverage, avg((due_date IS NOT NULL)::INT) AS timeline_coverage, avg((length(action) > 10)::INT) AS description_quality FROM actions", "action_items", ["owner_coverage", "timeline_coverage", "description_quality"]),
    _long("avg((impact IS NOT NULL)::INT) AS impact_coverage, 0.0::DOUBLE AS likelihood_coverage, 0.0::DOUBLE AS mitigation_coverage FROM (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'x' END AS impact FROM risks) r", "risks", ["impact_coverage", "likelihood_coverage", "mitigation_coverage"]),
])


def _completeness(t):
    risks = t.risks.withColumn("impact", F.when(F.col("item_id") % 2 == 0, "x"))
    return ev.completeness_metrics(t.decisions, t.actions, risks)


@register("completeness_metrics", "SELECT meeting_id, component, metric, value FROM completeness")
def _(t):
    return _completeness(t)


@register("diversity_metrics", "SELECT meeting_id, kind, count(DISTINCT text) / count(*)::DOUBLE AS unique_ratio, avg(length(text)) AS avg_length, count(*) AS total_items FROM items GROUP BY 1, 2")
def _(t):
    return ev.diversity_metrics(t.items)


CTES["counts"] = """SELECT s.meeting_id, length(s.summary) AS summary_length, coalesce(i.d, 0) AS decisions_count, coalesce(i.a, 0) AS actions_count, coalesce(i.r, 0) AS risks_count, coalesce(i.c, 0) AS avg_confidence FROM summaries s LEFT JOIN (
  SELECT meeting_id, count(*) FILTER (kind = 'decision') AS d, count(*) FILTER (kind = 'action') AS a, count(*) FILTER (kind = 'risk') AS r, avg(confidence) AS c FROM items GROUP BY 1) i ON i.meeting_id = s.meeting_id"""


@register("extraction_counts", "SELECT meeting_id, summary_length, decisions_count, actions_count, risks_count, avg_confidence FROM counts")
def _(t):
    return ev.extraction_counts(t.items, t.summaries)


_SENT = f"list_filter(list_transform(string_split_regex({{0}}, '[.!?]+'), lambda x: {strip('lower(x)')}), lambda x: x <> '')"
CTES["redundancy"] = f"SELECT meeting_id, CASE WHEN len(s) > 0 THEN 1 - len(list_distinct(s)) / len(s)::DOUBLE ELSE 0 END AS redundancy_ratio FROM (SELECT meeting_id, {_SENT.format('summary')} AS s FROM summaries) x"


@register("redundancy_ratio", f"SELECT doc_id, CASE WHEN len(s) > 0 THEN 1 - len(list_distinct(s)) / len(s)::DOUBLE ELSE 0 END AS redundancy_ratio FROM (SELECT doc_id, {_SENT.format('text')} AS s FROM documents) x")
def _(t):
    return ev.redundancy_ratio(t.read("documents").withColumnRenamed("doc_id", "meeting_id"), "text").withColumnRenamed("meeting_id", "doc_id")


@register("quality_gate", """SELECT c.meeting_id, r.redundancy_ratio, c.decisions_count + c.actions_count AS n, r.redundancy_ratio > 0.3 OR c.decisions_count + c.actions_count < 5 OR c.avg_confidence < 0.5 AS quality_low FROM counts c JOIN redundancy r ON r.meeting_id = c.meeting_id""")
def _(t):
    g = ev.quality_gate(ev.extraction_counts(t.items, t.summaries), ev.redundancy_ratio(t.summaries))
    return g.select("meeting_id", "redundancy_ratio", (F.col("decisions_count") + F.col("actions_count")).alias("n"), "quality_low")


CTES["metadata"] = f"""
SELECT g.meeting_id, n AS segment_count, avg_words, CASE WHEN n > 100 OR avg_words > 50 THEN '60' WHEN n > 50 THEN '45' WHEN n > 20 THEN '30' ELSE '15' END AS duration,
  CASE WHEN contains(low, 'plan') THEN 'planning' WHEN regexp_matches(low, 'review|status') THEN 'review' WHEN contains(low, 'retro') THEN 'retrospective' WHEN regexp_matches(low, 'strategy|strategic') THEN 'strategic' ELSE 'discussion' END AS meeting_type,
  CASE WHEN l THEN 'product launch planning' WHEN f THEN 'feature planning' WHEN b THEN 'budget planning' WHEN l IS NOT NULL THEN 'project planning' ELSE 'team discussion' END AS main_topic
FROM (SELECT meeting_id, count(*) AS n, avg(len({words('text')})) AS avg_words FROM seg GROUP BY 1) g LEFT JOIN (SELECT meeting_id, lower(summary) AS low FROM summaries) s ON s.meeting_id = g.meeting_id
LEFT JOIN (SELECT meeting_id, bool_or(contains(lower(text), 'launch')) AS l, bool_or(contains(lower(text), 'feature')) AS f, bool_or(contains(lower(text), 'budget')) AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_id) AS k FROM decisions) d WHERE k <= 3 GROUP BY 1) t ON t.meeting_id = g.meeting_id"""


@register("meeting_metadata", "SELECT meeting_id, segment_count, avg_words, duration, meeting_type, main_topic FROM metadata")
def _(t):
    return ev.meeting_metadata(t.segments, t.summaries, t.decisions)


@register("template_summary", """SELECT m.meeting_id, 'This ' || m.duration || '-minute ' || m.meeting_type || ' session focused on ' || m.main_topic || '. ' || s.summary || CASE WHEN p <> '' THEN ' Key outcomes: ' || p || '.' ELSE '' END AS executive_summary
FROM metadata m JOIN (SELECT *, concat_ws(', ', CASE WHEN decisions_count > 0 THEN decisions_count || ' decisions made' END, CASE WHEN actions_count > 0 THEN actions_count || ' action items assigned' END, CASE WHEN risks_count > 0 THEN risks_count || ' risks identified' END) AS p FROM counts) c ON c.meeting_id = m.meeting_id
JOIN summaries s ON s.meeting_id = m.meeting_id""")
def _(t):
    return sm.template_summary(ev.meeting_metadata(t.segments, t.summaries, t.decisions), ev.extraction_counts(t.items, t.summaries), t.summaries)


@register("headline_items", """SELECT meeting_id, kind, item_id, headline_no FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, kind ORDER BY item_id) AS headline_no FROM items) i
  WHERE headline_no <= CASE kind WHEN 'decision' THEN 2 WHEN 'action' THEN 2 ELSE 1 END""")
def _(t):
    return sm.headline_items(t.items, 2, 2, 1).select("meeting_id", "kind", "item_id", "headline_no")


_TS = "least(decisions_count / 9.0::DOUBLE, 1) AS decision_score, least(actions_count / 20.0::DOUBLE, 1) AS action_score, least(risks_count / 18.0::DOUBLE, 1) AS risk_score"
CTES["targets"] = f"SELECT *, (decision_score + action_score + risk_score) / 3 AS overall_score FROM (SELECT *, {_TS} FROM counts) x"


@register("target_scores", "SELECT meeting_id, decision_score, action_score, risk_score, overall_score FROM targets")
def _(t):
    return ev.target_scores(ev.extraction_counts(t.items, t.summaries)).select("meeting_id", "decision_score", "action_score", "risk_score", "overall_score")


@register("grade_extraction", "SELECT meeting_id, CASE WHEN overall_score >= 0.8 THEN 'EXCELLENT' WHEN overall_score >= 0.6 THEN 'GOOD' WHEN overall_score >= 0.4 THEN 'FAIR' ELSE 'POOR' END AS quality_grade, decisions_count BETWEEN 2 AND 5 AND actions_count BETWEEN 1 AND 5 AS in_range FROM targets")
def _(t):
    s = ev.target_scores(ev.extraction_counts(t.items, t.summaries))
    return ev.grade_extraction(s, {"decisions_count": (2, 5), "actions_count": (1, 5)}).select("meeting_id", "quality_grade", "in_range")
