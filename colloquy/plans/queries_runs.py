"""Whole evaluation runs: all metrics of extracted meetings by job, their scores with reviews and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import evaluation as ev
from colloquy.operators import summaries as sm
from colloquy.plans import flow
from colloquy.plans.catalog import CTES, register, words
from colloquy.plans.queries_evaluation import _LEVEL, _completeness
from colloquy.plans.queries_sources import _replies
from colloquy.plans.queries_vectors import _TERM, _TOK, rouge_sql, summary_ctes

# ------------------------------------------------------------------ what extract_all keeps
CTES["kept"] = """
SELECT i.* FROM items i JOIN support s ON s.meeting_id = i.meeting_id AND s.kind = i.kind AND s.item_id = i.item_id
WHERE CASE WHEN i.kind = 'decision' AND s.n > 0 AND s.s / s.n > 0.7 THEN least(i.confidence + 0.1::DOUBLE, 0.95::DOUBLE) ELSE i.confidence END >= 0.4"""
CTES["run_best"] = summary_ctes("run", 487)
CTES["summaries"] = "SELECT m.meeting_id, coalesce(b.summary, '') AS summary FROM (SELECT DISTINCT meeting_id FROM seg) m LEFT JOIN run_best b ON b.meeting_id = m.meeting_id"
CTES["run_pairs"] = "SELECT s.meeting_id, d.text AS source, s.summary FROM summaries s JOIN documents d ON d.doc_id = s.meeting_id"
CTES["run_toks"] = f"SELECT meeting_id, {_TOK.format('source')} AS a, {_TOK.format('summary')} AS b FROM run_pairs"
CTES["run_texts"] = "SELECT s.meeting_id, m.full_text AS source, s.summary FROM summaries s JOIN meeting_text m ON m.meeting_id = s.meeting_id"
#: One step of the longest common subsequence a word of the source, over a row a summary.
CTES["run_steps"] = "SELECT meeting_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS w FROM run_toks WHERE len(b) > 0"
CTES["run_places"] = "SELECT meeting_id, unnest(range(1, len(b) + 1)) AS j, unnest(b) AS u FROM run_toks"
_LCS = """SELECT meeting_id, 0::BIGINT AS i, j, u, 0::BIGINT AS v FROM run_places UNION ALL
  SELECT meeting_id, i, j, u, max(c) OVER (PARTITION BY meeting_id ORDER BY j) AS v FROM (
    SELECT l.meeting_id, s.i, l.j, l.u, greatest(l.v, CASE WHEN l.u = s.w THEN coalesce(lag(l.v) OVER (PARTITION BY l.meeting_id ORDER BY l.j), 0) + 1 ELSE 0 END) AS c
    FROM lcs l JOIN run_steps s ON s.meeting_id = l.meeting_id AND s.i = l.i + 1) x"""
_ROUGE_L = """
SELECT t.meeting_id, coalesce(m / nullif(len(b), 0)::DOUBLE, 0) AS p, coalesce(m / nullif(len(a), 0)::DOUBLE, 0) AS r FROM run_toks t
LEFT JOIN (SELECT meeting_id, max(v) AS m FROM lcs GROUP BY 1) l ON l.meeting_id = t.meeting_id"""

# ------------------------------------------------------------------ metrics
_share = lambda c: f"avg((coalesce({c}, false))::INT)"
_KEPT = {k: f"(SELECT x.* FROM {t} x JOIN kept k ON k.meeting_id = x.meeting_id AND k.item_id = x.item_id AND k.kind = '{k}') y" for k, t in
         (("decision", "decisions"), ("action", "actions"), ("risk", "risks"))}
_COMPLETE = {
    "decision": {"description_quality": _share("length(text) > 20"), "rationale_coverage": "0.0::DOUBLE", "ownership_coverage": "0.0::DOUBLE"},
    "action": {"owner_coverage": _share("owner <> ''"), "timeline_coverage": _share("due_date <> ''"), "description_quality": _share("length(action) > 10")},
    "risk": {"impact_coverage": "0.0::DOUBLE", "likelihood_coverage": "0.0::DOUBLE", "mitigation_coverage": "0.0::DOUBLE"},
}


def _cells(names, component: str, source: str, prefix: str = "", key: str = "meeting_id") -> str:
    return f"SELECT {key} AS job_id, {component} AS component, unnest([{', '.join(repr(prefix + n) for n in names)}]) AS metric, unnest([{', '.join(f'{n}::DOUBLE' for n in names)}]) AS value FROM ({source}) q"


_PARTS = []
for _k, _c in flow.COMPONENT_OF.items():
    _m = _COMPLETE[_k]
    _inner = f"SELECT meeting_id, {', '.join(f'{e} AS {n}' for n, e in _m.items())} FROM {_KEPT[_k]} GROUP BY 1"
    _PARTS.append(_cells([*_m, "overall"], f"'{_c}'", f"SELECT *, ({' + '.join(_m)}) / 3 AS overall FROM ({_inner}) z", "completeness_"))
CTES["run_complete"] = "\nUNION ALL ".join(_PARTS)
_kind = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in flow.COMPONENT_OF.items()) + " END"
CTES["run_matched"] = CTES["matched"].replace("FROM items i", "FROM kept i")
_PRF = """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
 SELECT *, CASE WHEN n_predicted > 0 THEN matches / n_predicted::DOUBLE ELSE 0 END AS precision, CASE WHEN n_gold > 0 THEN matches / n_gold::DOUBLE ELSE 0 END AS recall FROM (
  SELECT meeting_id, kind, coalesce(i.n, 0) AS n_predicted, coalesce(g.n, 0) AS n_gold, coalesce(m.n, 0) AS matches FROM (SELECT meeting_id, kind, count(*) AS n FROM kept GROUP BY 1, 2) i
  FULL JOIN (SELECT meeting_id, kind, count(*) AS n FROM gold GROUP BY 1, 2) g USING (meeting_id, kind) LEFT JOIN (SELECT meeting_id, kind, count(*) AS n FROM run_matched GROUP BY 1, 2) m USING (meeting_id, kind)) x) y"""
_COVER = f"""
SELECT meeting_id, token_overlap, tfidf_similarity, (token_overlap + tfidf_similarity) / 2 AS coverage_score FROM (
 SELECT p.meeting_id, token_overlap, coalesce(sim, 0) AS tfidf_similarity FROM (
  SELECT meeting_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0 END AS token_overlap FROM (
    SELECT meeting_id, list_distinct({words('lower(source)')}) AS a, list_distinct({words('lower(summary)')}) AS b FROM run_texts) x) p
 LEFT JOIN (SELECT meeting_id, sum(s * m * w * w) / nullif(sqrt(sum(s * s * w * w)) * sqrt(sum(m * m * w * w)), 0) AS sim FROM (
  SELECT meeting_id, t, sum(s) AS s, sum(m) AS m, ln(3.0 / (1 + (sum(s) > 0)::INT + (sum(m) > 0)::INT)) + 1 AS w FROM (
    SELECT meeting_id, unnest({_TERM.format('source')}) AS t, 1 AS s, 0 AS m FROM run_texts UNION ALL SELECT meeting_id, unnest({_TERM.format('summary')}), 0, 1 FROM run_texts) y GROUP BY 1, 2) z GROUP BY 1) q
 ON q.meeting_id = p.meeting_id) c"""
_STATS = f"SELECT meeting_id, length(summary) AS length_chars, len({words('summary')}) AS length_words, length(summary) / nullif(length(source), 0)::DOUBLE AS compression_ratio FROM run_texts"
CTES["lcs"] = _LCS
CTES["rouge_rows"] = _ROUGE_L
CTES["run_rouge_l"] = "SELECT meeting_id, p AS rouge_l_p, r AS rouge_l_r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS rouge_l_f FROM rouge_rows"
CTES["run_quality"] = """
SELECT job_id, component, value AS quality FROM run_complete WHERE metric = 'completeness_overall'
UNION ALL SELECT s.meeting_id, 'summary', coalesce(r.rouge_l_f, 0) FROM summaries s LEFT JOIN run_rouge_l r ON r.meeting_id = s.meeting_id"""
CTES["run_metrics"] = "\nUNION ALL ".join([
    "SELECT job_id, component, metric, value FROM run_complete",
    _cells(["unique_ratio", "avg_length", "total_items"], _kind, "SELECT meeting_id, kind, count(DISTINCT text) / count(*)::DOUBLE AS unique_ratio, avg(length(text)) AS avg_length, count(*) AS total_items FROM kept GROUP BY 1, 2"),
    _cells(["token_overlap", "tfidf_similarity", "coverage_score"], "'summary'", _COVER),
    _cells(["length_chars", "length_words", "compression_ratio"], "'summary'", _STATS),
    _cells(["n_predicted", "n_gold", "matches", "precision", "recall", "f1"], _kind, _PRF),
    *[_cells([f"rouge_{n}_{x}" for x in "prf"], "'summary'", rouge_sql(n, "meeting_id", "run_pairs", "run_toks")) for n in (1, 2)],
    _cells(["rouge_l_p", "rouge_l_r", "rouge_l_f"], "'summary'", "SELECT * FROM run_rouge_l"),
    "SELECT job_id, component, 'quality', quality FROM run_quality",
    "SELECT job_id, 'overall_quality', 'quality', avg(quality) FROM run_quality GROUP BY 1",
])

# ------------------------------------------------------------------ scores
CTES["run_replies"] = r"""
SELECT job_id, component, criterion, score FROM (
 SELECT r.job_id, r.component, s.criterion, CASE WHEN r.body IS NULL THEN 5.0 ELSE CAST(json_extract(r.body, '$.scores.' || s.criterion) AS DOUBLE) END AS score
 FROM (SELECT *, try_cast(nullif(regexp_extract(reply, '(?s)\{.*\}'), '') AS JSON) AS body FROM replies) r JOIN eval_schema s ON s.component = r.component) x WHERE score IS NOT NULL"""
CTES["run_scores"] = """
SELECT job_id, 'metrics' AS source, component, CASE metric WHEN 'rouge_l_f' THEN 'rouge' ELSE 'completeness' END AS criterion, value * 10 AS score FROM run_metrics
WHERE metric IN ('completeness_overall', 'rouge_l_f')
UNION ALL SELECT job_id, source, component, criterion, score FROM eval_scores WHERE source = 'human'
UNION ALL SELECT job_id, 'llm', component, criterion, score FROM run_replies"""
CTES["run_criteria"] = """
SELECT job_id, component, criterion, (coalesce(llm * wl, 0) + coalesce(human * wh, 0) + coalesce(metrics * wm, 0)) / (CASE WHEN llm IS NULL THEN 0 ELSE wl END + CASE WHEN human IS NULL THEN 0 ELSE wh END + CASE WHEN metrics IS NULL THEN 0 ELSE wm END) AS score
FROM (SELECT c.*, CASE WHEN h.job_id IS NULL THEN 0.5 ELSE 0.4 END::DOUBLE AS wl, CASE WHEN h.job_id IS NULL THEN 0.3 ELSE 0.4 END::DOUBLE AS wh, 0.2::DOUBLE AS wm FROM (
  SELECT job_id, component, criterion, max(score) FILTER (source = 'llm') AS llm, max(score) FILTER (source = 'human') AS human, max(score) FILTER (source = 'metrics') AS metrics FROM run_scores GROUP BY ALL) c
  LEFT JOIN (SELECT DISTINCT job_id FROM run_scores WHERE source = 'human') h ON h.job_id = c.job_id) x"""
CTES["run_components"] = "SELECT c.job_id, c.component, coalesce(sum(c.score * s.weight), 0) AS overall_score FROM run_criteria c LEFT JOIN eval_schema s ON s.component = c.component AND s.criterion = c.criterion GROUP BY 1, 2"
CTES["run_totals"] = "SELECT job_id, avg(overall_score) AS aggregate_score FROM run_components GROUP BY 1"
CTES["run_agreement"] = """
SELECT j.job_id, CASE WHEN a.agreement >= 0.8 THEN 'high' WHEN a.agreement >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT DISTINCT job_id FROM run_scores) j LEFT JOIN (
  SELECT l.job_id, avg(1 - abs(l.s - h.s) / 10) AS agreement FROM (SELECT e.job_id, e.component, coalesce(sum(e.score * s.weight), 0) AS s FROM run_scores e LEFT JOIN eval_schema s ON s.component = e.component AND s.criterion = e.criterion WHERE e.source = 'llm' GROUP BY 1, 2) l
  JOIN (SELECT job_id, component, avg(score) AS s FROM run_scores WHERE source = 'human' GROUP BY 1, 2) h ON h.job_id = l.job_id AND h.component = l.component GROUP BY 1) a ON a.job_id = j.job_id"""


def _inputs(t) -> dict:
    """Human scores, model replies, gold items of the meetings, and documents of the same number as gold summaries."""
    return {
        "judged": t.eval_scores.filter("source = 'human'"), "schema": t.eval_schema, "replies": _replies(t), "gold_items": t.gold,
        "gold_summaries": t.read("documents").select(F.col("doc_id").alias("meeting_id"), "text"),
    }


@register("evaluation_metrics", "SELECT job_id, component, metric, round(value, 9) AS value FROM run_metrics")
def _(t):
    """Every metric of the extracted meetings: item and summary quality against transcripts, gold items and gold summaries."""
    i = _inputs(t)
    run = flow.extract_all(t.segments)
    m = flow.metric_table(run, run.segments, i["gold_items"], i["gold_summaries"])
    return m.withColumn("value", F.round("value", 9))


@register("evaluate_all", f"SELECT job_id, round(aggregate_score, 9) AS aggregate_score, {_LEVEL('round(aggregate_score, 9)')} AS quality_level FROM run_totals")
def _(t):
    totals = flow.evaluate_all(t.segments, **_inputs(t)).totals
    return totals.withColumn("aggregate_score", F.round("aggregate_score", 9))


@register("batch_evaluate", f"""
SELECT j.job_id, round(a.aggregate_score, 9) AS aggregate_score, CASE WHEN a.job_id IS NOT NULL THEN {_LEVEL('round(a.aggregate_score, 9)')} END AS quality_level, g.confidence,
  round(q.v, 9) AS overall_quality, CASE WHEN a.job_id IS NULL THEN 'failed' ELSE 'completed' END AS status
FROM (SELECT doc_id AS job_id FROM documents) j LEFT JOIN run_totals a ON a.job_id = j.job_id LEFT JOIN run_agreement g ON g.job_id = j.job_id
LEFT JOIN (SELECT job_id, avg(quality) AS v FROM run_quality GROUP BY 1) q ON q.job_id = j.job_id""")
def _(t):
    """All documents' numbers as jobs: some have a transcript, some only reviews, some nothing."""
    jobs = t.read("documents").select(F.col("doc_id").alias("job_id"))
    out = flow.batch_evaluate(jobs, t.segments, **_inputs(t))
    return out.withColumn("aggregate_score", F.round("aggregate_score", 9)).withColumn("overall_quality", F.round("overall_quality", 9))


@register("component_quality", """
SELECT meeting_id, component, score FROM quality_parts UNION ALL SELECT meeting_id, 'overall_quality', avg(score) FROM quality_parts GROUP BY 1""")
def _(t):
    """Completeness of the extracted items and ROUGE-L of the summaries against documents of the same number."""
    gold = t.read("documents").select(F.col("doc_id").alias("meeting_id"), F.col("text").alias("source"))
    return ev.component_quality(_completeness(t), sm.rouge_l(t.summaries.join(gold, "meeting_id"), "meeting_id"))


CTES["quality_parts"] = "SELECT meeting_id, component, value AS score FROM completeness WHERE metric = 'overall' UNION ALL SELECT meeting_id, 'summary', rouge_l_f FROM run_rouge_l"
