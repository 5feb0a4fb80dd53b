"""Whole runs composed from the operators, one Spark job for all meetings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import cleaning as cl
from colloquy.operators import evaluation as ev
from colloquy.operators import extraction as ex
from colloquy.operators import provenance as pv
from colloquy.operators import speakers as sp
from colloquy.operators import summaries as sm
from colloquy.operators import validation as va
from colloquy.operators import windows as wi
from colloquy.operators.dedup import union_items
from colloquy.session import materialize
from colloquy.sources.replies import salvage_json


def preprocess(
    segments: DataFrame, small_talk: bool = True, merge_turns: bool = True, fillers: bool = True, speakers: bool = True
) -> DataFrame:
    """Cleaning chain; every step can be switched off."""
    out = segments
    if small_talk:
        out = out.transform(cl.drop_small_talk)
    if merge_turns:
        out = out.transform(cl.merge_short_turns)
    if fillers:
        out = out.transform(cl.clean_text)
    if speakers:
        out = out.transform(cl.null_invalid_speakers).transform(cl.canonicalise_speakers)
    return out


def preprocess_counters(segments: DataFrame) -> DataFrame:
    """Row counts per meeting before and after each cleaning step."""
    quiet = cl.drop_small_talk(segments)
    merged = cl.merge_short_turns(quiet)
    clean = cl.clean_text(merged)
    return cl.count_stages({"original": segments, "without_small_talk": quiet, "merged": merged, "final": clean})


def enhanced_preprocess(segments: DataFrame, diarization: DataFrame, calendar: DataFrame) -> DataFrame:
    """Speakers by time, then by calendar, punctuation, pronouns, then the cleaning chain."""
    spoken = sp.map_speakers_to_participants(sp.assign_speakers_by_time(segments, diarization), calendar)
    punctuated = spoken.withColumn("text", tx.restore_punctuation(F.col("text")))
    return preprocess(materialize(wi.resolve_pronouns(punctuated)))


@dataclass
class Extraction:
    segments: DataFrame
    decisions: DataFrame
    actions: DataFrame
    risks: DataFrame
    items: DataFrame
    provenance: DataFrame
    validation: DataFrame
    summaries: DataFrame
    meetings: DataFrame


def extract_all(segments: DataFrame) -> Extraction:
    """Items, their sources, their validation, summaries and one quality row per meeting."""
    segments = materialize(segments)
    # each extraction is read by the union, its own output and the counts
    decisions, actions, risks = (materialize(f(segments)) for f in (ex.extract_decisions, ex.extract_actions, ex.extract_risks))
    raw = materialize(union_items(decisions, actions, risks))
    links = materialize(pv.link_provenance_lexical(raw, segments))
    # only decisions are boosted, so the rows of the other kinds need no join. A step read more than once is stored, as plans that
    # repeat it fill the driver whatever the data
    boosted = pv.boost_confidence(decisions.withColumn("kind", F.lit("decision")), links.filter("kind = 'decision'")).drop("kind")
    decisions = materialize(ex.filter_confidence(boosted))
    actions, risks = ex.filter_confidence(actions), ex.filter_confidence(risks)
    items = materialize(union_items(decisions, actions, risks))
    summaries = sm.extractive_summary(segments)
    all_summaries = materialize(segments.select("meeting_id").distinct().join(summaries, "meeting_id", "left").na.fill("", ["summary"]))
    counts = ev.extraction_counts(items, all_summaries)
    meta = ev.meeting_metadata(segments, all_summaries, decisions)
    meetings = ev.quality_gate(counts, ev.redundancy_ratio(all_summaries)).join(meta, "meeting_id")
    return Extraction(
        segments, ex.decisions_output(decisions), ex.actions_output(actions), ex.risks_output(risks),
        items, links, va.validate_items(items, segments), all_summaries, meetings,
    )


@dataclass
class Evaluation:
    metrics: DataFrame | None
    scores: DataFrame
    components: DataFrame
    totals: DataFrame
    agreement: DataFrame
    report: DataFrame
    improvements: DataFrame


def evaluate_scores(scores: DataFrame, schema: DataFrame, metrics: DataFrame | None = None) -> Evaluation:
    scores = materialize(scores)
    criteria = materialize(ev.weighted_criterion_scores(scores))
    components = ev.component_scores(criteria, schema)
    recs = ev.recommendations(criteria, components, scores)
    return Evaluation(
        metrics, criteria, components, ev.aggregate_score(components), ev.source_agreement(scores, schema),
        ev.improvement_report(criteria, components, scores), ev.priority_improvements(recs),
    )


COMPONENT_OF = {"decision": "decisions", "action": "action_items", "risk": "risks"}


def _long(rows: DataFrame, component, prefix: str = "") -> DataFrame:
    """(job_id, component, metric, value): every column but the meeting and the kind as one row."""
    names = [c for c in rows.columns if c not in ("meeting_id", "kind", "component")]
    cells = F.array(*[F.struct(F.lit(prefix + n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return rows.select(F.col("meeting_id").alias("job_id"), component.alias("component"), F.inline(cells))


def metric_table(extraction: Extraction, segments: DataFrame, gold_items: DataFrame | None = None, gold_summaries: DataFrame | None = None) -> DataFrame:
    """Every metric of a run as (job_id, component, metric, value).

    Items: completeness, diversity, and with gold_items(meeting_id, kind, gold_id, text) precision, recall and F1. Summaries:
    coverage and statistics against the meeting's segments, and with gold_summaries(meeting_id, text) ROUGE-1, -2 and -L. Component
    qualities and their mean: ROUGE-L F for the summary (0 without a gold summary), completeness for the others.

    Steps of many shuffles are jobs of their own, as a plan is planned anew after each of its stages, which takes the driver memory by
    the square of the plan, whatever the data. The parts, of one or two shuffles each, are one job: every job costs the driver, too.
    """
    kind = F.element_at(F.create_map(*[F.lit(x) for p in COMPONENT_OF.items() for x in p]), F.col("kind"))
    summary = F.lit("summary")
    complete = materialize(ev.completeness_metrics(extraction.decisions, extraction.actions, extraction.risks))
    parts = [
        complete.select(F.col("meeting_id").alias("job_id"), "component", F.concat(F.lit("completeness_"), "metric").alias("metric"), "value"),
        _long(ev.diversity_metrics(extraction.items), kind),
        _long(sm.transcript_coverage(segments, extraction.summaries), summary),
        _long(sm.transcript_statistics(segments, extraction.summaries), summary),
    ]
    if gold_items is not None:
        parts.append(materialize(_long(ev.precision_recall_f1(extraction.items, materialize(gold_items)), kind)))
    best = extraction.summaries.select("meeting_id", F.lit(0.0).alias("rouge_l_f"))
    if gold_summaries is not None:
        pairs = materialize(extraction.summaries.join(gold_summaries.select("meeting_id", F.col("text").alias("source")), "meeting_id"))
        longest = materialize(sm.rouge_l(pairs, "meeting_id"))
        parts += [_long(r, summary) for r in (sm.rouge_n(pairs, "meeting_id", 1), sm.rouge_n(pairs, "meeting_id", 2), longest)]
        best = materialize(extraction.summaries.select("meeting_id").join(longest, "meeting_id", "left").na.fill(0.0, ["rouge_l_f"]))
    parts.append(_long(ev.component_quality(complete, best).withColumnRenamed("score", "quality"), F.col("component")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialize(out)


def metric_scores(metrics: DataFrame) -> DataFrame:
    """eval_scores rows of source 'metrics' on the 0–10 scale: completeness of items, ROUGE-L of summaries."""
    criterion = F.when(F.col("metric") == "completeness_overall", "completeness").when(F.col("metric") == "rouge_l_f", "rouge")
    return metrics.withColumn("criterion", criterion).filter("criterion is not null").select(
        "job_id", F.lit("metrics").alias("source"), "component", "criterion", (F.col("value") * 10).alias("score"), F.lit(None).cast("string").alias("explanation"))


def reply_scores(replies: DataFrame, schema: DataFrame) -> DataFrame:
    """eval_scores rows of source 'llm' from model replies (job_id, component, reply)."""
    return salvage_json(replies, schema).select(
        "job_id", F.lit("llm").alias("source"), "component", "criterion", "score", F.lit(None).cast("string").alias("explanation"))


def evaluate_all(
    segments: DataFrame, judged: DataFrame, schema: DataFrame, gold_summaries: DataFrame | None = None,
    gold_items: DataFrame | None = None, replies: DataFrame | None = None,
) -> Evaluation:
    """All metrics of the extracted meetings, joined by job with judged (llm, human) scores and parsed model replies."""
    extraction = extract_all(segments)
    metrics = metric_table(extraction, extraction.segments, gold_items, gold_summaries)
    scores = metric_scores(metrics).unionByName(judged)
    if replies is not None:
        scores = scores.unionByName(reply_scores(replies, schema))
    return evaluate_scores(scores, schema, metrics)


def batch_evaluate(
    jobs: DataFrame, segments: DataFrame, judged: DataFrame, schema: DataFrame, gold_summaries: DataFrame | None = None,
    gold_items: DataFrame | None = None, replies: DataFrame | None = None,
) -> DataFrame:
    """Aggregate score, confidence, overall quality and state of the requested jobs, all in one run.

    A job without a transcript and without scores is 'failed', as one whose data cannot be loaded; the others are 'completed'.
    """
    wanted = materialize(jobs.select("job_id").distinct())

    def own(rows: DataFrame | None, key: str) -> DataFrame | None:
        return None if rows is None else rows.join(wanted.withColumnRenamed("job_id", key), key, "left_semi")

    e = evaluate_all(own(segments, "meeting_id"), own(judged, "job_id"), schema, own(gold_summaries, "meeting_id"), own(gold_items, "meeting_id"), own(replies, "job_id"))
    quality = e.metrics.filter("metric = 'quality' and component = 'overall_quality'").select("job_id", F.col("value").alias("overall_quality"))
    out = wanted.join(e.totals, "job_id", "left").join(e.agreement.select("job_id", "confidence"), "job_id", "left").join(quality, "job_id", "left")
    return out.withColumn("status", F.when(F.col("aggregate_score").isNull(), "failed").otherwise("completed"))
