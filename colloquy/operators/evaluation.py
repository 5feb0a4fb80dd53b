"""Scores of extraction quality: sources combined, weighted, graded and reported.

Long fact: eval_scores(job_id, source, component, criterion, score, explanation).
Scores stay unrounded here; reports round them for display.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx
from colloquy.operators.containment import contains_pairs
from colloquy.session import materialize

JCC = ["job_id", "component", "criterion"]
SOURCES = ["llm", "human", "metrics"]


def default_eval_schema(spark: SparkSession) -> DataFrame:
    """Component, criterion and weight; a fixed table of thirteen rows."""
    return spark.createDataFrame(
        [(c, k, i, w) for i, (c, k, w) in enumerate(rules.EVAL_SCHEMA)],
        "component string, criterion string, criterion_no int, weight double",
    )


def quality_level(score):
    out = None
    for low, high, name in rules.SCORE_LEVELS:
        hit = (score >= low) & (score < high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Unknown")


# --------------------------------------------------------------------------- combining
def combine_sources(scores: DataFrame) -> DataFrame:
    """One row per criterion with the score of each source side by side."""
    return scores.groupBy(*JCC).agg(*[F.max(F.when(F.col("source") == s, F.col("score"))).alias(s) for s in SOURCES])


def join_weights(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """Criterion rows with their component weight; unknown criteria drop out."""
    return rows.join(F.broadcast(schema.select("component", "criterion", "weight")), ["component", "criterion"])


def weighted_criterion_scores(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(job, component, criterion, score): weighted mean over the sources that are present.

    Without given weights, jobs that have a human review use the second default set.
    """
    rows = combine_sources(scores)
    if weights:
        w = {s: F.lit(weights.get(s)).cast("double") for s in SOURCES}
    else:
        reviewed = scores.filter("source = 'human'").select("job_id").distinct().withColumn("_human", F.lit(True))
        rows = rows.join(reviewed, "job_id", "left")
        w = {
            s: F.when(F.col("_human"), rules.SOURCE_WEIGHTS_WITH_HUMAN[s]).otherwise(rules.SOURCE_WEIGHTS[s]) for s in SOURCES
        }
    zero = F.lit(0.0)
    total = sum((F.coalesce(F.col(s) * w[s], zero) for s in SOURCES), zero)
    weight = sum((F.when(F.col(s).isNotNull(), F.coalesce(w[s], zero)).otherwise(zero) for s in SOURCES), zero)
    return rows.withColumn("score", F.when(weight > 0, total / weight)).filter("score is not null").select(*JCC, "score")


def component_scores(criterion_scores: DataFrame, schema: DataFrame) -> DataFrame:
    """Σ criterion·weight per component; missing criteria are not renormalised."""
    known = join_weights(criterion_scores, schema).groupBy("job_id", "component").agg(F.sum(F.col("score") * F.col("weight")).alias("s"))
    all_components = criterion_scores.select("job_id", "component").distinct()
    return all_components.join(known, ["job_id", "component"], "left").select(
        "job_id", "component", F.coalesce("s", F.lit(0.0)).alias("overall_score")
    )


def weighted_llm_score(scores: DataFrame, schema: DataFrame, source: str = "llm") -> DataFrame:
    return component_scores(scores.filter(F.col("source") == source).select(*JCC, "score"), schema)


def aggregate_score(components: DataFrame) -> DataFrame:
    g = components.groupBy("job_id").agg(F.avg("overall_score").alias("aggregate_score"))
    return g.withColumn("quality_level", quality_level(F.col("aggregate_score")))


def source_agreement(scores: DataFrame, schema: DataFrame) -> DataFrame:
    """1 - |llm - human| / 10 averaged over the components that both judged."""
    llm = weighted_llm_score(scores, schema).select("job_id", "component", F.col("overall_score").alias("llm"))
    human = scores.filter("source = 'human'").groupBy("job_id", "component").agg(F.avg("score").alias("human"))
    both = llm.join(human, ["job_id", "component"]).groupBy("job_id").agg(F.avg(1 - F.abs(F.col("llm") - F.col("human")) / 10).alias("agreement"))
    level = F.when(F.col("agreement") >= 0.8, "high").when(F.col("agreement") >= 0.6, "medium").otherwise("low")
    return scores.select("job_id").distinct().join(both, "job_id", "left").withColumn("confidence", level)


def score_table(criterion_scores: DataFrame, components: DataFrame, criteria: list[str]) -> DataFrame:
    """One wide row per job and component: overall and every criterion."""
    wide = criterion_scores.groupBy("job_id", "component").agg(
        *[F.max(F.when(F.col("criterion") == c, F.col("score"))).alias(c) for c in criteria]
    )
    return components.join(wide, ["job_id", "component"], "left")


# --------------------------------------------------------------------------- reports
def below_pass_scores(scores: DataFrame, pass_score: float = rules.PASS_SCORE) -> DataFrame:
    low = scores.filter((F.col("source") == "llm") & (F.col("score") < pass_score))
    message = F.concat(
        tx.title_case(F.col("component")), F.lit(" - "), F.col("criterion"), F.lit(": Score "),
        F.col("score").cast("string"), F.lit("/10. "), F.coalesce("explanation", F.lit("")),
    )
    return low.select(*JCC, "score", message.alias("suggestion"))


def recommendation_lookup(criterion_scores: DataFrame, explanations: DataFrame) -> DataFrame:
    """Text for a (component, criterion), detail from the llm else the human explanation."""
    fixed = F.create_map(*[F.lit(x) for c, k, t in rules.RECOMMENDATIONS for x in (f"{c}/{k}", t)])
    text = F.coalesce(
        F.get(F.map_values(F.map_filter(fixed, lambda k, v: k == F.concat_ws("/", "component", "criterion"))), F.lit(0)),
        F.format_string("Improve %s for %s", "criterion", "component"),
    )
    why = explanations.groupBy(*JCC).agg(
        F.max(F.when(F.col("source") == "llm", F.nullif("explanation", F.lit("")))).alias("_l"),
        F.max(F.when(F.col("source") == "human", F.nullif("explanation", F.lit("")))).alias("_h"),
    )
    return criterion_scores.join(why, JCC, "left").select(
        *JCC, "score", text.alias("recommendation"), F.coalesce("_l", "_h", F.lit("")).alias("details"),
        ((10 - F.col("score")) * 0.1).alias("impact_score"),
    )


def recommendations(
    criterion_scores: DataFrame, components: DataFrame, explanations: DataFrame,
    pass_score: float = rules.PASS_SCORE, warning: float = rules.WARNING_SCORE,
) -> DataFrame:
    """Recommendations for weak criteria of weak components."""
    weak = components.filter(F.col("overall_score") < pass_score).select("job_id", "component")
    low = criterion_scores.filter(F.col("score") < warning).join(weak, ["job_id", "component"], "left_semi")
    return recommendation_lookup(low, explanations)


def priority_improvements(recs: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(F.desc("impact_score"), "component", "criterion")
    return recs.withColumn("priority_no", F.row_number().over(w)).filter(F.col("priority_no") <= k)


def improvement_report(criterion_scores: DataFrame, components: DataFrame, explanations: DataFrame) -> DataFrame:
    """Per job: strengths, weaknesses, number of recommendations and a summary sentence."""
    strong = F.col("overall_score") >= rules.PASS_SCORE
    named = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("component")))), ", ")
    c = components.groupBy("job_id").agg(
        F.avg("overall_score").alias("aggregate_score"),
        F.count_if(strong).alias("n_strengths"), F.count_if(~strong).alias("n_weaknesses"),
        named(strong).alias("strengths"), named(~strong).alias("weaknesses"),
    )
    recs = recommendations(criterion_scores, components, explanations).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_recommendations"))
    j = c.join(recs, "job_id", "left").na.fill(0, ["n_recommendations"])
    a = F.col("aggregate_score")
    closing = (
        F.when(a >= 7, "The system is performing well overall.")
        .when(a >= 5, "The system shows acceptable performance with room for improvement.")
        .otherwise("Significant improvements are needed for production readiness.")
    )
    sentence = F.concat(
        F.lit("Overall extraction quality: "), quality_level(a), F.lit(" ("), tx.two_digits(a), F.lit("/10). Found "),
        F.col("n_strengths").cast("string"), F.lit(" strong areas and "), F.col("n_weaknesses").cast("string"),
        F.lit(" areas for improvement. "), closing,
    )
    return j.withColumn("summary", sentence)


# --------------------------------------------------------------------------- reviews and jobs
def latest_review(reviews: DataFrame) -> DataFrame:
    rest = [c for c in reviews.columns if c not in ("job_id", "component")]
    return reviews.groupBy("job_id", "component").agg(
        F.max_by(F.struct(*rest), F.struct("ts", "reviewer_id")).alias("_r")
    ).select("job_id", "component", "_r.*")


def human_overall(reviews: DataFrame) -> DataFrame:
    v = F.map_values("scores")
    return reviews.withColumn("overall_score", F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))


def review_scores(reviews: DataFrame) -> DataFrame:
    """Reviews as eval_scores rows of source 'human'."""
    return reviews.select("job_id", "component", "explanations", F.explode("scores").alias("criterion", "score")).select(
        "job_id", F.lit("human").alias("source"), "component", "criterion", "score",
        F.element_at("explanations", F.col("criterion")).alias("explanation"),
    )


def retraining_candidates(reviews: DataFrame) -> DataFrame:
    return reviews.filter("mark_for_retraining")


def reviews_for_jobs(reviews: DataFrame, jobs: DataFrame) -> DataFrame:
    """Number of reviews and components covered for each requested job."""
    mine = reviews.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
    return mine.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.array_join(F.array_sort(F.collect_set("component")), ",").alias("components_reviewed")
    )


def jobs_missing_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    return jobs.join(results.select("job_id").distinct(), "job_id", "left_anti")


def jobs_with_review_flag(jobs: DataFrame, reviews: DataFrame) -> DataFrame:
    flag = reviews.select("job_id").distinct().withColumn("has_human_review", F.lit(True))
    return jobs.join(flag, "job_id", "left").na.fill(False, ["has_human_review"])


def page_jobs(jobs: DataFrame, status: str = "all", limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, one page; a top-k sort, so only limit + offset rows leave each task."""
    rows = jobs if status == "all" else jobs.filter(F.col("status") == status)
    return rows.orderBy(F.desc("ts"), "job_id").offset(offset).limit(limit)


def default_review_grid(jobs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every job × criterion with the reviewed score, else 5 and an empty text."""
    cells = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(k).alias("criterion")) for c, k, _ in rules.EVAL_SCHEMA])
    grid = jobs.select("job_id", F.explode(cells).alias("_c")).select("job_id", "_c.*")
    real = review_scores(reviews).select(*JCC, "score", "explanation")
    return grid.join(real, JCC, "left").select(
        *JCC, F.coalesce("score", F.lit(5.0)).alias("score"), F.coalesce("explanation", F.lit("")).alias("explanation")
    )


# --------------------------------------------------------------------------- item metrics
def match_items_to_gold(items: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("meeting_id", "kind")) -> DataFrame:
    """Items contained in a gold text of their meeting and kind, or containing one; each once.

    items(keys…, item_id, text), gold(keys…, gold_id, text).
    """
    keys = list(keys)
    p = items.select(*keys, "item_id", F.lower("text").alias("_p"))
    g = gold.select(*keys, "gold_id", F.lower("text").alias("_g"))
    inside = contains_pairs(p, "item_id", "_p", g, "gold_id", "_g", keys)
    around = contains_pairs(g, "gold_id", "_g", p, "item_id", "_p", keys)
    inside, around = (materialize(m.select(*keys, "item_id").distinct()) for m in (inside, around))
    return inside.unionByName(around).distinct()


def precision_recall_f1(items: DataFrame, gold: DataFrame) -> DataFrame:
    """Matched items over all items and over all gold rows, per meeting and kind."""
    keys = ["meeting_id", "kind"]
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    j = (
        count(items, "n_predicted")
        .join(count(gold, "n_gold"), keys, "full_outer")
        .join(count(match_items_to_gold(items, gold), "matches"), keys, "left")
        .na.fill(0, ["n_predicted", "n_gold", "matches"])
    )
    p = F.coalesce(F.try_divide("matches", "n_predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("matches", "n_gold"), F.lit(0.0))
    return j.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )


def _share(cond):
    return F.avg(F.coalesce(cond, F.lit(False)).cast("int"))


def action_completeness(actions: DataFrame) -> DataFrame:
    g = actions.groupBy("meeting_id").agg(
        _share(F.col("owner") != "").alias("owner_coverage"), _share(F.col("due_date") != "").alias("timeline_coverage"),
        _share(F.length("action") > 10).alias("description_quality"),
    )
    return g.withColumn("overall", (F.col("owner_coverage") + F.col("timeline_coverage") + F.col("description_quality")) / 3)


def risk_completeness(risks: DataFrame) -> DataFrame:
    has = lambda c: _share(F.col(c).isNotNull()) if c in risks.columns else F.lit(0.0)
    g = risks.groupBy("meeting_id").agg(
        has("impact").alias("impact_coverage"), has("likelihood").alias("likelihood_coverage"),
        (_share(F.size("mitigation") > 0) if "mitigation" in risks.columns else F.lit(0.0)).alias("mitigation_coverage"),
    )
    return g.withColumn("overall", (F.col("impact_coverage") + F.col("likelihood_coverage") + F.col("mitigation_coverage")) / 3)


def decision_completeness(decisions: DataFrame) -> DataFrame:
    has = lambda c: _share(F.col(c) != "") if c in decisions.columns else F.lit(0.0)
    g = decisions.groupBy("meeting_id").agg(
        _share(F.length("text") > 20).alias("description_quality"), has("rationale").alias("rationale_coverage"),
        has("decision_maker").alias("ownership_coverage"),
    )
    return g.withColumn("overall", (F.col("description_quality") + F.col("rationale_coverage") + F.col("ownership_coverage")) / 3)


def completeness_metrics(decisions: DataFrame, actions: DataFrame, risks: DataFrame) -> DataFrame:
    """(meeting_id, component, metric, value) for all three kinds, overall included."""

    def long(df, component):
        names = [c for c in df.columns if c != "meeting_id"]
        return df.select("meeting_id", F.lit(component).alias("component"), F.explode(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        ).alias("_m")).select("meeting_id", "component", "_m.*")

    return (
        long(decision_completeness(decisions), "decisions")
        .unionByName(long(action_completeness(actions), "action_items"))
        .unionByName(long(risk_completeness(risks), "risks"))
    )


def component_quality(completeness: DataFrame, rouge_l: DataFrame) -> DataFrame:
    """Summary by ROUGE-L F, other components by completeness; plus their mean."""
    parts = completeness.filter("metric = 'overall'").select("meeting_id", "component", F.col("value").alias("score")).unionByName(
        rouge_l.select("meeting_id", F.lit("summary").alias("component"), F.col("rouge_l_f").alias("score"))
    )
    mean = parts.groupBy("meeting_id").agg(F.avg("score").alias("score")).withColumn("component", F.lit("overall_quality"))
    return parts.unionByName(mean)


def diversity_metrics(items: DataFrame) -> DataFrame:
    per_text = items.groupBy("meeting_id", "kind", "text").agg(F.count(F.lit(1)).alias("n"))
    return per_text.groupBy("meeting_id", "kind").agg(
        (F.count(F.lit(1)) / F.sum("n")).alias("unique_ratio"),
        (F.sum(F.length("text") * F.col("n")) / F.sum("n")).alias("avg_length"),
        F.sum("n").alias("total_items"),
    )


def extraction_counts(items: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summary length, items per kind and mean confidence of a meeting."""
    n = items.groupBy("meeting_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}s_count") for k in ("decision", "action", "risk")],
        F.avg("confidence").alias("avg_confidence"),
    )
    length = summaries.select("meeting_id", F.length("summary").alias("summary_length"))
    return length.join(n, "meeting_id", "left").na.fill(0)


def redundancy_ratio(summaries: DataFrame, text: str = "summary") -> DataFrame:
    """1 - distinct / all sentences of each summary (empty pieces ignored)."""
    s = F.filter(F.transform(F.split(text, r"[.!?]+"), lambda x: tx.strip(F.lower(x))), lambda x: x != "")
    return summaries.select("meeting_id", F.when(F.size(s) > 0, 1 - F.size(F.array_distinct(s)) / F.size(s)).otherwise(0.0).alias("redundancy_ratio"))


def quality_gate(counts: DataFrame, redundancy: DataFrame) -> DataFrame:
    return counts.join(redundancy, "meeting_id").withColumn(
        "quality_low",
        (F.col("redundancy_ratio") > 0.3) | (F.col("decisions_count") + F.col("actions_count") < 5) | (F.col("avg_confidence") < 0.5),
    )


def meeting_metadata(segments: DataFrame, summaries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Segment count, duration class, meeting type and main topic."""
    g = segments.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("segment_count"), F.avg(tx.word_count("text")).alias("avg_words"))
    first = decisions.withColumn("_rn", F.row_number().over(Window.partitionBy("meeting_id").orderBy("seg_id"))).filter("_rn <= 3")
    hit = lambda word: F.max(F.lower("text").contains(word))
    topic = first.groupBy("meeting_id").agg(hit("launch").alias("_l"), hit("feature").alias("_f"), hit("budget").alias("_b"))
    low = F.lower("summary")
    n, avg = F.col("segment_count"), F.col("avg_words")
    return (
        g.join(summaries.select("meeting_id", "summary"), "meeting_id", "left").join(topic, "meeting_id", "left")
        .withColumn("duration", F.when((n > 100) | (avg > 50), "60").when(n > 50, "45").when(n > 20, "30").otherwise("15"))
        .withColumn(
            "meeting_type",
            F.when(low.contains("plan"), "planning").when(low.rlike("review|status"), "review").when(low.contains("retro"), "retrospective")
            .when(low.rlike("strategy|strategic"), "strategic").otherwise("discussion"),
        )
        .withColumn(
            "main_topic",
            F.when(F.col("_l"), "product launch planning").when(F.col("_f"), "feature planning").when(F.col("_b"), "budget planning")
            .when(F.col("_l").isNotNull(), "project planning").otherwise("team discussion"),
        )
        .select("meeting_id", "segment_count", "avg_words", "duration", "meeting_type", "main_topic")
    )


def target_scores(counts: DataFrame) -> DataFrame:
    """min(count / target, 1) for each kind and their mean."""
    one = lambda c, t: F.least(F.col(c) / t, F.lit(1.0))
    s = (
        counts.withColumn("decision_score", one("decisions_count", rules.TARGET_DECISIONS))
        .withColumn("action_score", one("actions_count", rules.TARGET_ACTIONS))
        .withColumn("risk_score", one("risks_count", rules.TARGET_RISKS))
    )
    return s.withColumn("overall_score", (F.col("decision_score") + F.col("action_score") + F.col("risk_score")) / 3)


def grade_extraction(scored: DataFrame, ranges: dict[str, tuple[int, int | None]] | None = None) -> DataFrame:
    """Grade by the overall score, and whether every count lies in its expected range (None: no upper bound)."""
    ranges = ranges or {"decisions_count": (8, None), "actions_count": (15, 35), "risks_count": (15, 25)}
    ok = F.lit(True)
    for c, (lo, hi) in ranges.items():
        ok = ok & (F.col(c) >= lo) & (F.lit(True) if hi is None else F.col(c) <= hi)
    o = F.col("overall_score")
    return scored.withColumn(
        "quality_grade", F.when(o >= 0.8, "EXCELLENT").when(o >= 0.6, "GOOD").when(o >= 0.4, "FAIR").otherwise("POOR")
    ).withColumn("in_range", ok)
