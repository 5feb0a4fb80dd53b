"""Readable output. A document is a set of ordered lines, never one string per meeting,
so its size does not depend on how much one meeting holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators.ordering import with_position

PART_ROWS = 1000
UNASSIGNED = ["Unclear", "Unassigned"]


def render_text(segments: DataFrame) -> DataFrame:
    """(meeting_id, part_no, text): 'Speaker: text' lines, a part per 1000 segment numbers."""
    line = F.concat_ws(": ", "speaker", "text")
    pieces = F.array_sort(F.collect_list(F.struct("seg_id", line.alias("l"))))
    return segments.groupBy("meeting_id", F.floor(F.col("seg_id") / PART_ROWS).alias("part_no")).agg(
        F.array_join(F.transform(pieces, lambda p: p["l"]), "\n").alias("text")
    )


def rank_decisions(decisions: DataFrame, time_col: str = "attributed_ts") -> DataFrame:
    """Confidence descending, then time ascending."""
    return decisions.withColumn("time_s", F.coalesce(tx.timestamp_to_seconds(F.col(time_col)), F.lit(0.0))).orderBy(
        "meeting_id", F.desc("confidence"), "time_s", "item_id"
    )


def risk_order(priority) -> Column:
    p = F.coalesce(priority, F.lit("MEDIUM"))
    return F.when(p == "HIGH", 0).when(p == "MEDIUM-HIGH", 1).when(p == "LOW", 3).otherwise(2)


def rank_risks(risks: DataFrame) -> DataFrame:
    return risks.withColumn("priority_order", risk_order(F.col("priority"))).orderBy("meeting_id", "priority_order", "item_id")


def owner_bucket(owner) -> Column:
    return F.when(owner.isNull() | owner.isin(UNASSIGNED) | (owner == ""), "Unassigned").otherwise(owner)


def actions_by_owner(actions: DataFrame) -> DataFrame:
    """Actions numbered inside their owner's bucket; unclear owners share one bucket."""
    rows = actions.withColumn("owner_bucket", owner_bucket(F.col("owner")))
    return with_position(rows, ["meeting_id", "owner_bucket"], "item_id", "_p", block=None).withColumn("action_no", F.col("_p") + 1).drop("_p")


def _lines(df: DataFrame, section: int, group, number, lines: list[Column]) -> DataFrame:
    return df.select(
        "meeting_id", F.lit(section).alias("section"), group.alias("grp"), number.cast("long").alias("item_no"),
        F.posexplode(F.array_compact(F.array(*lines))).alias("line_no", "line"),
    )


def markdown_report(summaries: DataFrame, decisions: DataFrame, actions: DataFrame, risks: DataFrame) -> DataFrame:
    """(meeting_id, section, grp, item_no, line_no, line) — order by these columns to read it.

    Sections: 0 title and summary, 1 decisions, 2 actions by owner, 3 risks by priority.
    """
    none, zero = F.lit(""), F.lit(0)
    say = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))
    has = lambda df, c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    number = lambda: F.concat((F.col("_p") + 1).cast("string"), F.lit(". "))
    badge = F.concat(F.lit("   "), tx.confidence_badge(F.col("confidence")))
    title = lambda df, section, text: df.select("meeting_id").distinct().select(
        "meeting_id", F.lit(section).alias("section"), none.alias("grp"), zero.cast("long").alias("item_no"), zero.alias("line_no"), F.lit(text).alias("line"),
    )

    head = _lines(summaries, 0, none, zero, [F.lit("# Meeting Report"), F.lit("## Summary"), F.coalesce("summary", F.lit("No summary available."))])

    d = with_position(decisions, ["meeting_id"], "item_id", "_p", block=None)
    people = F.array_join(F.filter("participants", lambda p: p.isNotNull()), ", ")
    named = F.concat(F.lit("**"), has(d, "title"), F.lit("**: "))
    d = _lines(d, 1, none, F.col("_p") + 1, [
        F.concat(number(), F.coalesce(named, none), "text"),
        F.when((people != "") & (people != "Unclear"), F.concat(F.lit("   - Participants: "), people)),
        say("   - Rationale: ", has(d, "rationale")), badge,
    ])

    a = actions_by_owner(actions).withColumn("_p", F.col("action_no") - 1)
    # the unassigned bucket comes last
    group = F.when(F.col("owner_bucket") == "Unassigned", F.lit("~")).otherwise(F.col("owner_bucket"))
    owner_title = a.select("meeting_id", "owner_bucket", group.alias("grp")).distinct().select(
        "meeting_id", F.lit(2).alias("section"), "grp", zero.cast("long").alias("item_no"), zero.alias("line_no"),
        F.concat(F.lit("### "), "owner_bucket").alias("line"),
    )
    shown_priority = F.when(F.upper("priority") != "MEDIUM", F.upper("priority"))
    a = _lines(a, 2, group, F.col("_p") + 1, [
        F.concat(number(), F.lit("**"), "action", F.lit("**")), say("   - Due: ", F.col("due_date")),
        say("   - Priority: ", shown_priority), badge,
    ])

    # positions inside a priority, after all risks of higher ones (four rows a meeting)
    r = risks.withColumn("_o", risk_order(has(risks, "priority")))
    higher = Window.partitionBy("meeting_id").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    before = r.groupBy("meeting_id", "_o").count().select("meeting_id", "_o", F.coalesce(F.sum("count").over(higher), F.lit(0)).alias("_before"))
    r = with_position(r, ["meeting_id", "_o"], "item_id", "_p", block=None).join(before, ["meeting_id", "_o"])
    r = r.withColumn("_p", F.col("_p") + F.col("_before"))
    suffix = F.concat(F.lit(" ("), F.coalesce(has(r, "priority"), F.lit("MEDIUM")), F.lit(" PRIORITY)"))
    risk_title = has(r, "title")
    r = _lines(r, 3, none, F.col("_p") + 1, [
        F.concat(number(), F.coalesce(F.concat(F.lit("**"), risk_title, F.lit("**")), F.col("risk")), suffix),
        F.when(risk_title.isNotNull(), F.concat(F.lit("   - **Risk**: "), "risk")),
        say("   - **Impact**: ", has(r, "impact")),
        say("   - **Mitigation**: ", F.array_join(has(r, "mitigation", "array<string>"), "; ")),
        say("   - **Owner**: ", F.array_join(has(r, "owners", "array<string>"), ", ")),
        F.when(F.col("mentioned_by") != "Unknown", F.concat(F.lit("   - Mentioned by: "), "mentioned_by")), badge,
    ])
    parts = [title(decisions, 1, "## Decisions"), d, title(actions, 2, "## Action Items"), owner_title, a, title(risks, 3, "## Risks"), r]
    out = head
    for p in parts:
        out = out.unionByName(p)
    return out


def evaluation_report(components: DataFrame, criterion_scores: DataFrame, report: DataFrame, improvements: DataFrame) -> DataFrame:
    """Evaluation as ordered Markdown lines per job."""
    two = lambda c: tx.two_digits(F.col(c))

    def lines(df, section, grp, no, cols):
        return df.select("job_id", F.lit(section).alias("section"), grp.alias("grp"), no.cast("long").alias("item_no"),
                         F.posexplode(F.array_compact(F.array(*cols))).alias("line_no", "line"))

    none, zero = F.lit(""), F.lit(0)
    head = lines(report, 0, none, zero, [
        F.lit("# Evaluation Report"), F.concat(F.lit("**Job ID**: "), F.col("job_id").cast("string")),
        F.lit("## Overall Scores"), F.concat(F.lit("**Aggregate Score**: "), two("aggregate_score"), F.lit("/10")),
    ])
    comp = lines(components, 1, F.col("component"), zero, [
        F.concat(F.lit("#### "), tx.title_case(F.col("component"))), F.concat(F.lit("- Overall: "), two("overall_score"), F.lit("/10")),
    ])
    crit = lines(criterion_scores, 1, F.col("component"), F.lit(1), [F.concat(F.lit("- "), "criterion", F.lit(": "), two("score"), F.lit("/10"))])
    text = lines(report, 2, none, zero, [F.lit("## Improvement Recommendations"), F.col("summary")])
    todo = lines(improvements, 3, none, F.col("priority_no"), [
        F.concat(F.col("priority_no").cast("string"), F.lit(". **"), "component", F.lit(" - "), "criterion", F.lit("**")),
        F.concat(F.lit("   - Current Score: "), two("score"), F.lit("/10")),
        F.concat(F.lit("   - Recommendation: "), "recommendation"),
        F.when(F.col("details") != "", F.concat(F.lit("   - Details: "), "details")),
    ])
    out = head
    for p in (comp, crit, text, todo):
        out = out.unionByName(p)
    return out


def write_lines(lines: DataFrame, path: str, key: str = "meeting_id", folder_by: str | None = None) -> None:
    """Sorted text lines below `path`, one folder per key (or per coarser `folder_by` column)."""
    order = [c for c in (key, "section", "grp", "item_no", "line_no") if c in lines.columns]
    (
        lines.repartitionByRange(*order).sortWithinPartitions(*order)
        .select(folder_by or key, "line").write.mode("overwrite").partitionBy(folder_by or key).text(path)
    )


