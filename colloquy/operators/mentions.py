"""Date and entity mentions with character offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import temporal as tp
from colloquy.functions import text as tx

_SPAN = "array<struct<start: int, end: int, text: string, label: string, context: string, part: string, confidence: double>>"


def _find_spans(patterns):
    """Arrow-batched offsets: Spark has no expression that returns match positions."""
    compiled = [(re.compile(p, re.IGNORECASE if ci else 0), label, context, group, conf) for label, context, p, ci, group, conf in patterns]

    @F.pandas_udf(_SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        def one(s):
            out = []
            for rx, label, context, group, conf in compiled:
                for m in rx.finditer(s or ""):
                    part = m.group(1) if rx.groups else None
                    out.append({"start": m.start(group), "end": m.end(group), "text": m.group(group), "label": label,
                                "context": context, "part": part, "confidence": conf})
            return out

        return texts.map(one)

    return spans


def resolve_span_overlaps(spans: Column) -> Column:
    """Fold over spans sorted by start: a later span replaces the ones it overlaps only if it
    is more confident than each of them, otherwise it is dropped."""
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["no"] - b["no"]),
    )

    def add(kept, s):
        clash = F.filter(kept, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"]))
        wins = F.forall(clash, lambda k: s["confidence"] > k["confidence"])
        rest = F.filter(kept, lambda k: ~((s["start"] < k["end"]) & (s["end"] > k["start"])))
        return F.when(wins, F.concat(rest, F.array(s))).otherwise(kept)

    return F.aggregate(ordered, F.slice(ordered, 1, 0), add)


def _numbered(spans, value) -> Column:
    return F.transform(spans, lambda s, i: value(s, i))


def temporal_mentions(segments: DataFrame, ref: Column) -> DataFrame:
    """Dates, relative dates, deadlines, durations and frequencies, overlaps resolved.

    ref is the reference timestamp of a row (a column or literal).
    """
    found = _find_spans(
        [(kind, context, p, True, 0, 0.8) for context, kind, p in rules.TEMPORAL_MENTIONS]
    )
    clock = r"^(\d{1,2}):(\d{2})\s*(am|pm)?"

    def parsed(s):
        t = s["text"]
        low = F.lower(F.trim(t))
        hour = F.regexp_extract(low, clock, 1).try_cast("int")
        pm = F.regexp_extract(low, clock, 3)
        at = F.date_trunc("day", F.col("_ref")) + F.make_interval(
            F.lit(0), F.lit(0), F.lit(0), F.lit(0),
            F.when((pm == "pm") & (hour < 12), hour + 12).when((pm == "am") & (hour == 12), 0).otherwise(hour),
            F.regexp_extract(low, clock, 2).try_cast("int"),
        )
        word = F.upper(F.trim(t)).isin("EOD", "COB", "ASAP")
        return (
            F.when(s["label"].isin("duration", "frequency"), F.lit(None).cast("timestamp"))
            .when(s["label"] == "relative_date", tp.resolve_relative_date(t, F.col("_ref")))
            .when((s["label"] == "deadline") & word, tp.resolve_relative_date(t, F.col("_ref")))
            .when(s["label"] == "deadline", tp.parse_date(s["part"], F.col("_ref")))
            .otherwise(F.coalesce(at, tp.parse_date(t, F.col("_ref"))))
        )

    def scored(s, i):
        date = parsed(s)
        ok = date.isNotNull()
        conf = (
            F.when(s["label"] == "date", F.when(ok, 0.9).otherwise(0.5))
            .when(s["label"] == "relative_date", F.when(ok, 0.8).otherwise(0.6))
            .when(s["label"] == "deadline", F.when(ok, 0.9).otherwise(0.7))
            .otherwise(0.8)
        )
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("type"),
            date.alias("parsed"), conf.alias("confidence"), s["context"].alias("context"), i.alias("no"),
        )

    rows = segments.withColumn("_ref", ref).withColumn("_spans", found("text")).filter(F.size("_spans") > 0)
    kept = rows.withColumn("_spans", _numbered("_spans", scored)).withColumn("_spans", resolve_span_overlaps(F.col("_spans")))
    return kept.select("meeting_id", "seg_id", F.explode("_spans").alias("m")).select("meeting_id", "seg_id", "m.*").drop("no")


def entity_mentions(segments: DataFrame) -> DataFrame:
    """Persons, dates, times, deadlines, money, projects, companies and people with a role."""
    found = _find_spans([(label, "", p, ci, group, conf) for label, p, ci, group, conf in rules.ENTITY_MENTIONS])
    shaped = lambda s, i: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("label"),
        s["confidence"].alias("confidence"), i.alias("no"),
    )
    rows = segments.withColumn("_spans", found("text")).filter(F.size("_spans") > 0)
    kept = rows.withColumn("_spans", resolve_span_overlaps(_numbered("_spans", shaped)))
    return kept.select("meeting_id", "seg_id", F.explode("_spans").alias("m")).select("meeting_id", "seg_id", "m.*").drop("no")


def action_deadlines(segments: DataFrame, ref: Column) -> DataFrame:
    """(action, deadline text, deadline date) for every match of the deadline patterns."""

    def matches(no, pattern):
        a, d = tx.extract_all(F.col("text"), pattern, 1), tx.extract_all(F.col("text"), pattern, 2)
        return F.transform(
            F.arrays_zip(a.alias("a"), d.alias("d")),
            lambda z, i: F.struct(
                F.lit(no).alias("pattern_no"), i.alias("match_no"), tx.strip(z["a"]).alias("action"), tx.strip(z["d"]).alias("deadline_text")
            ),
        )

    found = [matches(no, p) for no, p in enumerate(rules.ACTION_DEADLINES)]
    rows = segments.select("meeting_id", "seg_id", ref.alias("_ref"), F.explode(F.concat(*found)).alias("m"))
    dated = rows.select("meeting_id", "seg_id", "_ref", "m.*").withColumn("deadline_date", tp.parse_date(F.col("deadline_text"), F.col("_ref")))
    return dated.drop("_ref").withColumn("confidence", F.when(F.col("deadline_date").isNotNull(), 0.8).otherwise(0.6))
