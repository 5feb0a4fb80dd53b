"""Registered queries: a Spark plan over the given tables and, where possible, the same result as SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions import vector as vx
from colloquy.operators import dedup as dd
from colloquy.operators import evaluation as ev
from colloquy.operators import extraction as ex
from colloquy.operators import provenance as pv
from colloquy.operators import summaries as sm
from colloquy.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

CRITERIA = ["coverage", "factuality", "clarity", "specificity", "completeness", "owner", "timeline", "priority", "impact", "likelihood"]
SEGMENTS_SQL = """
SELECT conv_id AS meeting_id, turn AS seg_id,
  CASE (conv_id*7+CAST(FLOOR(turn/2) AS BIGINT)) % 6 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bob Stone' WHEN 2 THEN 'Bob Stone (PM)'
       WHEN 3 THEN 'Cy Diaz' WHEN 4 THEN 'next steps' ELSE NULL END AS speaker,
  concat(CAST(FLOOR(turn/3) AS BIGINT), ':', lpad(CAST((turn*20) % 60 AS VARCHAR(2)), 2, '0')) AS ts_raw,
  CAST(turn*20 AS DOUBLE) AS start_s,
  CASE (conv_id*5+turn*4) % 16
    WHEN 0 THEN concat('We decided to move lot ', conv_id, ' from October 15 to October 29 because testing is late.')
    WHEN 1 THEN concat('Bob will review order ', turn, ' by Friday.')
    WHEN 2 THEN 'There is a risk that the security audit is delayed by two weeks.'
    WHEN 3 THEN 'yeah'
    WHEN 4 THEN concat('um I will send report ', conv_id, ' by next week. Sounds sounds good.')
    WHEN 5 THEN 'hello team'
    WHEN 6 THEN 'Ann, can you finalize the budget of $45,000 by end of day tomorrow?'
    WHEN 7 THEN 'Let''s focus on the core features and cut the custom branding.'
    WHEN 8 THEN 'The deadline is 2025-04-01, so we must escalate within 3 weeks.'
    WHEN 9 THEN 'Update the plan and send the notes and schedule the review.'
    WHEN 10 THEN 'This is urgent. If we can''t hire, the launch could fail.'
    WHEN 11 THEN 'We agreed that they will own it, yes, but no firm date...'
    ELSE text END AS text
FROM conversations
"""


class Tables:
    """The given tables and the engine inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def segments(self) -> DataFrame:
        expr = SEGMENTS_SQL.replace("VARCHAR(2)", "STRING").replace("''", "\\'")
        c = self.read("conversations")
        return self.spark.sql(expr.replace("FROM conversations", "FROM {c}"), c=c)

    @cached_property
    def decisions(self) -> DataFrame:
        return ex.extract_decisions(self.segments)

    @cached_property
    def actions(self) -> DataFrame:
        return ex.extract_actions(self.segments)

    @cached_property
    def risks(self) -> DataFrame:
        return ex.extract_risks(self.segments)

    @cached_property
    def items(self) -> DataFrame:
        return materialize(dd.union_items(self.decisions, self.actions, self.risks))

    @cached_property
    def provenance(self) -> DataFrame:
        return pv.link_provenance_lexical(self.items, self.segments)

    @cached_property
    def summaries(self) -> DataFrame:
        """One extractive summary of all its segments per meeting, empty where no sentence is left."""
        found = self.segments.select("meeting_id").distinct().join(sm.extractive_summary(self.segments), "meeting_id", "left")
        return materialize(found.na.fill("", ["summary"]))

    @cached_property
    def pairs(self) -> DataFrame:
        """Documents as source with their first sentence as summary."""
        return self.read("documents").select("doc_id", F.col("text").alias("source"), F.get(tx.sentence_list(F.col("text")), F.lit(0)).alias("summary"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("label").cast("long").alias("meeting_id"), F.col("vec_id").alias("seg_id"), F.col("embedding").alias("vec"))

    @cached_property
    def vector_items(self) -> DataFrame:
        """All vectors as items of kind note."""
        return self.vectors.select("meeting_id", F.lit("note").alias("kind"), F.col("seg_id").alias("item_id"), "vec")

    @cached_property
    def status_log(self) -> DataFrame:
        e = self.read("events")
        status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing")
        return e.select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"), "value")

    @cached_property
    def eval_schema(self) -> DataFrame:
        return ev.default_eval_schema(self.spark)

    @cached_property
    def eval_scores(self) -> DataFrame:
        """Score of every source and criterion for every labelled document."""
        cells = ", ".join(
            f"named_struct('source', '{s}', 'sn', {sn}, 'component', '{c}', 'criterion', '{k}', 'cn', {i})"
            for sn, s in enumerate(ev.SOURCES) for i, (c, k, _) in enumerate(ev.rules.EVAL_SCHEMA)
        )
        j = self.read("labels").selectExpr("doc_id AS job_id", f"inline(array({cells}))")
        score = ((F.col("job_id") * 7 + F.col("cn") * 3 + F.col("sn") * 5) % 11).cast("double")
        why = F.when((F.col("job_id") + F.col("cn") + F.col("sn")) % 3 == 0, F.concat(F.lit("note "), F.col("cn").cast("string"))).otherwise("")
        # some jobs have no human review
        return j.withColumn("score", score).withColumn("explanation", why).filter("not (source = 'human' and job_id % 3 = 0)").drop("sn", "cn")

    @cached_property
    def criterion_scores(self) -> DataFrame:
        return materialize(ev.weighted_criterion_scores(self.eval_scores))

    @cached_property
    def components(self) -> DataFrame:
        return ev.component_scores(self.criterion_scores, self.eval_schema)

    @cached_property
    def reviews(self) -> DataFrame:
        """Two reviews per labelled document, one of them on a component shared by both."""
        lab = self.read("labels")
        n = F.explode(F.array(F.lit(0), F.lit(1))).alias("n")
        r = lab.select("doc_id", "quality", "toxic", n)
        q = (F.col("quality") * 10).cast("double")
        component = F.when(F.col("doc_id") % 2 == 0, "summary").when(F.col("n") == 0, "decisions").otherwise("risks")
        first = F.when(component == "summary", "coverage").when(component == "decisions", "specificity").otherwise("impact")
        return r.select(
            F.col("doc_id").alias("job_id"), component.alias("component"), F.concat(F.lit("r"), F.col("n").cast("string")).alias("reviewer_id"),
            F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 60 + F.col("n")).alias("ts"),
            F.create_map(first, q, F.lit("clarity"), q - F.col("n") + 1.0).alias("scores"),
            F.create_map(first, F.concat(F.lit("seen by r"), F.col("n").cast("string"))).alias("explanations"),
            (F.col("toxic") == 1).alias("mark_for_retraining"),
        )

    @cached_property
    def gold(self) -> DataFrame:
        """Gold rows: all extracted items, without their first three characters, with a word before them, or reversed."""
        i = self.items
        cut = F.when(F.col("seg_id") % 2 == 1, F.reverse("text")).when(F.col("seg_id") % 4 == 0, F.substr("text", F.lit(4))).otherwise(F.concat(F.lit("note: "), "text"))
        return i.select("meeting_id", "kind", F.col("item_id").alias("gold_id"), cut.alias("text"))


# --------------------------------------------------------------------------- SQL pieces
def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def has(c: str, terms) -> str:
    return f"regexp_matches(lower({c}), {lit(tx.alternation(terms))})"


def ext(c: str, p: str, g: int = 1) -> str:
    return f"nullif(regexp_extract({c}, {lit(p)}, {g}), '')"


def first_ext(c: str, ps) -> str:
    return "coalesce(" + ", ".join(ext(c, *((p, 1) if isinstance(p, str) else p)) for p in ps) + ")"


def matches(c: str, p: str) -> str:
    return f"regexp_matches({c}, {lit(p)})"


def any_match(c: str, ps) -> str:
    return "(" + " OR ".join(matches(c, p) for p in ps) + ")"


def all_of(c: str, p: str, g: int = 0) -> str:
    return f"regexp_extract_all({c}, {lit(p)}, {g})"


def title_case(c: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({c}, '\p{{L}}+|\P{{L}}+'), "
        "lambda r: upper(r[1:1]) || lower(r[2:])), '')"
    )


def cases(c: str, categories: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(c, t)} THEN {lit(k)}" for k, t in categories.items()) + f" ELSE {lit(default)} END"


def with_ctes(body: str) -> str:
    """Prefix the named pieces that the body (and they themselves) use."""
    need: list[str] = []
    open_: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", sql):
                if name not in open_:
                    open_.add(name)  # a recursive piece names itself
                    visit(CTES[name])
                    need.append(name)

    visit(body)
    if not need:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in need) + "\n" + body


CTES["seg"] = SEGMENTS_SQL


def register(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _plain(fn(Tables(spark, folder)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _plain(df: DataFrame) -> DataFrame:
    """Simple column types: integers as long, floats as double, arrays of text joined with |."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "float" or kind.startswith("decimal"):
            c = c.cast("double")
        elif kind.startswith("array<"):
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def oracle_sql() -> dict[str, str]:
    return {k: with_ctes(v) for k, v in ORACLES.items()}
