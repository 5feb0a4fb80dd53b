"""URL filter: allow and block rules, then naive Bayes over words that a unigram Viterbi finds in hosts and paths.

Word counts come from the given texts (all rows) and from the urls' tokens, where a word counts once per host. A token is
no evidence for itself: while it is cut, its uses as a name (a whole label of the host) and as a path step of one host do not
count, so a concatenated name is split if its parts are known, however many pages it has. Every distinct token is cut at
each place into pieces of at most PREFIX letters, which meet the word counts by a join; longer words meet by their first
PREFIX letters. The best chain of pieces wins. A piece without a count costs more the longer it is, so unknown names stay
whole. The classifier is trained on the urls that a
rule decides: multinomial counts by class, add-one smoothed, joined to the tokens of all urls by word. No table is
broadcast by hand; hot words are a small table side that adaptive joins handle.

Defined cases: a null url or one without "://" has empty host and path, matches no rule and is judged by the class prior
alone; equal urls get equal verdicts; without any rule-decided url everything is allowed; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import materialize

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
PREFIX = 16
TOKEN = r"[a-z]+|[0-9]+"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, empty where there is no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def _viterbi(total: int):
    """Best chain of pieces of every token. A piece of n letters without a count has probability 10 / (total * 10**n)."""
    letter, unknown = math.log(10), math.log(10 / total)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known = {p: math.log(n / total) for p, n in zip(rows["piece"], rows["n"], strict=True) if n and len(p) > 1}
        sizes = sorted({len(p) for p in known}, reverse=True)
        token = rows["token"].iloc[0]
        best, start = [(0.0, 0)], (0.0, 0)  # start: where a piece without a count begins best, letters charged from the token's begin
        for end in range(1, len(token) + 1):
            top = (start[0] + unknown - end * letter, start[1])
            for size in sizes:
                cost = known.get(token[end - size:end]) if size <= end else None
                if cost is not None and best[end - size][0] + cost > top[0]:
                    top = (best[end - size][0] + cost, end - size)
            best.append(top)
            if top[0] + end * letter > start[0]:
                start = (top[0] + end * letter, end)
        out, end = [], len(token)
        while end:
            out.append(token[best[end][1]:end])
            end = best[end][1]
        return pd.DataFrame({"token": [token], "words": [out[::-1]]})

    return run


def segment(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, words) for distinct `tokens` of letters, by unigram counts (word, n, own); own is what n holds of a token's own uses."""
    total = max(11, counts.agg(F.sum("n")).first()[0] or 0)  # under 11, two pieces without a count would beat one
    pieces = tokens.select("token", F.explode(F.expr(
        f"flatten(transform(sequence(1, length(token)), i -> transform(sequence(1, least({PREFIX}, length(token) - i + 1)), k -> substr(token, i, k))))")).alias("piece")).distinct()
    n = F.when(F.col("word") == F.col("token"), F.col("n") - F.col("own")).otherwise(F.col("n")).alias("n")
    short, long = counts.filter(F.length("word") <= PREFIX), counts.filter(F.length("word") > PREFIX)
    held = pieces.join(short, F.col("piece") == F.col("word")).select("token", "piece", n)
    held = held.unionByName(pieces.filter(F.length("piece") == PREFIX).join(long, F.col("piece") == F.substring("word", 1, PREFIX))
                            .filter(F.col("token").contains(F.col("word"))).select("token", F.col("word").alias("piece"), n))
    held = held.unionByName(tokens.select("token", F.lit("").alias("piece"), F.lit(0).cast("bigint").alias("n")))
    return held.groupBy("token").applyInPandas(_viterbi(total), "token string, words array<string>")


def word_counts(rows: DataFrame, words_in: DataFrame) -> DataFrame:
    """(word, n, own): occurrences in texts plus hosts that use it in host or path; own: what of n is no evidence for the word itself.

    Evidence are texts, words set off inside a label or path step (casino-win), and whole path steps and last labels from the
    second host on. A whole label of a host before the last is a name.
    """
    labels = F.split("host", r"\.")
    named = F.transform(labels, lambda x, i: F.struct(x.alias("label"), (i < F.size(labels) - 1).alias("name")))
    steps = F.transform(F.split(F.lower("path"), "[/.]"), lambda x: F.struct(x.alias("label"), F.lit(False).alias("name")))
    used = rows.select("host", F.inline(F.concat(named, steps))).select("host", "label", "name", F.explode(F.regexp_extract_all("label", F.lit("([a-z]+)"), 1)).alias("word"))
    whole = F.col("word") == F.col("label")
    used = used.groupBy("host", "word").agg(F.max(~whole).alias("inside"), F.max(whole & F.col("name")).alias("name")).groupBy("word").agg(
        F.count("*").alias("n"), (F.count("*") - F.count_if("inside") - F.greatest(F.count_if(~F.col("inside") & ~F.col("name")) - 1, F.lit(0))).alias("own"))
    texts = words_in.groupBy("word").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("own"))
    return texts.unionByName(used).groupBy("word").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", texts: Column | None = None, rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, score (log-odds of block; null where a rule decides), words."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), (texts if texts is not None else F.lit(None)).cast("string").alias("texts"))
    words_in = rows.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("texts", F.lit(""))), F.lit(r"([a-z]{2,})"), 1)).alias("word"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules)).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows)
    spot = F.regexp_extract_all(F.concat_ws(" ", "host", F.lower("path")), F.lit(f"({TOKEN})"), 1)
    tokens = rows.select("row", F.col("hit.verdict").alias("class"), F.explode(spot).alias("token"))
    named = tokens.filter(F.col("token").rlike("^[a-z]"))
    counts = materialize(word_counts(rows, words_in))
    distinct = named.select("token").distinct()
    parts = segment(distinct, counts)
    by_token = parts.select("token", F.explode("words").alias("word"))
    digits = F.concat(F.lit("#"), F.least(F.length("token"), F.lit(9)).cast("string"))
    words = materialize(named.join(by_token, "token").select("row", "class", "word").unionByName(
        tokens.filter(~F.col("token").rlike("^[a-z]")).select("row", "class", digits.alias("word"))).groupBy("row", "class", "word").count())
    seen = words.filter("class is not null").groupBy("word").agg(
        F.sum(F.when(F.col("class") == "block", F.col("count")).otherwise(0)).alias("b"), F.sum(F.when(F.col("class") == "allow", F.col("count")).otherwise(0)).alias("a"))
    b, a, v = seen.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    prior = {r[0]: r[1] for r in rows.filter("hit is not null").groupBy("hit.verdict").count().collect()}
    odds = math.log((prior.get("block", 0) + 1) / (prior.get("allow", 0) + 1)) if prior else -1.0
    weights = seen.select("word", (F.log((F.col("b") + 1) / F.lit(b + v + 1.0)) - F.log((F.col("a") + 1) / F.lit(a + v + 1.0))).alias("w"))
    scored = words.filter("class is null").join(weights, "word", "left").groupBy("row").agg(
        F.sum(F.col("count") * F.coalesce("w", F.lit(0.0))).alias("s"), F.sort_array(F.collect_set("word")).alias("words"))
    found = rows.join(scored, "row", "left").withColumn("score", F.when(F.col("hit").isNull(), F.round(F.coalesce("s", F.lit(0.0)) + F.lit(odds), 9)))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score", "words")


def judge_pages(pages: DataFrame) -> DataFrame:
    """All pages, with the words of their titles as texts."""
    return judge(pages, texts=F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1), "&[#a-zA-Z0-9]+;", " "))
