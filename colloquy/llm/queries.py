"""Registered queries of the operators, each over its whole table, and SQL equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (collocations, decontamination, html_extract, jaccard_join, language_id, license_scan, minhash_join, packing, periodic_runs,
                          quality_rules, substring_dedup, token_counts, url_filter)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents")).drop("ids")


def op2_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.maintain(_table(spark, folder, "documents"), _table(spark, folder, "labels").filter("toxic = 1"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify_documents(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def pages_language(spark: SparkSession, folder: str) -> DataFrame:
    """The operator of op4 over pages, where declarations, address suffixes and hosts exist."""
    return language_id.identify_pages(_table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.expr("aggregate(removed, 0L, (a, x) -> a + x.count)").alias("n_removed"),
                        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_pages(_table(spark, folder, "pages"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.link_components(_table(spark, folder, "documents"), size=3, threshold=(9, 10))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(_table(spark, folder, "pages"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_repeats(_table(spark, folder, "documents")))
    return periodic_runs.digests(found).withColumnRenamed("id", "doc_id")


def op12_minhash_join(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash_join.near_duplicates(_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull()).alias("kept"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_token_rollup, op3_license_scan, op4_language, op5_substring_dedup, op6_url_filter, op7_jaccard_join,
                                   op8_html_extract, op9_decontaminate, op10_quality, op11_periodic_runs, op12_minhash_join, op13_collocations, pages_language)}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

def _jaccard_sql(size: int, percent: int, more: str = "") -> str:
    """Components of documents whose sets of `size`-word shingles are similar by `percent` or more."""
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {size - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {size - 2}))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.y) AS component_id{more}
        FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = w.doc_id GROUP BY 1, 2"""


ORACLES = {
    "op5_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
        firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        cut AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN firsts USING (k) WHERE m < doc_id)),
        gone AS (SELECT doc_id, list(j) AS js FROM cut GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, p: NOT list_contains(js, p)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)""",
    "op7_jaccard_join": _jaccard_sql(3, 90),
    "op12_minhash_join": _jaccard_sql(5, 85, ", w.doc_id = min(reach.y) AS kept"),
    "op8_html_extract": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>', chr(1), 'g') AS t FROM pages),
        b AS (SELECT page_id, url, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(
            replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
            '[ \t\n\r\f\v]+', ' ', 'g'), ' ')), lambda x: x <> '') AS bs FROM a)
        SELECT page_id, url, array_to_string(bs, chr(10)) AS text, length(array_to_string(bs, chr(10)))::BIGINT AS n_chars FROM b""",
    "op11_periodic_runs": rf"""
        WITH crc AS (
            SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) AS h FROM documents),
        split AS (SELECT doc_id, h, h // 10 AS g, {WORDS.format("coalesce(text, '')")} AS ws FROM documents JOIN crc USING (doc_id)),
        shape AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, g % greatest(len(ws), 1) AS a,
                  1 + (len(ws) - g % greatest(len(ws), 1)) // (3 + g % 8) AS p FROM split),
        w AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE ws END AS ws FROM shape),
        win AS (SELECT doc_id, n, i, array_to_string(ws[i + 1:i + 5], ' ') AS k FROM (SELECT doc_id, n, ws, unnest(range(0, n - 4)) AS i FROM w WHERE n >= 6)),
        met AS (SELECT x.doc_id, x.i, x.i - y.i AS d FROM win x JOIN win y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
        isle AS (SELECT doc_id, d, i, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS z FROM met),
        stretch AS (SELECT doc_id, d, min(i) - d AS start, count(*) + 4 + d AS length FROM isle GROUP BY doc_id, d, z),
        runs AS (SELECT doc_id, start, length, min(d) AS period FROM stretch WHERE length >= greatest(6, 4 * d) GROUP BY ALL),
        cut AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS j FROM runs),
        gone AS (SELECT doc_id, list(j) AS js FROM cut GROUP BY doc_id),
        best AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS b,
                 string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
               (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
               sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, p: NOT list_contains(js, p - 1)) END, ' ')) AS collapsed_sha256
        FROM w LEFT JOIN best USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    "op13_collocations": r"""
        WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
        w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM piece),
        total AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
        gram AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, unnest(range(1, 6)) AS k FROM w WHERE len(ws) > 0)),
        f AS (SELECT lang, ws[i:i + k - 1] AS p, k, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= 100),
        cuts AS (SELECT c.lang, c.p, c.a, x.a AS l, y.a AS r, x.k AS cut, (1000 * c.a::HUGEINT * n) // (x.a::HUGEINT * y.a) AS score
                 FROM f c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.p = c.p[1:x.k] JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.p = c.p[x.k + 1:c.k]
                 JOIN total ON total.lang = c.lang WHERE c.k > 1),
        low AS (SELECT lang, p, a, first(struct_pack(l, r, score) ORDER BY score, cut) AS b FROM cuts GROUP BY lang, p, a),
        inside AS (SELECT lang, p, max(a) AS longer FROM (SELECT lang, unnest([p[1:k - 1], p[2:k]]) AS p, a FROM f WHERE k > 2) GROUP BY lang, p),
        kept AS (SELECT low.lang, array_to_string(low.p, ' ') AS phrase, a, b FROM low LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR longer < a),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, b.score AS score FROM kept)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
