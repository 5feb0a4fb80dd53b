"""Vector, text-similarity and whole-run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx
from colloquy.functions import vector as vx
from colloquy.operators import dedup as dd
from colloquy.operators import extraction as ex
from colloquy.operators import provenance as pv
from colloquy.operators import summaries as sm
from colloquy.operators import windows as wi
from colloquy.operators.ordering import near_window
from colloquy.plans import flow
from colloquy.plans.catalog import CTES, has, lit, register, strip, words
from colloquy.plans.queries_items import sql_boost, sql_keyword_conf

CTES["vecs"] = "SELECT label::BIGINT AS meeting_id, vec_id AS seg_id, embedding::DOUBLE[] AS vec FROM embeddings"
CTES["vpairs"] = "SELECT a.meeting_id, a.seg_id AS a, b.seg_id AS b, list_cosine_similarity(a.vec, b.vec) AS sim FROM vecs a JOIN vecs b ON a.meeting_id = b.meeting_id"


@register("cosine", "SELECT meeting_id, seg_id, round(list_cosine_similarity(vec, lead(vec) OVER (PARTITION BY meeting_id ORDER BY seg_id)), 5) AS similarity FROM vecs")
def _(t):
    n = near_window(t.vectors, ["meeting_id"], "seg_id", 1, {"nxt": lambda w: F.lead("vec").over(w)})
    return n.select("meeting_id", "seg_id", F.round(vx.cosine(F.col("vec"), F.col("nxt")), 5).alias("similarity"))


@register("link_provenance_vector", """SELECT meeting_id, item_id, rank, seg_id, round(sim, 5) AS similarity FROM (
  SELECT meeting_id, a AS item_id, b AS seg_id, sim, row_number() OVER (PARTITION BY meeting_id, a ORDER BY sim DESC, b) AS rank FROM vpairs WHERE sim > 0.3) x WHERE rank <= 3""")
def _(t):
    return pv.link_provenance_vector(t.vector_items, t.vectors).select("meeting_id", "item_id", "rank", "seg_id", F.round("similarity", 5).alias("similarity"))


@register("vector_support", """SELECT i.meeting_id + 1 AS meeting_id, i.seg_id AS item_id, round(greatest(coalesce(max(list_cosine_similarity(i.vec, v.vec)), 0), 0), 5) AS vector_support
FROM vecs i LEFT JOIN vecs v ON v.meeting_id = i.meeting_id + 1 GROUP BY 1, 2""")
def _(t):
    """The vectors of each label as items of the next one, against all its vectors."""
    items = t.vector_items.withColumn("meeting_id", F.col("meeting_id") + 1)
    v = pv.vector_support(items, t.vectors)
    return v.select("meeting_id", "item_id", F.round("vector_support", 5).alias("vector_support"))


CTES["vwin"] = """SELECT meeting_id, seg_id, v, len(v) AS n FROM (SELECT meeting_id, seg_id, list(vec) OVER (PARTITION BY meeting_id ORDER BY seg_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM vecs) x"""
_SUM = lambda a, b, c: f"list_transform(range(1, 65), lambda i: v[{a}][i] + v[{b}][i] + v[{c}][i])"


@register("topic_segments", f"""SELECT meeting_id, seg_id, sum(turn) OVER (PARTITION BY meeting_id ORDER BY seg_id)::BIGINT AS topic_id FROM (
  SELECT meeting_id, seg_id, CASE WHEN n = 4 AND list_cosine_similarity({_SUM(1, 2, 3)}, {_SUM(2, 3, 4)}) < 0.7 THEN 1 ELSE 0 END AS turn FROM vwin) x""")
def _(t):
    return wi.topic_segments(t.vectors, ["meeting_id"], "seg_id").select("meeting_id", "seg_id", "topic_id")


def _sentences_with_vectors(t):
    return t.vectors.join(t.read("documents").select(F.col("doc_id").alias("seg_id"), "text"), "seg_id")


@register("semantic_chunks")
def _(t):
    rows = _sentences_with_vectors(t)
    return wi.semantic_chunks(rows, ["meeting_id"], "seg_id", max_tokens=2000, min_tokens=600).select("meeting_id", "seg_id", "chunk_no")


CTES["centroids"] = """SELECT label, list(m ORDER BY d) AS centroid FROM (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings) a GROUP BY 1, 2) b GROUP BY 1"""


@register("intent_centroids", "SELECT label, round(list_sum(centroid), 4) AS total, round(centroid[1], 5) AS first_dim FROM centroids")
def _(t):
    c = sm.intent_centroids(t.read("embeddings"), "label", "embedding")
    return c.select(F.col("label").cast("long").alias("label"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.get("centroid", F.lit(0)), 5).alias("first_dim"))


@register("nearest_intents", """SELECT e.vec_id AS seg_id, coalesce(string_agg(CASE WHEN list_cosine_similarity(e.embedding::DOUBLE[], c.centroid) > 0.6 THEN c.label::VARCHAR END, '|' ORDER BY c.label), '') AS intents,
  round(max(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid)), 5) AS confidence FROM embeddings e, centroids c GROUP BY 1""")
def _(t):
    e = t.read("embeddings")
    near = sm.nearest_intents(t.vectors, sm.intent_centroids(e, "label", "embedding"))
    return near.select("seg_id", "intents", F.round("confidence", 5).alias("confidence"))


CTES["with_summary"] = f"""SELECT e.vec_id AS seg_id, d.text, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 9) AS sim FROM embeddings e JOIN centroids c ON c.label = e.label JOIN documents d ON d.doc_id = e.vec_id"""


@register("semantic_confidence", f"""SELECT seg_id, least(CASE WHEN sim > 0.7 THEN 0.9 WHEN sim > 0.5 THEN 0.7 WHEN sim > 0.3 THEN 0.5 ELSE 0.4 END::DOUBLE + {sql_boost('text')}, 0.95::DOUBLE) AS confidence FROM with_summary""")
def _(t):
    """The meeting's summary vector is the mean of its vectors."""
    c = sm.intent_centroids(t.vectors, "meeting_id", "vec").withColumnRenamed("label", "meeting_id")
    rows = _sentences_with_vectors(t).join(c, "meeting_id")
    sim = F.round(vx.cosine(F.col("vec"), F.col("centroid")), 9)
    return rows.select("seg_id", tx.semantic_confidence(sim, F.col("text")).alias("confidence"))


def _vector_rows(t):
    s = F.col("seg_id")
    return t.vectors.select(
        "meeting_id", s.alias("item_id"), "vec", (0.5 + (s % 5) / 10.0).alias("confidence"), F.array(F.concat(F.lit("p"), (s % 7).cast("string"))).alias("participants"),
        F.concat(F.lit("p"), (s % 3).cast("string")).alias("owner"), F.concat(F.lit("do "), s.cast("string")).alias("action"),
        F.when(s % 4 == 0, "high").when(s % 4 == 1, "low").otherwise("medium").alias("priority"), F.lit(None).cast("string").alias("due_date"),
    )


@register("near_duplicate_merge")
def _(t):
    m = dd.near_duplicate_merge(_vector_rows(t).select("meeting_id", "item_id", "vec", "confidence", "participants"), 0.8)
    return m.select("meeting_id", "leader", "item_id", "confidence", "participants", "merged_rows")


@register("merge_owner_actions")
def _(t):
    return dd.merge_owner_actions(_vector_rows(t), 0.75)


# ------------------------------------------------------------------ D23–D26
CTES["doc_pairs"] = r"SELECT doc_id, text AS source, string_split_regex(text, '[.!?]+\s+')[1] AS summary FROM documents"
_TERM = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


@register("summary_coverage", f"""
SELECT p.doc_id, token_overlap, coalesce(sim, 0) AS tfidf_similarity, (token_overlap + coalesce(sim, 0)) / 2 AS coverage_score FROM (
  SELECT doc_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0 END AS token_overlap FROM (
    SELECT doc_id, list_distinct({words('lower(source)')}) AS a, list_distinct({words('lower(summary)')}) AS b FROM doc_pairs) x) p
LEFT JOIN (SELECT doc_id, sum(s * m * w * w) / nullif(sqrt(sum(s * s * w * w)) * sqrt(sum(m * m * w * w)), 0) AS sim FROM (
  SELECT doc_id, t, sum(s) AS s, sum(m) AS m, ln(3.0 / (1 + (sum(s) > 0)::INT + (sum(m) > 0)::INT)) + 1 AS w FROM (
    SELECT doc_id, unnest({_TERM.format('source')}) AS t, 1 AS s, 0 AS m FROM doc_pairs UNION ALL SELECT doc_id, unnest({_TERM.format('summary')}), 0, 1 FROM doc_pairs) y GROUP BY 1, 2) z GROUP BY 1) q ON q.doc_id = p.doc_id""")
def _(t):
    return sm.summary_coverage(t.pairs, "doc_id")


_TOK = r"list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"


def rouge_sql(n, key="doc_id", base="documents", toks="toks"):
    gram = lambda c: f"list_transform(range(1, greatest(len({c}) - {n - 1}, 0) + 1), lambda i: array_to_string({c}[i:i+{n - 1}], ' '))"
    return f"""
SELECT {key}, p AS rouge_{n}_p, r AS rouge_{n}_r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS rouge_{n}_f FROM (
 SELECT d.{key}, coalesce(m / nullif(np, 0)::DOUBLE, 0) AS p, coalesce(m / nullif(nr, 0)::DOUBLE, 0) AS r FROM {base} d LEFT JOIN (
  SELECT {key}, sum(least(p, r)) AS m, sum(p) AS np, sum(r) AS nr FROM (SELECT {key}, g, sum(p) AS p, sum(r) AS r FROM (
    SELECT {key}, unnest({gram('b')}) AS g, 1 AS p, 0 AS r FROM {toks} UNION ALL SELECT {key}, unnest({gram('a')}), 0, 1 FROM {toks}) x GROUP BY 1, 2) y GROUP BY 1) z ON z.{key} = d.{key}) q"""


CTES["toks"] = f"SELECT doc_id, {_TOK.format('source')} AS a, {_TOK.format('summary')} AS b FROM doc_pairs"


@register("rouge_1", rouge_sql(1))
def _(t):
    return sm.rouge_n(t.pairs, "doc_id", 1)


@register("rouge_2", rouge_sql(2))
def _(t):
    return sm.rouge_n(t.pairs, "doc_id", 2)


CTES["doc_steps"] = "SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS w FROM toks WHERE len(b) > 0"
CTES["doc_places"] = "SELECT doc_id, unnest(range(1, len(b) + 1)) AS j, unnest(b) AS u FROM toks"
#: Longest common subsequences, one step a word of the source, over a row a summary.
CTES["doc_lcs"] = """
SELECT doc_id, 0::BIGINT AS i, j, u, 0::BIGINT AS v FROM doc_places UNION ALL
SELECT doc_id, i, j, u, max(c) OVER (PARTITION BY doc_id ORDER BY j) AS v FROM (
  SELECT l.doc_id, s.i, l.j, l.u, greatest(l.v, CASE WHEN l.u = s.w THEN coalesce(lag(l.v) OVER (PARTITION BY l.doc_id ORDER BY l.j), 0) + 1 ELSE 0 END) AS c
  FROM doc_lcs l JOIN doc_steps s ON s.doc_id = l.doc_id AND s.i = l.i + 1) x"""


@register("rouge_l", """
SELECT doc_id, p AS rouge_l_p, r AS rouge_l_r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS rouge_l_f FROM (
 SELECT t.doc_id, coalesce(m / nullif(len(b), 0)::DOUBLE, 0) AS p, coalesce(m / nullif(len(a), 0)::DOUBLE, 0) AS r FROM toks t
 LEFT JOIN (SELECT doc_id, max(v) AS m FROM doc_lcs GROUP BY 1) l ON l.doc_id = t.doc_id) x""")
def _(t):
    return sm.rouge_l(t.pairs, "doc_id")


@register("summary_statistics", f"SELECT doc_id, length(summary) AS length_chars, len({words('summary')}) AS length_words, length(summary) / nullif(length(source), 0)::DOUBLE AS compression_ratio FROM doc_pairs")
def _(t):
    return sm.summary_statistics(t.pairs, "doc_id")


# ------------------------------------------------------------------ J3
def summary_ctes(prefix: str, chunk_words: int) -> str:
    """Registers the pieces of an extractive summary with chunks of so many words; returns the SQL of (meeting_id, summary)."""
    CTES[f"{prefix}_sent"] = rf"""
SELECT meeting_id, chunk, seg_id, i - 1 AS sent_id, {strip('p[i]')} AS sentence FROM (
  SELECT meeting_id, seg_id, CAST(floor((sum(len({words('text')})) OVER (PARTITION BY meeting_id ORDER BY seg_id) - len({words('text')})) / {chunk_words}) AS BIGINT) AS chunk, string_split_regex(text, '[.!?]+\s+') AS p FROM seg) s,
  LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) u WHERE {strip('p[i]')} <> ''"""
    CTES[f"{prefix}_tf"] = f"SELECT meeting_id, chunk, seg_id, sent_id, t, count(*) AS tf FROM (SELECT *, unnest({_TERM.format('sentence')}) AS t FROM {prefix}_sent) x GROUP BY ALL"
    return f"""
SELECT meeting_id, string_agg(sentence, '. ' ORDER BY seg_id, sent_id) AS summary FROM (
 SELECT x.*, row_number() OVER (PARTITION BY meeting_id ORDER BY score DESC, seg_id, sent_id) AS k FROM (
  SELECT c.meeting_id, c.chunk, c.seg_id, c.sent_id, s.sentence, c.score, row_number() OVER (PARTITION BY c.meeting_id, c.chunk ORDER BY c.score DESC, c.seg_id, c.sent_id) AS rn FROM (
   SELECT f.meeting_id, f.chunk, f.seg_id, f.sent_id, round(avg(f.tf * ln(1 + n.n / d.df::DOUBLE)), 9) AS score FROM {prefix}_tf f
   JOIN (SELECT meeting_id, chunk, t, count(*) AS df FROM {prefix}_tf GROUP BY ALL) d ON d.meeting_id = f.meeting_id AND d.chunk = f.chunk AND d.t = f.t
   JOIN (SELECT meeting_id, chunk, count(*) AS n FROM {prefix}_sent GROUP BY ALL) n ON n.meeting_id = f.meeting_id AND n.chunk = f.chunk GROUP BY 1, 2, 3, 4) c
  JOIN {prefix}_sent s ON s.meeting_id = c.meeting_id AND s.chunk = c.chunk AND s.seg_id = c.seg_id AND s.sent_id = c.sent_id) x WHERE rn <= 2) y WHERE k <= 3 GROUP BY 1"""


@register("extractive_summary", summary_ctes("sum", 60))
def _(t):
    return sm.extractive_summary(t.segments, k=3, per_chunk=2, chunk_words=60)


# ------------------------------------------------------------------ L3
@register("extract_all")
def _(t):
    return flow.extract_all(t.segments).meetings
