"""Language identification by Bayesian fusion of text, declaration, address suffix and host.

Text likelihood: hashed byte trigrams, counted over all documents by declared language, add-half smoothed. All declared
languages have a model; the model tables go over the texts in blocks of BLOCK languages, one after the other. Every document's
log-likelihoods are tempered, since trigrams overlap. Then grouped aggregation of the text decisions gives, for all hosts,
suffixes and declarations: P(declared | language), P(suffix | language), and a host prior smoothed towards the prior of
its suffix, which is smoothed towards the whole corpus. The posterior is the normalised product; missing evidence is neutral.

Rejected (kept = false): text without a letter, text that fits no language better than random bytes do, and posteriors
under `least`. Null, empty and blank texts are rejected with language null. Equal rows get equal answers; null ids are
kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import LOWER, SPACE, binary_list, chunks, shed, sliced
from colloquy.session import materialize

SLOTS = 1 << 16
TEMPER = 0.25
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0
BLOCK = 256
LETTER = np.zeros(256, bool)
LETTER[[*range(0x61, 0x7B), *range(0xC3, 0xF5)]] = True


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of the trigram at every byte, first byte of every text, and the lower-cased bytes; white space counts as a blank."""
    data = LOWER[np.frombuffer(b"\n".join([b"\n" + t for t in texts]) + b"\n\n\n", np.uint8)]
    data = np.where(SPACE[data], np.uint8(32), data)
    x = data.astype(np.uint32)
    slot = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(16)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    return slot, np.cumsum(size) - size, data


def _count(batches):
    """Trigram counts of each declared language of a batch."""
    shed()
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for text, lang in zip(binary_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            if text and lang is not None:
                by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            total = np.zeros(SLOTS, np.int64)
            for lo, hi in chunks(texts):
                total += np.bincount(trigrams(texts[lo:hi])[0], minlength=SLOTS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])],
                                             names=["lang", "slot", "n"])


def fit(rows: DataFrame) -> tuple[list[str], DataFrame]:
    """All declared languages, and their trigram counts (lang, slot, n) from all rows (text, declared)."""
    langs = sorted(r[0] for r in rows.filter("declared is not null and text is not null").select("declared").distinct().collect())
    counts = rows.select("text", "declared").mapInArrow(_count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    return langs, counts if len(langs) <= BLOCK else materialize(counts)


def model_of(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-probabilities of one block of sorted languages, SLOTS x languages."""
    table = np.full((SLOTS, len(langs)), 0.5)
    found = counts.filter(F.col("lang").isin(langs)).toPandas()
    if len(found):
        table[found["slot"].to_numpy(), np.searchsorted(langs, found["lang"].to_numpy().astype(str))] += found["n"].to_numpy()
    return np.log(table / table.sum(0, keepdims=True)).astype(np.float32)


def _likelihoods(model: np.ndarray, names: list[str]):
    """Columns `names`, the log-likelihoods of the model's languages, and whether one of them fits."""

    def run(batches):
        shed()
        for batch in sliced(batches):
            texts = [t or b"" for t in binary_list(batch.column(batch.schema.get_field_index("text")))]
            parts, letters, sizes = [], [], []
            for lo, hi in chunks(texts, 1 << 19):
                slot, begin, data = trigrams(texts[lo:hi])
                parts.append(np.add.reduceat(model[slot], begin, axis=0, dtype=np.float64))
                letters.append(np.add.reduceat(LETTER[data].astype(np.int64), begin))
                sizes.append(np.diff(np.append(begin, len(slot))))
            fit_ = np.concatenate(parts) if parts else np.zeros((0, model.shape[1]))
            size = np.concatenate(sizes) if sizes else np.zeros(0)
            letter = np.concatenate(letters) > 0 if letters else np.zeros(0, bool)
            known = letter & (fit_.max(1, initial=-np.inf) > -np.log(SLOTS) * size)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names],
                                              pa.array((TEMPER * fit_).tolist(), pa.list_(pa.float64())), pa.array(known)],
                                             names=[*names, "more_ll", "more_known"])

    return run


def identify(rows: DataFrame, id_col: str, text: Column, declared: Column, suffix: Column, host: Column, least: float = 0.5) -> DataFrame:
    """id, declared, text_lang (text alone), lang (all evidence), confidence, kept."""
    rows = rows.select(F.col(id_col).alias("id"), text.cast("string").alias("text"), declared.cast("string").alias("declared"),
                       suffix.cast("string").alias("suffix"), host.cast("string").alias("host"))
    langs, counts = fit(rows)
    kind = rows.schema["id"].dataType.simpleString()
    if not langs:
        return rows.select("id", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"),
                           F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    base = {"id": kind, "declared": "string", "suffix": "string", "host": "string"}
    scored = rows
    for i in range(0, len(langs), BLOCK):
        keep = base | ({"text": "string"} if i + BLOCK < len(langs) else {}) | ({"text_ll": "array<double>", "known": "boolean"} if i else {})
        schema = ", ".join(f"{c} {k}" for c, k in (keep | {"more_ll": "array<double>", "more_known": "boolean"}).items())
        scored = scored.mapInArrow(_likelihoods(model_of(counts, langs[i:i + BLOCK]), list(keep)), schema)
        if i:
            scored = scored.withColumn("text_ll", F.concat("text_ll", "more_ll")).withColumn("known", F.col("known") | F.col("more_known")).drop("more_ll", "more_known")
        else:
            scored = scored.withColumnsRenamed({"more_ll": "text_ll", "more_known": "known"})
        if i + BLOCK < len(langs):  # one table in memory at a time
            scored = materialize(scored)
    names = F.array(*[F.lit(x) for x in langs])
    best = F.when(F.col("known"), F.array_position("text_ll", F.array_max("text_ll")).cast("int"))
    scored = materialize(scored.withColumn("vote", best))
    votes = materialize(scored.filter("vote is not null").groupBy("declared", "suffix", "host", "vote").count())

    def tally(*by: str) -> DataFrame:
        n = votes.groupBy(*by, "vote").agg(F.sum("count").cast("double").alias("n")).groupBy(*by).agg(
            F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("n"))
        return n.withColumn("n", F.expr(f"transform(sequence(1, {len(langs)}), i -> coalesce(try_element_at(n, i), 0D))"))

    total = tally().withColumn("n", F.coalesce("n", F.array(*[F.lit(0.0)] * len(langs)))).first()[0]
    whole = F.array(*[F.lit((x or 0.0) + 1.0) for x in total])
    share = F.transform(whole, lambda x: x / F.lit(sum((v or 0.0) + 1.0 for v in total)))
    mass = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    given = lambda c: F.transform(F.zip_with(c, whole, lambda n, w: (n + 0.5) / (w + 1.0)), lambda p: F.log(p))
    by_declared = tally("declared").filter("declared is not null").select("declared", given(F.col("n")).alias("ll_declared"))
    by_suffix = tally("suffix").filter("suffix is not null").select(
        "suffix", given(F.col("n")).alias("ll_suffix"),
        F.zip_with("n", share, lambda n, g: n + F.lit(SUFFIX_WEIGHT) * g).alias("up")).withColumn("up", F.transform("up", lambda x: x / mass(F.col("up"))))
    by_host = tally("suffix", "host").filter("host is not null").withColumnRenamed("suffix", "s").join(
        by_suffix.select(F.col("suffix").alias("s"), "up"), "s", "left")
    by_host = by_host.select(F.col("s").alias("host_suffix"), F.col("host").alias("host_name"), F.zip_with(
        "n", F.coalesce("up", share), lambda n, g: n + F.lit(HOST_WEIGHT) * g).alias("p"))
    by_host = by_host.withColumn("prior", F.transform("p", lambda x: F.log(x / mass(F.col("p"))))).drop("p")
    found = (scored.join(by_declared, "declared", "left").join(by_suffix.drop("up"), "suffix", "left")
             .join(by_host, F.col("host").eqNullSafe(F.col("host_name")) & F.col("suffix").eqNullSafe(F.col("host_suffix")), "left"))
    zero = F.array(*[F.lit(0.0)] * len(langs))
    add = lambda a, b: F.zip_with(a, F.coalesce(b, zero), lambda x, y: x + y)
    prior = F.coalesce("prior", F.transform(share, lambda x: F.log(x)))
    post = add(add(add(F.col("text_ll"), F.col("ll_declared")), F.col("ll_suffix")), prior)
    found = found.withColumn("post", post).withColumn("top", F.array_max("post"))
    found = found.withColumn("confidence", 1.0 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    lang = F.when(F.col("known"), F.element_at(names, F.array_position("post", F.col("top")).cast("int")))
    return found.select("id", "declared", F.when(F.col("known"), F.element_at(names, F.col("vote"))).alias("text_lang"), lang.alias("lang"),
                        F.when(F.col("known"), F.col("confidence")).otherwise(0.0).alias("confidence"),
                        (F.col("known") & (F.col("confidence") >= least)).alias("kept"))


def identify_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents: the declared language is `lang`, the host is `source`; they carry no address, so the suffix is neutral."""
    return identify(docs, id_col, F.col("text"), F.col("lang"), F.lit(None), F.col("source"))


def identify_pages(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Web pages: language attribute of the markup, last label of the host, host; the text is the html without markup."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^.*?://([^/?#]*)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return identify(pages, id_col, text, blank(declared), blank(F.regexp_extract(host, r"([^.]+)$", 1)), blank(host))
