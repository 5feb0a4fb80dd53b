"""Periodic runs of words: maximal stretches that repeat a short sequence of words several times, and texts without the repeats.

Method: an online diagonal DP over the words of a text, kept sparse. A word's earlier occurrences name lags; while the words
at a lag keep matching, the lag's match length grows, and where the matches end, a length that suffices is a run. Two facts
keep the table sparse without loss. First, a run of period q and at least 3 q words matches itself at lag q over 2 q words or
more, so at the level of windows of s words, s a power of two in [q, 2 q), every word of the match (but the first s - 1) ends
a window that has occurred before. Second, of a window's earlier occurrences within s words only the nearest can be a
smallest period: a nearer one gives the text a common divisor of both lags as its period. So a level holds one lag a word, and
a level's work is confined to words whose windows of four recur at all. A text of n words costs O(n log n) whatever it
repeats. A batch of texts runs through the levels in arrays: a lag's match is extended where the lag of the next word is the same.

Defined cases: null or blank text has no words and no runs (a null text stays null, a blank one becomes empty); rows that
repeat an id are judged one by one; null ids stay null; an empty table gives no rows; other columns are ignored. Texts of any
length are read whole, one text at a time in memory. Of overlapping runs each is reported; a word is dropped if any run asks
for it. Word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import WORD_BASE, Words, binary_list, chunks, mix, powers, words_of

BASE_LEVEL = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _matches(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lags of ascending word places `at` to the nearest earlier place of equal key: (first, last, lag) of every stretch of equal lags."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    lag = np.zeros(len(at), np.int64)
    lag[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
    ends = (np.diff(lag) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(np.concatenate([[True], ends]))
    last = np.append(first[1:], len(at)) - 1
    live = lag[first] > 0
    return at[first[live]], at[last[live]], lag[first[live]]


def runs_of(words: Words, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (document, first word in the document, length, period) of all runs, in that order."""
    out = [np.zeros((0, 4), np.int64)]
    size = len(words.hash)
    at, hashes = words.windows(BASE_LEVEL)
    if len(at):
        up, down = powers(WORD_BASE, size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(words.hash * up[:size], out=total[1:])
        salt = mix(words.doc.astype(np.uint64) + np.uint64(1))
        key = hashes ^ salt[at]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        recurs = np.zeros(size + 1, np.int64)
        recurs[at[count[back] > 1] + 1] = 1
        recurs = np.cumsum(recurs)
        level = BASE_LEVEL
        while len(at):
            keep = recurs[at + level - BASE_LEVEL + 1] - recurs[at] == level - BASE_LEVEL + 1
            at = at[keep]
            if not len(at):
                break
            key = mix((total[at + level] - total[at]) * down[at]) ^ salt[at]
            first, last, lag = _matches(key, at)
            length = last - first + level + lag
            found = (lag <= level) & ((lag > level // 2) | (level == BASE_LEVEL)) & (length >= np.maximum(min_length, min_exponent * lag))
            first, lag, length = first[found], lag[found], length[found]
            doc = words.doc[first]
            out.append(np.stack([doc, first - lag - words.first[doc], length, lag], 1))
            level *= 2
            at = at[at + level <= size]
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _collapse(text: bytes | None, runs: np.ndarray) -> bytes | None:
    """Words that no run holds after its first period, joined by single spaces."""
    if text is None:
        return None
    words = text.split()
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 1] + runs[:, 3], 1)
        np.add.at(change, runs[:, 1] + runs[:, 2], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def _scan(min_length: int, min_exponent: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), binary_list(batch.column(1))
            for lo, hi in chunks(texts):
                words = words_of(texts[lo:hi])
                runs = runs_of(words, min_length, min_exponent)
                cut = np.searchsorted(runs[:, 0], np.arange(hi - lo + 1))
                rows = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(RUN))
                kept = [_collapse(texts[lo + d], runs[cut[d]:cut[d + 1]]) for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """Per row of `docs`: id, n_words, runs (start, length and smallest period in words, by start) and the collapsed text.

    A run has at least max(min_length, min_exponent * period) words, and no neighbouring word extends it at its period. The
    collapsed text leaves out each word that a run holds after its first period. Row-local: no shuffle, whatever the keys.
    """
    if min_exponent < 3 or min_length < 6:
        raise ValueError("a run needs an exponent of at least 3 and a length of at least 6 words")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan(min_length, min_exponent),
                           f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with known runs in a tenth of the texts, chosen and shaped by the CRC-32 of the decimal id: h.

    Where h % 10 = 0 and a text has n > 0 words, word i >= a becomes word a + (i - a) % p, with g = floor(h / 10), a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Texts of null id stay as they are.
    """
    h = f"crc32(cast(cast(`{id_col}` as string) as binary))"
    g, n = f"({h} div 10)", "size(w)"
    a = f"({g} % {n})"
    p = f"(1 + ({n} - {a}) div (3 + {g} % 8))"
    words = f"filter(split(`{text_col}`, '[ \\\\t-\\\\r]+'), x -> x <> '')"
    text = f"""transform(array({words}), w -> if({n} = 0, `{text_col}`,
        concat_ws(' ', transform(sequence(0L, {n} - 1L), i -> w[cast(if(i >= {a}, {a} + (i - {a}) % {p}, i) as int)]))))[0]"""
    return docs.withColumn(text_col, F.expr(f"CASE WHEN {h} % 10 = 0 AND `{text_col}` IS NOT NULL THEN {text} ELSE `{text_col}` END"))


def digests(found: DataFrame) -> DataFrame:
    """periodic_runs in comparable columns: number of runs, the longest run, and hashes of all runs and of the collapsed text."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as l, -r.start as s, -r.period as p)))")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.withColumn("best", longest).select(
        "id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.l div -best.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
