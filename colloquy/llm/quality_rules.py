"""Quality rules with risk-controlled cutoffs.

Every rule is a share in thousandths that is high in poor text. Labelled documents are a holdout: for a stratum and a rule
the cutoffs are tried from the largest down, and each is proved while the exact (Clopper-Pearson) upper bound of its
false rejection rate, over holdout documents of good quality, stays within limit / rules. This fixed order needs no
correction over cutoffs; of the proved ones the rule takes that which rejects the most poor documents more than good
ones. The error probability is split evenly over all strata and rules (Bonferroni). So with probability
1 - error no stratum loses more than `limit` of its good documents to the rules. A stratum with too few labels to prove
this gets no cutoff, and only the base rules apply.

Defined cases: null or blank text has no words and fails the base rules; null labels are ignored, and of several labels of
one document the worst counts; a null stratum is a stratum of its own; a null id has no label. Equal rows get equal verdicts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import binary_list, chunks, mix, words_of
from colloquy.session import materialize

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
UPPER = np.zeros(256, np.int64)
UPPER[ord("A"):ord("Z") + 1] = 1
RULES = {
    "symbol_share": "1000 * n_symbols / (word_chars + 1)",
    "capital_share": "1000 * n_capitals / (word_chars + 1)",
    "repeat_share": "1000 * n_repeat_words / (n_words + 1)",
    "line_share": "1000 * n_dup_lines / (n_lines + 1)",
}
WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines")


def text_statistics(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """STATS of every text of a batch, over whole texts."""
    out: dict[str, list] = {k: [] for k in STATS}
    for lo, hi in chunks(texts):
        part = [t or b"" for t in texts[lo:hi]]
        words = words_of(part)
        size = np.fromiter(map(len, part), np.int64, len(part)) + 1
        begin = np.cumsum(size) - size
        data = np.concatenate([words.data, np.full(1, 32, np.uint8)])
        total = lambda flags, at=begin: np.add.reduceat(flags.astype(np.int64), at)
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, words.start, 1)
        np.add.at(inside, words.end, -1)
        out["n_words"].append(np.diff(words.first))
        out["word_chars"].append(total((np.cumsum(inside)[:-1] > 0) & ((data & 0xC0) != 0x80)))
        out["n_symbols"].append(total(SYMBOLS[data]))
        out["n_capitals"].append(total(UPPER[data]))
        lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in part]
        out["n_lines"].append(np.array([len(x) for x in lines], np.int64))
        out["n_dup_lines"].append(np.array([len(x) - len(set(x)) for x in lines], np.int64))
        first, found = words.windows(WINDOW)
        doc = words.doc[first]
        _, back, count = np.unique(found ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        hit = first[count[back] > 1]
        cover = np.zeros(len(words.start) + WINDOW + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        out["n_repeat_words"].append(np.bincount(words.doc[np.cumsum(cover)[:len(words.start)] > 0], minlength=len(part)))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, STATS, base_failed and the rule shares (whole thousandths)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            stats = text_statistics(binary_list(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(stats[k], pa.int64()) for k in STATS]],
                                             names=["doc_id", "stratum", *STATS])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{k} bigint" for k in STATS))
    found = found.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    return found.withColumns({k: F.expr(f"cast(least(1000, floor({e})) as int)") for k, e in RULES.items()})


def upper_bound(failures: int, trials: int, error: float) -> float:
    """Clopper-Pearson: the largest rate under which at most `failures` of `trials` still has probability `error`."""
    if failures >= trials:
        return 1.0
    comb = [math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) for k in range(failures + 1)]
    lo, hi = failures / trials, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        a, b = math.log(max(p, 1e-300)), math.log1p(-p) if p < 1 else -1e300
        tail = sum(math.exp(c + k * a + (trials - k) * b) for k, c in enumerate(comb))
        lo, hi = (p, hi) if tail > error else (lo, p)
    return hi


def _cutoffs(limit: float, error: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("share", ascending=False)
        good = int(rows["good"].sum())
        cutoff, best, lost, caught, held = None, 0, 0, 0, (0, None)
        for share, own, poor in zip(rows["share"], rows["good"], rows["poor"], strict=True):
            lost, caught = lost + int(own), caught + int(poor)
            if share <= 0 or lost > limit * good or (rate := upper_bound(lost, good, error)) > limit:
                break
            if caught - lost > best:
                cutoff, best, held = int(share), caught - lost, (lost, rate)
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "rule": [rows["rule"].iloc[0]], "cutoff": pd.array([cutoff], "Int32"),
                             "holdout": [good], "false_rejections": [held[0]], "bound": [held[1]]})

    return run


def choose_cutoffs(measured: DataFrame, labels: DataFrame, limit: float = 0.04, error: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff (null: none proved), holdout size, false rejections and their upper bound.

    The holdout is counted by share first, so at most 1001 rows of a stratum and rule meet in one task.
    """
    quality = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.filter("not base_failed").join(quality, "doc_id").select(
        F.coalesce("stratum", F.lit("")).alias("stratum"), "quality",
        F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in RULES]), F.array(*RULES))).alias("rule", "share"))
    counts = materialize(held.groupBy("stratum", "rule", "share").agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("poor")))
    tests = max(1, counts.select("stratum", "rule").distinct().count())
    return counts.groupBy("stratum", "rule").applyInPandas(
        _cutoffs(limit / len(RULES), error / tests), "stratum string, rule string, cutoff int, holdout long, false_rejections long, bound double")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          limit: float = 0.04, error: float = 0.05) -> DataFrame:
    """measure() with `failed` (names of the rules at or over their cutoff) and `kept`."""
    measured = materialize(measure(docs, id_col, text_col, stratum_col))
    cutoffs = choose_cutoffs(measured, labels, limit, error).filter("cutoff is not null").groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]).withColumnRenamed("stratum", "of_stratum")
    found = measured.join(cutoffs, F.coalesce("stratum", F.lit("")) == F.col("of_stratum"), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    return found.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop(
        "of_stratum", *[f"cut_{r}" for r in RULES])
