"""Neighbourhood, budget and chunk operators over ordered segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx
from colloquy.functions import vector as vx
from colloquy.operators.ordering import near_window, running_sums, scan_states

MEETING = ["meeting_id"]
#: Characters of windows that leave Python in a batch.
OUT_CHARS = 1 << 20


def context_window(segments: DataFrame, k: int = 1) -> DataFrame:
    """Texts of the k rows before, the row, and the k rows after, as an array."""
    return near_window(
        segments, MEETING, "seg_id", k, {"context": lambda w: F.collect_list("text").over(w.rowsBetween(-k, k))}
    )


def extend_text(segments: DataFrame, ahead: int = 2, connectors=rules.CONTINUATION_WORDS) -> DataFrame:
    """Append following rows while the speaker stays or a connector word occurs."""
    exprs = {}
    for i in range(1, ahead + 1):
        exprs[f"_t{i}"] = lambda w, i=i: F.lead("text", i).over(w)
        exprs[f"_s{i}"] = lambda w, i=i: F.lead("speaker", i).over(w)
    rows = near_window(segments, MEETING, "seg_id", ahead, exprs)
    out, going = [F.col("text")], F.lit(True)
    for i in range(1, ahead + 1):
        t, s = F.col(f"_t{i}"), F.col(f"_s{i}")
        going = going & t.isNotNull() & (s.eqNullSafe(F.col("speaker")) | tx.has_any(t, connectors))
        out.append(F.when(going, t))
    return rows.withColumn("decision_text", F.concat_ws(" ", *out)).select(*segments.columns, "decision_text")


def decision_participants(
    rows: DataFrame, text: str = "decision_text", reach: int = 2, group_words=rules.GROUP_WORDS, limit: int | None = 5
) -> DataFrame:
    """Own speaker, plus the speakers around it where the text speaks for a group."""
    near = near_window(
        rows, MEETING, "seg_id", reach, {"_near": lambda w: F.collect_list("speaker").over(w.rowsBetween(-reach, reach))}
    )
    own = F.array_compact(F.array("speaker"))
    group = F.lower(text).rlike(group_words)
    around = F.array_distinct(F.concat(own, "_near"))
    people = F.when(group, around if limit is None else F.slice(around, 1, limit)).otherwise(own)
    return near.withColumn(
        "participants", F.when(F.size(people) > 0, people).otherwise(F.array(F.lit("Meeting participants")))
    ).drop("_near")


def budget_prefix(segments: DataFrame, max_tokens: float = 2500, per_word: float = 1.3) -> DataFrame:
    """Leading 'Speaker: text' lines of a meeting that fit the token budget."""
    line = F.concat_ws(": ", F.coalesce("speaker", F.lit("Speaker")), "text")
    rows = segments.withColumn("line", line).withColumn("_w", tx.word_count("line"))
    run = running_sums(rows, MEETING, "seg_id", {"words_so_far": F.col("_w")})
    return run.filter(F.col("words_so_far") * F.lit(per_word) <= max_tokens).drop("_w")


def budget_chunks(segments: DataFrame, max_tokens: float = 800, per_word: float = 1.33) -> DataFrame:
    """Greedy chunks of at most max_tokens; adds chunk_no (1, 2, …) to every row.

    State 0 is an empty chunk, state k+1 a chunk of k words (capped just above the budget).
    """
    cap = int(np.floor(max_tokens / per_word + 1e-9))

    def step(state, n):
        fresh = (state == 0) | (state - 1 + n > cap)
        return np.minimum(np.where(fresh, n, state - 1 + n), cap + 1) + 1

    rows = segments.withColumn("_w", tx.word_count("text"))
    scanned = scan_states(rows, MEETING, "seg_id", ["_w"], cap + 3, step)
    s = F.col("state_before")
    starts = F.when((s == 0) | (s - 1 + F.col("_w") > cap), 1).otherwise(0)
    return running_sums(scanned, MEETING, "seg_id", {"chunk_no": starts}).drop("_w", "state_before")


def semantic_chunks(
    sentences: DataFrame,
    keys: list[str],
    order: str,
    vec: str = "vec",
    max_tokens: int = 600,
    min_tokens: int = 200,
    close: float = 0.7,
) -> DataFrame:
    """Sentence chunks by size and by cosine to the previous sentence; adds chunk_no."""
    rows = near_window(sentences, keys, order, 1, {"_prev": lambda w: F.lag(vec).over(w)})
    rows = rows.withColumn("_near", F.coalesce(vx.cosine(F.col(vec), F.col("_prev")) > close, F.lit(False))).withColumn(
        "_tok", F.floor(F.length("text") / 4).cast("int")
    )

    def stays(state, near, tok):
        size = state - 1
        return (state > 0) & (size + tok <= max_tokens) & ((size < min_tokens) | near)

    def step(state, near, tok):
        keep = stays(state, near, tok)
        return np.minimum(np.where(keep, state - 1 + tok, tok), max_tokens + 1) + 1

    scanned = scan_states(rows.drop("_prev"), keys, order, ["_near", "_tok"], max_tokens + 3, step)
    starts = F.when(stays(F.col("state_before"), F.col("_near"), F.col("_tok")), 0).otherwise(1)
    return running_sums(scanned, keys, order, {"chunk_no": starts}).drop("_near", "_tok", "state_before")


def word_chunks(texts: DataFrame, key: str, max_tokens: int = 650, text: str = "text") -> DataFrame:
    """Fixed runs of int(.75·max_tokens) words, (key, chunk_no, chunk)."""
    size = int(max_tokens * 0.75)

    def chunks(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))

    return texts.select(key, F.posexplode(tx.let(tx.words(F.col(text)), chunks)).alias("chunk_no", "chunk"))


def overlap_chunks(texts: DataFrame, key: str, size: int = 8000, overlap: int = 1000, text: str = "text") -> DataFrame:
    """Character windows with overlap, cut after the last period (else newline) of the window.

    A cut that would not move the window forward is replaced by the window's end.
    """

    def windows(s):
        start = 0
        while len(s) - start > size:
            stop = max(s.rfind(".", start, start + size), -1)
            stop = stop if stop != -1 else s.rfind("\n", start, start + size)
            if stop + 1 - overlap <= start:
                stop = start + size - 1
            yield start, s[start : stop + 1]
            start = stop + 1 - overlap
        yield start, s[start:]

    def cut(batches):
        """Texts are read one at a time, and windows leave in small batches."""
        for batch in batches:
            names, kinds = [*batch.schema.names[:1], "chunk_no", "start", "chunk"], [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string()]
            rows, chars = [], 0
            for r in range(batch.num_rows):
                whole = batch.column(1)[r].as_py()
                own = batch.column(0)[r].as_py()
                for no, (start, chunk) in enumerate(windows(whole) if whole is not None else ()):
                    rows.append((own, no, start, chunk))
                    chars += len(chunk)
                    if chars >= OUT_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, chars = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(cut, f"`{key}` {kind}, chunk_no int, start int, chunk string")


def resolve_pronouns(segments: DataFrame, pronouns=rules.PRONOUNS, reach: int = 3) -> DataFrame:
    """Pronouns become the only other speaker of the previous rows, if there is exactly one."""
    rows = near_window(
        segments, MEETING, "seg_id", reach, {"_near": lambda w: F.collect_set("speaker").over(w.rowsBetween(-reach, -1))}
    )
    others = F.array_except("_near", F.array("speaker"))
    name = F.get(others, F.lit(0))
    replaced = F.array_join(
        F.transform(tx.words(F.col("text")), lambda x: F.when(F.btrim(F.lower(x), F.lit(".,!?")).isin(pronouns), name).otherwise(x)),
        " ",
    )
    whole = F.array_join(tx.words(F.col("text")), " ")
    text = F.when(F.col("speaker").isNull() | (F.col("text") == ""), F.col("text")).when(F.size(others) == 1, replaced).otherwise(whole)
    return rows.withColumn("text", text).select(*segments.columns)


def topic_segments(rows: DataFrame, keys: list[str], order: str, vec: str = "vec", threshold: float = 0.7) -> DataFrame:
    """A topic starts where the 3-row mean vector turns away from the previous 3-row mean.

    Every row belongs to the first topic that covers it, so topics do not overlap.
    """
    near = near_window(rows, keys, order, 3, {"_v": lambda w: F.collect_list(vec).over(w.rowsBetween(-3, 0))})

    def total(i: int) -> Column:
        a, b, c = (F.get("_v", F.lit(i + d)) for d in range(3))
        return vx.vector_sum(vx.vector_sum(a, b), c)

    turn = F.when((F.size("_v") == 4) & (vx.cosine(total(0), total(1)) < threshold), 1).otherwise(0)
    flagged = near.withColumn("_turn", turn).drop("_v")
    return running_sums(flagged, keys, order, {"topic_id": F.col("_turn")}).drop("_turn")
