"""Which short text is a substring of which long text.

Pairs are found by equi-join: contains(long, short) as a join condition compares every pair of a group. Here
both sides are reduced to a key that any match must share, by the number of words
in the short text (words are separated by single spaces, as in the text itself):

* 1 word: its first (up to three) characters; each distinct token of the long text
  offers its 1–3 character pieces,
* 2 words: the end of the first and the start of the second (up to three characters),
* 3–4 words: end of the first, the whole second, start of the third,
* 5 words or more: the second to fourth word, which must be whole tokens.

A long text only builds the keys of a class if its group has short texts of that
class. Candidates are then checked with contains(), so the result is exact for short
texts that hold more than spaces.

Whether a meeting's running text holds a phrase is asked of overlapping spans of the text, each searched for a tile of phrases at once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import let
from colloquy.operators.ordering import running_sums
from colloquy.session import materialize


def _need(needles: DataFrame, text: str) -> DataFrame:
    """Adds _class and the key _need of every short text."""
    rows = needles.withColumn("_t", F.split(F.trim(F.col(text)), " ")).filter(F.trim(F.col(text)) != "")
    w1, w2, w3, w4 = (F.get("_t", F.lit(i)) for i in range(4))
    cut = lambda c, most: F.least(F.lit(most), F.length(c))
    n = F.size("_t")
    c = F.when(n >= 5, 5).when(n >= 3, 3).otherwise(n)
    key = (
        F.when(c == 1, F.concat_ws("|", F.lit("1"), F.left(w1, cut(w1, 3))))
        .when(c == 2, F.concat_ws("|", F.lit("2"), F.right(w1, cut(w1, 3)), F.left(w2, cut(w2, 3))))
        .when(c == 3, F.concat_ws("|", F.lit("3"), F.right(w1, cut(w1, 2)), w2, F.left(w3, cut(w3, 2))))
        .otherwise(F.concat_ws("|", F.lit("5"), w2, w3, w4))
    )
    return rows.withColumn("_class", c).withColumn("_need", key).drop("_t")


def _offers(hay: DataFrame, needs: DataFrame, text: str, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows (keep…, _need): the keys a long text offers, of the classes its group asks for."""
    rows = hay.select(*dict.fromkeys([*keys, *keep, text]))
    if keys:
        rows = rows.join(needs.groupBy(*keys).agg(F.collect_set("_class").alias("_asked")).hint("merge"), keys)
    else:
        # one group for everything: at most four class numbers are read
        known = sorted(r["_class"] for r in needs.select("_class").distinct().collect())
        rows = rows.withColumn("_asked", F.array(*[F.lit(c) for c in known]).cast("array<int>"))
    none = F.array().cast("array<string>")

    def pieces(tokens):
        def of(u):
            cuts = [
                F.when(F.length(u) >= q, F.transform(F.sequence(F.lit(1), F.length(u) - q + 1), _cutter(u, q))).otherwise(none)
                for q in (1, 2, 3)
            ]
            return F.concat(*cuts)

        return F.flatten(F.transform(F.array_distinct(tokens), of))

    def ends(tokens, cls):
        most, step = (3, 1) if cls == 2 else (2, 2)

        def of(i):
            u, v, last = F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + step)
            out = []
            for a in range(1, most + 1):
                for b in range(1, most + 1):
                    parts = [F.lit(str(cls)), F.right(u, F.lit(a)), *([v] if cls == 3 else []), F.left(last, F.lit(b))]
                    out.append(F.when((F.length(u) >= a) & (F.length(last) >= b), F.concat_ws("|", *parts)))
            return F.array_compact(F.array(*out))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), of))

    def runs(tokens):
        def of(i):
            parts = [F.get(tokens, i + k) for k in (1, 2, 3)]
            return F.when(i + 3 < F.size(tokens), F.concat_ws("|", F.lit("5"), *parts))

        return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), of))

    def offered(tokens):
        wants = lambda cls, made: F.when(F.array_contains("_asked", cls), made).otherwise(none)
        return F.concat(wants(1, pieces(tokens)), wants(2, ends(tokens, 2)), wants(3, ends(tokens, 3)), wants(5, runs(tokens)))

    offers = let(F.split(F.col(text), " "), offered)
    return rows.select(*keep, F.explode(offers).alias("_need"))


def _cutter(u: Column, q: int):
    return lambda p: F.concat(F.lit("1|"), F.substr(u, p, F.lit(q)))


def contains_pairs(
    needles: DataFrame, needle_id: str, needle: str, hay: DataFrame, hay_id: str, text: str, keys: list[str]
) -> DataFrame:
    """(keys…, needle_id, hay_id) for every short text contained in a long text of the same key.

    Missing and blank short texts match nothing. keys may be empty: then every short text is looked up in every long text.
    """
    # read twice; stored, its filter also brings no Bloom filter of a megabyte into every later task that the driver sends
    n = materialize(_need(needles.select(*keys, needle_id, needle), needle).drop(needle))
    h = _offers(hay, n, text, keys, [*keys, hay_id])
    # keys and texts are far larger than the plan takes them for, so none of these joins may be broadcast
    candidates = n.select(*keys, needle_id, "_need").join(h.hint("merge"), [*keys, "_need"]).select(*keys, needle_id, hay_id).distinct()
    return (
        candidates.join(needles.select(*keys, needle_id, needle).hint("merge"), [*keys, needle_id])
        .join(hay.select(*keys, hay_id, text).hint("merge"), [*keys, hay_id])
        .filter(F.contains(F.col(text), F.col(needle)))
        .select(*keys, needle_id, hay_id)
    )


#: Needles of up to so many characters share a width; longer ones go by powers of two.
WIDTH = 64
#: Characters of text looked through at a time, and needles and their characters searched at a time.
SPAN, TILE, TILE_CHARS = 1 << 17, 1024, 1 << 17


def _search():
    """Rows (meeting_id, needle) of the needles of a tile that a text holds, by one automaton a tile."""

    def run(batches):
        import ahocorasick

        last, automaton = None, None
        for batch in batches:
            meetings, found, size = [], [], 0
            kind = batch.schema.field(0).type
            # a row holds a whole tile and a whole span, so one row at a time becomes Python objects
            for r in range(batch.num_rows):
                meeting, width, tile = (batch.column(i)[r].as_py() for i in range(3))
                if (meeting, width, tile) != last:
                    last, automaton = (meeting, width, tile), ahocorasick.Automaton()
                    for needle in batch.column(3)[r]:
                        needle = needle.as_py()
                        automaton.add_word(needle, needle)
                    automaton.make_automaton()
                hits = {needle for _, needle in automaton.iter(batch.column(4)[r].as_py())}
                meetings += [meeting] * len(hits)
                found += hits
                size += sum(map(len, hits))
                if size >= TILE_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(meetings, kind), pa.array(found, pa.string())], names=["meeting_id", "needle"])
                    meetings, found, size = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(meetings, kind), pa.array(found, pa.string())], names=["meeting_id", "needle"])

    return run


def _text_spans(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """(meeting_id, width, text): a meeting's text, segments joined by single spaces, in overlapping spans.

    asked(meeting_id, width): a span overlaps the next one by `width` characters, so it holds every stretch of that length whole.
    """
    rows = segments.select("meeting_id", "seg_id", "text").filter("text is not null")
    rows = running_sums(rows, ["meeting_id"], "seg_id", {"_end": F.length("text") + 1})
    start = F.col("_end") - F.length("text") - 1
    rows = rows.select("meeting_id", F.when(start == 0, F.col("text")).otherwise(F.concat(F.lit(" "), "text")).alias("_t"), F.greatest(start - 1, F.lit(0)).alias("_from"))
    step = F.greatest(F.lit(SPAN), 4 * F.col("width"))
    rows = rows.join(asked, "meeting_id").withColumn("_step", step).withColumn("_to", F.col("_from") + F.length("_t"))
    first = F.greatest(F.lit(0), F.floor((F.col("_from") - F.col("width")) / F.col("_step")))
    rows = rows.withColumn("_b", F.explode(F.sequence(first, F.floor(F.col("_to") / F.col("_step")))))
    low = F.greatest(F.col("_b") * F.col("_step"), F.col("_from"))
    high = F.least((F.col("_b") + 1) * F.col("_step") + F.col("width"), F.col("_to"))
    piece = F.substr("_t", (low - F.col("_from") + 1).cast("int"), (high - low).cast("int"))
    rows = rows.filter(high > low).select("meeting_id", "width", "_b", F.struct(F.col("_from"), piece.alias("t")).alias("_p"))
    spans = rows.groupBy("meeting_id", "width", "_b").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return spans.select("meeting_id", "width", F.array_join(F.col("_p.t"), "").alias("text"))


def found_in_meeting(needles: DataFrame, needle: str, segments: DataFrame, lower: bool = True) -> DataFrame:
    """Distinct (meeting_id, needle) that occur in the meeting's text read as one string; needles of any length.

    Needles are dealt to tiles of like length; a text is cut into spans of SPAN characters, or four times the tile's width, that
    overlap by the width, and each span is searched once for a whole tile. No span or tile grows with a meeting.
    """
    distinct = needles.select("meeting_id", F.col(needle).alias("needle")).filter(F.length("needle") > 0).distinct()
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.length("needle")))).cast("bigint")
    sized = distinct.withColumn("width", F.greatest(F.lit(WIDTH).cast("bigint"), power, F.length("needle").cast("bigint")))
    tiles = sized.groupBy("meeting_id", "width").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.length("needle")) / TILE_CHARS)).alias("_n"))
    tiles = (sized.join(tiles, ["meeting_id", "width"]).withColumn("tile", F.pmod(F.xxhash64("needle"), "_n"))
             .groupBy("meeting_id", "width", "tile").agg(F.collect_list("needle").alias("needles")))
    text = segments.select("meeting_id", "seg_id", F.lower("text").alias("text")) if lower else segments
    spans = _text_spans(text, sized.select("meeting_id", "width").distinct())
    work = tiles.join(spans, ["meeting_id", "width"]).select("meeting_id", "width", "tile", "needles", "text").sortWithinPartitions("meeting_id", "width", "tile")
    kind = needles.schema["meeting_id"].dataType.simpleString()
    return work.mapInArrow(_search(), f"meeting_id {kind}, needle string").distinct().withColumnRenamed("needle", needle)
