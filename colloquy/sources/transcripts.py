"""Transcript files (text, JSON, subtitles) to the segments table.

Files arrive as rows (meeting_id, content). A size limit is an option; refused_files gives what it or broken JSON
keeps out, so that no file vanishes without a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx

SEGMENT_COLUMNS = ["meeting_id", "seg_id", "speaker", "ts_raw", "start_s", "text"]


def scan_transcripts(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(meeting_id, name, size_mb, content, path) of .txt, .json and .srt files, up to max_bytes if that is given."""
    files = _files(spark, path)
    return files_table(files if max_bytes is None else files.filter(F.col("length") <= max_bytes))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,json,srt}").option("recursiveFileLookup", "true").load(path)


def refused_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, size_mb, reason) of files that scanning or parsing leaves out: over max_bytes, or JSON that cannot be read."""
    files = _files(spark, path)
    size = F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb")
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    over = files.filter(large).select("path", size, F.lit("over the size limit").alias("reason"))
    parsed = F.try_parse_json(F.decode("content", "UTF-8"))
    broken = files.filter(~large & F.lower("path").endswith(".json") & parsed.isNull()).select("path", size, F.lit("not readable as JSON").alias("reason"))
    return over.unionByName(broken)


def files_table(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.xxhash64("path").alias("meeting_id"), name.alias("name"), F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
        F.decode("content", "UTF-8").alias("content"), "path",
    )


def route_format(files: DataFrame) -> DataFrame:
    """Adds format: by extension; a .txt with a subtitle arrow in its first five lines is srt."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    head = F.array_join(F.slice(F.split("content", "\n", 6), 1, 5), "\n")
    return files.withColumn(
        "format", F.when(ext == "json", "json").when(ext == "srt", "srt").when(ext.isin("txt", "") & head.rlike(rules.SRT_ARROW), "srt").otherwise("txt")
    )


def parse_transcripts(files: DataFrame) -> DataFrame:
    f = route_format(files)
    part = lambda fmt: f.filter(F.col("format") == fmt).select("meeting_id", "content")
    return segments_from_text(part("txt")).unionByName(segments_from_json(part("json"))).unionByName(segments_from_srt(part("srt")))


def _finish(rows: DataFrame) -> DataFrame:
    return rows.select(
        "meeting_id", F.col("seg_id").cast("int").alias("seg_id"), "speaker", "ts_raw",
        tx.timestamp_to_seconds(F.regexp_replace(F.regexp_extract("ts_raw", r"^([\d:]+)", 1), "^$", "x")).alias("start_s"), "text",
    )


def _turns(lines: DataFrame, turn: str = "turn") -> DataFrame:
    """Text lines of one turn joined in order; turns numbered from 0."""
    pieces = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    t = lines.groupBy("meeting_id", turn).agg(
        tx.strip(F.array_join(F.transform(pieces, lambda p: p["piece"]), " ")).alias("text"),
        F.min_by("speaker", "pos").alias("speaker"), F.min_by("ts_raw", "pos").alias("ts_raw"),
    ).filter("text <> ''")
    return t.withColumn("seg_id", F.row_number().over(Window.partitionBy("meeting_id").orderBy(turn)) - 1)


def segments_from_text(files: DataFrame) -> DataFrame:
    """Line-wise turns: 'Last, First  m:ss' headers, 'Speaker: text', blank lines close a turn.

    A 'Speaker: text' line keeps the time of the header before it; a blank line after
    text clears speaker and time, a blank line after a header does not.
    """
    line = tx.strip("raw")
    lines = files.select("meeting_id", F.posexplode(F.split("content", "\n")).alias("pos", "raw")).select("meeting_id", "pos", line.alias("line"))
    ln = F.col("line")
    header = ln.rlike(rules.HEADER_LAST_FIRST) | ln.rlike(rules.HEADER_FIRST_LAST)
    kind = (
        F.when(ln == "", "blank").when(header, "header").when(ln.rlike(rules.SPEAKER_COLON), "colon")
        .when(ln.rlike(rules.BARE_TIMESTAMP), "time").otherwise("plain")
    )
    lines = lines.withColumn("kind", kind)
    w = Window.partitionBy("meeting_id").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    is_text = F.col("kind").isin("colon", "plain")
    lines = lines.withColumn("_cleared", (F.col("kind") == "blank") & F.coalesce(F.lag(is_text).over(w), F.lit(False)))

    both = F.coalesce(tx.extract(ln, rules.HEADER_LAST_FIRST, 1), tx.extract(ln, rules.HEADER_FIRST_LAST, 1))
    name = F.regexp_replace(tx.strip(both), r"\s*\([^)]+\)$", "")
    parts = F.transform(F.split(name, ","), tx.strip)
    flipped = F.when(F.size(parts) == 2, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(name)
    k = F.col("kind")
    who = F.when(F.col("_cleared"), "").when(k == "header", flipped).when(k == "colon", F.regexp_extract(ln, rules.SPEAKER_COLON, 1))
    when_ = (
        F.when(F.col("_cleared"), "")
        .when(k == "header", F.coalesce(tx.extract(ln, rules.HEADER_LAST_FIRST, 2), tx.extract(ln, rules.HEADER_FIRST_LAST, 2)))
        .when(k == "time", ln)
    )
    marked = lines.select(
        "meeting_id", "pos", "kind",
        F.when(k == "colon", F.btrim(F.regexp_extract(ln, rules.SPEAKER_COLON, 2), F.lit("]"))).otherwise(ln).alias("piece"),
        F.sum(F.when(k.isin("blank", "header", "colon"), 1).otherwise(0)).over(upto).alias("turn"),
        F.nullif(F.last(who, ignorenulls=True).over(upto), F.lit("")).alias("speaker"),
        F.nullif(F.last(when_, ignorenulls=True).over(upto), F.lit("")).alias("ts_raw"),
    ).filter(is_text)
    return _finish(_turns(marked))


def segments_from_speaker_lines(files: DataFrame) -> DataFrame:
    """'Name:', '[Name]' or 'Name m:ss' open a turn; other lines continue it; text before is dropped."""
    lines = files.select("meeting_id", F.posexplode(F.split("content", "\n")).alias("pos", "raw")).select(
        "meeting_id", "pos", tx.strip("raw").alias("line")
    ).filter("line <> ''")
    ln = F.col("line")
    speaker = tx.first_extract(ln, rules.LINE_SPEAKER)
    bare = ln
    for p in rules.LINE_SPEAKER:
        bare = tx.strip(F.regexp_replace(bare, p, ""))
    bare = tx.strip(F.regexp_replace(bare, r"^:+", ""))
    upto = Window.partitionBy("meeting_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(
        "meeting_id", "pos",
        F.when(speaker.isNotNull(), bare).otherwise(ln).alias("piece"),
        F.sum(F.when(speaker.isNotNull(), 1).otherwise(0)).over(upto).alias("turn"),
        F.last(speaker, ignorenulls=True).over(upto).alias("speaker"),
        F.lit(None).cast("string").alias("ts_raw"),
    ).filter("turn >= 1 and piece <> ''")
    return _finish(_turns(marked))


def segments_from_json(files: DataFrame) -> DataFrame:
    """List of objects or strings under transcript (or segments); parallel speakers / timestamps arrays."""
    v = F.try_parse_json("content")
    listed = lambda key: F.try_variant_get(v, f"$.{key}", "array<variant>")
    whole = F.when(F.schema_of_variant(F.try_variant_get(v, "$.transcript", "variant")) == "STRING", F.array(F.try_variant_get(v, "$.transcript", "variant")))
    items = F.coalesce(whole, listed("transcript"), listed("segments"))
    rows = files.select(
        "meeting_id", F.posexplode(items).alias("seg_id", "item"),
        F.try_variant_get(v, "$.speakers", "array<string>").alias("_sp"), F.try_variant_get(v, "$.timestamps", "array<string>").alias("_ts"),
    )
    field = lambda key: F.try_variant_get("item", f"$.{key}", "string")
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    text = F.when(is_object, F.coalesce(field("text"), field("content"), F.lit(""))).otherwise(F.try_variant_get("item", "$", "string"))
    pick = lambda key, arr: F.coalesce(F.when(is_object, field(key)), F.get(arr, F.col("seg_id")))
    return _finish(
        rows.select("meeting_id", "seg_id", pick("speaker", "_sp").alias("speaker"), pick("timestamp", "_ts").alias("ts_raw"), tx.strip(text).alias("text"))
    )


def segments_from_srt(files: DataFrame) -> DataFrame:
    """Cue blocks: number, time line kept raw, text lines joined; '[Name] ' or 'Name: ' split off."""
    blocks = F.transform(F.split(tx.strip("content"), r"\n\s*\n"), lambda b: F.split(tx.strip(b), "\n"))
    cues = F.filter(blocks, lambda b: F.size(b) >= 2)
    rows = files.select("meeting_id", F.posexplode(cues).alias("seg_id", "_b"))
    second = F.get("_b", F.lit(1))
    body = F.array_join(F.filter(F.transform(F.slice("_b", F.lit(3), F.size("_b")), tx.strip), lambda x: x != ""), " ")
    rows = rows.select("meeting_id", "seg_id", F.when(second.rlike("^" + rules.SRT_ARROW), second).alias("ts_raw"), body.alias("_t"))
    t = F.col("_t")
    speaker = F.coalesce(tx.extract(t, rules.SRT_BRACKET, 1), tx.extract(t, rules.SRT_COLON, 1))
    text = F.coalesce(tx.extract(t, rules.SRT_BRACKET, 2), tx.extract(t, rules.SRT_COLON, 2), t)
    return _finish(rows.select("meeting_id", "seg_id", speaker.alias("speaker"), "ts_raw", tx.strip(text).alias("text")))
