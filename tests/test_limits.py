"""Inputs beyond the sizes that the operators once assumed."""

from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import extraction as ex
from colloquy.operators.validation import validate_owner
from colloquy.sources.transcripts import refused_files, scan_transcripts, segments_from_json

SEGMENT = "meeting_id long, seg_id int, speaker string, ts_raw string, start_s double, text string"


def test_long_names_are_found_in_the_text(spark):
    name = "Anna Maria van der Berg of Ostend"
    segments = spark.createDataFrame([(1, 0, "Bob", None, None, f"we heard {name} speak"), (1, 1, "Bob", None, None, "and Anna Maria left")], SEGMENT)
    items = spark.createDataFrame([(1, 1, name), (1, 2, "Anna Maria van der Velde of Ostend")], "meeting_id long, item_id long, owner string")
    got = {r.owner: r.mentioned_in_text for r in validate_owner(items, "owner", segments).collect()}
    assert got == {name: True, "Anna Maria van der Velde of Ostend": False}


def test_action_ids_stay_distinct(spark):
    one = "Bob will prepare the quarterly report number {}. "
    rows = [(1, 300_000, "Bob", None, None, "".join(one.format(i) for i in range(1200))), (1, 2**31 - 1, "Bob", None, None, one.format("last"))]
    got = [r.item_id for r in ex.extract_actions(spark.createDataFrame(rows, SEGMENT)).select("item_id").collect()]
    assert len(got) > 1000 and len(set(got)) == len(got) and min(got) > 0


def test_fillers_of_three_words(spark):
    df = spark.createDataFrame([("so at the end we will um, start at the",)], "t string")
    assert df.select(tx.strip_fillers(F.col("t"), ("um", "at the end", "so at"))).first()[0] == "we will start at the"


def test_refused_files_have_rows_and_long_strings_parse(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"transcript": [')
    (tmp_path / "good.json").write_text('{"transcript": [{"speaker": "A", "text": "hello"}]}')
    (tmp_path / "long.txt").write_text("A: " + "word " * 400)
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in refused_files(spark, str(tmp_path), 1000).collect()}
    assert got == {"bad.json": "not readable as JSON", "long.txt": "over the size limit"}
    assert {r.name for r in scan_transcripts(spark, str(tmp_path)).collect()} == {"bad.json", "good.json", "long.txt"}
    assert segments_from_json(scan_transcripts(spark, str(tmp_path)).filter("name = 'good.json'")).count() == 1


def test_phrases_of_any_length_across_segments(spark, monkeypatch):
    """Phrases of up to thousands of words, over segment and span borders, against str.__contains__."""
    import random

    from colloquy.operators import containment

    monkeypatch.setattr(containment, "SPAN", 300)
    monkeypatch.setattr(containment, "TILE", 7)
    monkeypatch.setattr(containment, "TILE_CHARS", 900)
    rng = random.Random(3)
    rows, texts = [], {}
    for meeting, count in ((1, 400), (2, 3), (3, 1)):
        parts = [" ".join(rng.choices(["an", "Bo", "cé", "delta", "e"], k=rng.choice([0, 1, 3, 9]))) for _ in range(count)]
        if meeting == 1:
            parts[200] = " ".join(rng.choices(["long", "words"], k=3000))
        rows += [(meeting, i, "S", None, None, p) for i, p in enumerate(parts)]
        texts[meeting] = " ".join(parts).lower()
    rows += [(2, 9, "S", None, None, None), (4, 0, "S", None, None, None)]
    needles = {(m, "absent") for m in (1, 2, 3, 4)} | {(1, texts[1]), (1, texts[1] + " "), (2, texts[2]), (9, "an")}
    for meeting, text in texts.items():
        for size in (1, 2, 5, 40, 300, 301, 2500, 9000):
            for _ in range(6):
                at = rng.randrange(max(1, len(text)))
                needles |= {(meeting, text[at:at + size]), (meeting, text[at:at + size] + "q")}
    needles = sorted(n for n in needles if n[1])
    got = containment.found_in_meeting(spark.createDataFrame(needles, "meeting_id long, phrase string"), "phrase", spark.createDataFrame(rows, SEGMENT))
    assert sorted(map(tuple, got.collect())) == [(m, n) for m, n in needles if n in texts.get(m, "")]


def test_name_candidates_lose_no_match(spark):
    """The prefix index of counted characters against all pairs."""
    import difflib
    import random

    from colloquy.operators.speakers import fuzzy_name_join

    rng = random.Random(5)
    some = lambda: "".join(rng.choices("aabcdeÉ -", k=rng.randint(1, 14)))
    names, speakers = [(m, some()) for m in (1, 2) for _ in range(80)], [(m, some()) for m in (1, 2, 3) for _ in range(60)]
    names += [(1, ""), (1, None)]
    for limit in (0.5, 0.7, 0.9):
        want = set()
        for m, a in set(names):
            ratios = [(-difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio(), b) for n, b in set(speakers) if n == m] if a else []
            if ratios and -min(ratios)[0] > limit:
                want.add((m, a, min(ratios)[1], -min(ratios)[0]))
        got = fuzzy_name_join(spark.createDataFrame(names, "meeting_id long, name string"), "name", spark.createDataFrame(speakers, "meeting_id long, speaker string"), limit)
        assert {tuple(r) for r in got.collect()} == want


def test_contradictions_beside_letters_and_line_ends(spark):
    """Words end at letters outside ASCII, and only a line feed ends a line, as in the SQL."""
    texts = ["yes\u00e9 no", "\u00e9yes, no\u4e2d", "yes\rno", "yes\u2028no", "will \u00e9 won't\u00e9", "yes\nno", "yes_ no", "yesterday no", "Yes, no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.contradicts(F.col("t"))).collect()] == [True] * 5 + [False] * 3 + [True]
