"""Property tests for operators that SQL cannot express, against short loops."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import cleaning as cl
from colloquy.operators import dedup as dd
from colloquy.operators import evaluation as ev
from colloquy.operators import extraction as ex
from colloquy.operators import mentions as mn
from colloquy.operators import summaries as sm
from colloquy.operators import windows as wi
from colloquy.operators.containment import contains_pairs


@pytest.fixture(scope="module")
def talk(spark):
    rnd = random.Random(3)
    rows = [
        (m, s, rnd.choice(["Ann Lee", "Ann Lee", "Bob", None]), "0:05", " ".join(f"w{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 14))))
        for m in range(4) for s in range(60)
    ]
    return spark.createDataFrame(rows, "meeting_id long, seg_id long, speaker string, ts_raw string, text string")


def meetings(df, *cols):
    out = {}
    for r in df.orderBy("meeting_id", "seg_id").collect():
        out.setdefault(r.meeting_id, []).append(tuple(r[c] for c in cols))
    return out


def test_merge_short_turns_equals_loop(talk):
    want = {}
    for m, rows in meetings(talk, "seg_id", "speaker", "text").items():
        out = [list(rows[0])]
        for s, who, t in rows[1:]:
            if who is not None and who == out[-1][1] and len(out[-1][2].split()) < 10:
                out[-1][2] += " " + t
            else:
                out.append([s, who, t])
        want[m] = [tuple(x) for x in out]
    assert meetings(cl.merge_short_turns(talk), "seg_id", "speaker", "text") == want


def test_budget_chunks_equals_loop(talk):
    want = {}
    for m, rows in meetings(talk, "seg_id", "text").items():
        no, size, out = 1, 0.0, []
        for i, (s, t) in enumerate(rows):
            cost = len(t.split()) * 1.33
            if size + cost > 40 and i:
                no, size = no + 1, 0.0
            size += cost
            out.append((s, no))
        want[m] = out
    assert meetings(wi.budget_chunks(talk, 40), "seg_id", "chunk_no") == want


def test_overlap_chunks_cover_the_text(spark):
    text = "".join(random.Random(5).choice("ab c.\n") for _ in range(900))
    rows = wi.overlap_chunks(spark.createDataFrame([(1, text), (2, "short"), (3, "x" * 500)], "k int, text string"), "k", 100, 20).collect()
    for k, whole in ((1, text), (2, "short"), (3, "x" * 500)):
        parts = sorted((r.start, r.chunk) for r in rows if r.k == k)
        end = 0
        for start, chunk in parts:
            assert start <= end and whole[start : start + len(chunk)] == chunk and len(chunk) <= 100
            end = max(end, start + len(chunk))
        assert end == len(whole)


def test_contains_pairs_equals_brute_force(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    hay = [(m, i, " ".join(word() for _ in range(rnd.randint(1, 12)))) for m in range(3) for i in range(25)]
    needles = []
    for m in range(3):
        for i in range(60):
            source = rnd.choice([h for h in hay if h[0] == m])[2]
            a = rnd.randint(0, len(source) - 1)
            cut = source[a : a + rnd.randint(1, 20)] if i % 4 else word()
            needles.append((m, i, cut if cut.strip() else word()))
    n = spark.createDataFrame(needles, "m int, n int, needle string")
    h = spark.createDataFrame(hay, "m int, h int, text string")
    got = {tuple(r) for r in contains_pairs(n, "n", "needle", h, "h", "text", ["m"]).collect()}
    assert got == {(a[0], a[1], b[1]) for a in needles for b in hay if a[0] == b[0] and a[2] in b[2]}


def test_near_duplicates_equal_greedy_loop(spark):
    rnd = random.Random(11)
    rows = [(m, i, [rnd.gauss(0, 1) for _ in range(4)], rnd.random()) for m in range(2) for i in range(40)]
    rows += [(0, 40 + i, rows[i][2], 0.1) for i in range(5)]
    df = spark.createDataFrame(rows, "meeting_id long, item_id long, vec array<double>, confidence double")
    got = {(r.meeting_id, r.item_id): r.leader for r in dd.near_duplicate_groups(df, ["meeting_id"], "item_id", "vec", 0.6).collect()}

    def cos(a, b):
        d = sum(x * y for x, y in zip(a, b))
        return d / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    want = {}
    for m in range(2):
        mine = [(i, v) for mm, i, v, _ in rows if mm == m]
        for i, v in mine:
            if (m, i) in want:
                continue
            want[m, i] = i
            for j, u in mine:
                if j > i and (m, j) not in want and cos(v, u) > 0.6:
                    want[m, j] = i
    assert got == want
    merged = dd.near_duplicate_merge(df, 0.6)
    assert merged.count() == len({(m, leader) for (m, _), leader in want.items()})


def test_rouge_l_against_table(spark):
    rnd = random.Random(13)
    pairs = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 15))), " ".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 15)))) for i in range(60)]
    got = {r.k: r for r in sm.rouge_l(spark.createDataFrame(pairs, "k int, summary string, source string"), "k").collect()}
    for k, a, b in pairs:
        x, y = a.split(), b.split()
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        assert got[k].rouge_l_p == pytest.approx(t[-1][-1] / len(x)) and got[k].rouge_l_r == pytest.approx(t[-1][-1] / len(y))


def test_mentions_do_not_overlap(spark):
    texts = ["Dr. Ann Lee will meet Bob Stone by Friday, in 3 days, at 5:30 pm", "due by October 15, 2025 or before next week, EOD, every Monday", "Project Apollo has a budget of $45,000 by end of month"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "meeting_id int, seg_id int, text string")
    ref = F.lit("2025-03-14 10:30:00").cast("timestamp")
    for found in (mn.temporal_mentions(df, ref), mn.entity_mentions(df)):
        rows = found.collect()
        assert rows
        for r in rows:
            assert texts[r.seg_id][r.start : r.end].strip() == r.text.strip()
            for q in rows:
                assert q is r or q.seg_id != r.seg_id or q.end <= r.start or q.start >= r.end


def test_text_rules(spark):
    df = spark.createDataFrame([("yeah yeah it it is fine",), ("so we met what is the plan for the next big release however we wait and then stop",)], "t string")
    once = [r[0] for r in df.select(tx.collapse_repeats(F.col("t"))).collect()]
    assert once[0] == "yeah it is fine"
    for (p,) in df.select(tx.restore_punctuation(F.col("t"))).collect():
        assert p[0].isupper() and p[-1] in ".?!"


def test_topup_only_below_limit(spark):
    rows = [(1, i, "Ann", f"We decided point {i} today") for i in range(4)] + [(1, 9, "Ann", "the decision stands")]
    rows += [(2, 0, "Ann", "We decided this one today"), (2, 1, "Bob", "the decision stands")]
    df = spark.createDataFrame(rows, "meeting_id long, seg_id long, speaker string, text string")
    got = ex.extract_decisions_from_intents(df).groupBy("meeting_id").count().collect()
    assert {r.meeting_id: r["count"] for r in got} == {1: 4, 2: 2}


def test_weights_given_by_the_caller(spark):
    df = spark.createDataFrame([(1, "llm", "summary", "clarity", 4.0, ""), (1, "human", "summary", "clarity", 8.0, "")], "job_id long, source string, component string, criterion string, score double, explanation string")
    assert ev.weighted_criterion_scores(df, {"llm": 1.0, "human": 3.0}).first().score == pytest.approx(7.0)
    assert ev.weighted_criterion_scores(df).first().score == pytest.approx(6.0)


def test_nearest_intents_take_every_label(spark):
    rows = [(i, [1.0 if d == i else 0.0 for d in range(12)]) for i in range(12)]
    e = spark.createDataFrame(rows, "label int, vec array<float>")
    got = sm.nearest_intents(e.withColumnRenamed("label", "seg_id"), sm.intent_centroids(e)).collect()
    assert {(r.seg_id, tuple(r.intents), r.confidence) for r in got} == {(i, (str(i),), 1.0) for i in range(12)}
    listed = sm.nearest_intents(e.withColumnRenamed("label", "seg_id"), sm.intent_centroids(e), [11, 0], above=-1.0).first()
    assert listed.intents == ["11", "0"]
