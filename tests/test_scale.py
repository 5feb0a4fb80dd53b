"""Plans that must not lean on the sizes of compressed files, and results over small tiles."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import provenance as pv
from colloquy.operators.speakers import mention_edges

SEGMENT = "meeting_id long, seg_id long, speaker string, ts_raw string, start_s double, text string"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Segments and items in files that are small on disk."""
    folder = str(tmp_path_factory.mktemp("scale"))
    rng = random.Random(1)
    rows = [(m, s, rng.choice(["Ann", "Bob", None]), "0:01", 0.0, " ".join(rng.choices(["Ann", "bob", "plan", "a", "the", "budget", "Lot"], k=rng.randint(0, 12))))
            for m in range(3) for s in range(40)]
    spark.createDataFrame(rows, SEGMENT).write.parquet(f"{folder}/segments")
    segments = spark.read.parquet(f"{folder}/segments")
    items = segments.filter("seg_id % 3 = 0").select("meeting_id", F.lit("decision").alias("kind"), F.col("seg_id").alias("item_id"), "text")
    items.write.parquet(f"{folder}/items")
    return spark.read.parquet(f"{folder}/items"), segments


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_provenance_broadcasts_nothing(files):
    assert "Broadcast" not in planned(pv.link_provenance_lexical(*files))


def test_provenance_over_tiles_equals_all_pairs(files):
    items, segments = files
    want = []
    for i in items.collect():
        a = set(i.text.lower().split())
        found = []
        for s in segments.filter(F.col("meeting_id") == i.meeting_id).collect() if a else []:
            b = set(s.text.lower().split())
            if len(a & b) / len(a | b) > 0.3:
                found.append((-len(a & b) / len(a | b), s.seg_id))
        want += [(i.meeting_id, i.item_id, rank, seg, -sim) for rank, (sim, seg) in enumerate(sorted(found)[:3], 1)]
    for tile in (2, 1024):
        got = pv.link_provenance_lexical(items, segments, 0.3, tile=tile)
        assert sorted((r.meeting_id, r.item_id, r["rank"], r.seg_id, r.similarity) for r in got.collect()) == sorted(want)


def sources(items, segments, above, top=3):
    """The best segments of every item by all pairs, without those that have no id."""
    out = []
    for i in items.collect():
        a, found = set(i.text.lower().split()), []
        for s in segments.filter((F.col("meeting_id") == i.meeting_id) & F.col("seg_id").isNotNull()).collect():
            b = set((s.text or "").lower().split())
            if len(a & b) / len(a | b) > above:
                found.append((-len(a & b) / len(a | b), s.seg_id))
        out += [(i.meeting_id, i.kind, i.item_id, seg, -sim) for sim, seg in sorted(found)[:top]]
    return sorted(out)


def test_repeated_segments_push_no_source_out(spark):
    texts = [(4, "Plan a"), (4, "plan a"), (7, "plan a b"), (None, "a plan"), (9, "lot c"), (9, "lot c"), (9, "lot d"), (9, None)] + [(None, "lot c")] * 9
    segments = spark.createDataFrame([(1, n, t) for n, t in texts], "meeting_id long, seg_id long, text string")
    items = spark.createDataFrame([(1, "risk", 1, "a plan"), (1, "risk", 2, "the lot c"), (1, "risk", 3, "b"), (2, "risk", 1, "a plan")], "meeting_id long, kind string, item_id long, text string")
    for tile in (1, 1024):
        for top in (1, 2, 3, 9):
            got = pv.link_provenance_lexical(items, segments, tile=tile, top=top).select("meeting_id", "kind", "item_id", "seg_id", "similarity").collect()
            assert sorted(map(tuple, got)) == sources(items, segments, 0.1, top)


def test_topk_sources_has_three_an_item(spark, tmp_path):
    from colloquy.plans.catalog import Tables
    from colloquy.plans.registry import QUERIES

    rows = [(m, t, "user", f"lot {t} is late") for m in (2, 3) for t in (*range(17), 6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    tables = Tables(spark, str(tmp_path))
    got = [tuple(r) for r in QUERIES["topk_sources"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sources(tables.items, tables.segments, 0.1)
    assert sorted(r[3] for r in got if r[:3] == (2, "risk", 2)) == [2, 6, 6]


def test_mentions_broadcast_nothing(files):
    assert "Broadcast" not in planned(mention_edges(files[1]))


def test_pair_scores_stay_in_the_row(spark):
    """Coverage and ROUGE against counted tokens, without a shuffle; a missing or empty text scores nothing."""
    import math
    import re
    from collections import Counter

    from colloquy.operators import summaries as sm

    rng = random.Random(2)
    some = lambda: " ".join(rng.choices(["Plan", "plan", "a", "budget", "b2", "the", "--"], k=rng.randint(0, 15)))
    texts = {i: (some(), some()) for i in range(60)} | {60: (None, "plan"), 61: ("plan a", None), 62: (None, None)}
    pairs = spark.createDataFrame([(i, *t) for i, t in texts.items()], "doc_id long, source string, summary string")
    runs = [sm.summary_coverage(pairs, "doc_id"), sm.rouge_n(pairs, "doc_id", 1), sm.rouge_n(pairs, "doc_id", 2)]
    assert not any("Exchange" in planned(r) for r in runs)
    cover, *rouge = ({r.doc_id: r for r in run.collect()} for run in runs)
    for i, (a, b) in texts.items():
        s, m = (Counter(re.findall(r"\w{2,}", (x or "").lower())) for x in (a, b))
        w = {t: 1 + math.log(3 / (1 + (t in s) + (t in m))) for t in s | m}
        norm = math.sqrt(sum((s[t] * w[t]) ** 2 for t in w) * sum((m[t] * w[t]) ** 2 for t in w))
        words = [set((x or "").lower().split()) for x in (a, b)]
        assert cover[i].tfidf_similarity == pytest.approx(sum(s[t] * m[t] * w[t] ** 2 for t in w) / norm if norm else 0)
        assert cover[i].token_overlap == pytest.approx(len(words[0] & words[1]) / len(words[0]) if words[0] else 0)
        for n, got in enumerate(rouge, 1):
            p, r = ([tuple(x[k:k + n]) for k in range(len(x) - n + 1)] for x in (re.findall("[a-z0-9]+", (x or "").lower()) for x in (b, a)))
            hits = sum((Counter(p) & Counter(r)).values())
            assert got[i][f"rouge_{n}_p"] == pytest.approx(hits / len(p) if p else 0) and got[i][f"rouge_{n}_r"] == pytest.approx(hits / len(r) if r else 0)


def test_windows_are_cut_without_whole_columns(spark):
    from colloquy.operators.windows import overlap_chunks

    texts = spark.createDataFrame([(1, "ab. cd. efghij"), (2, None), (3, "")], "doc_id long, text string")
    got = overlap_chunks(texts, "doc_id", 6, 1)
    assert "MapInArrow" in planned(got) and "ArrowEvalPython" not in planned(got)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, "ab."), (1, 1, 2, ". cd."), (1, 2, 6, ". efgh"), (1, 3, 11, "hij"), (3, 0, 0, "")]


def test_phrases_found_leave_in_small_batches(monkeypatch):
    import pyarrow as pa

    from colloquy.operators import containment

    monkeypatch.setattr(containment, "TILE_CHARS", 8)
    rows = [(1, 64, 0, ["plan", "lot"], "the plan"), (1, 64, 0, ["plan", "lot"], "a lot, a plan"), (2, 64, 0, ["lot"], "plan"), (2, 64, 1, ["plan"], "plan")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["meeting_id", "width", "tile", "needles", "text"])
    got = list(containment._search()([batch]))
    assert len(got) == 2
    assert sorted(tuple(r.values()) for b in got for r in b.to_pylist()) == [(1, "lot"), (1, "plan"), (1, "plan"), (2, "plan")]


@pytest.fixture(scope="module")
def jobs_of_a_run(spark):
    """What each stored step of a run is planned as, and the run's metrics."""
    from colloquy.operators import containment, evaluation, provenance, summaries
    from colloquy.plans import flow
    from colloquy.plans.catalog import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    summary, gold = tables.read("documents").selectExpr("doc_id AS meeting_id", "text"), tables.gold
    plans, patch = [], pytest.MonkeyPatch()

    def noted(df, stored=flow.materialize):
        plans.append(planned(df))
        return stored(df)

    for module in (flow, containment, evaluation, provenance, summaries):
        patch.setattr(module, "materialize", noted, raising=False)
    metrics = flow.metric_table(flow.extract_all(tables.segments), tables.segments, gold, summary)
    patch.undo()
    return plans, metrics


def test_no_job_of_a_run_is_a_large_plan(jobs_of_a_run):
    """A plan is planned anew after each of its stages, so its size, not the data, decides what the driver needs."""
    plans, metrics = jobs_of_a_run
    assert max(p.count("Exchange ") for p in plans) <= 25
    assert "Exchange" not in planned(metrics)
    assert metrics.filter("metric = 'quality'").count() > 0


def test_no_job_of_a_run_sends_bloom_filters(jobs_of_a_run):
    """Spark gives joins of small filtered tables with stored joins, whose size it overrates, a Bloom filter that goes into every task."""
    assert not [p for p in jobs_of_a_run[0] if "might_contain" in p]


def test_gold_of_spaces_or_nothing_matches_nothing(spark):
    from colloquy.operators.evaluation import match_items_to_gold

    items = spark.createDataFrame([(1, "risk", 1, "Late Plan"), (1, "risk", 2, ""), (1, "risk", 3, None), (1, "risk", 4, "x")], "meeting_id long, kind string, item_id long, text string")
    gold = spark.createDataFrame([(1, "risk", 1, "the late plan fails"), (1, "risk", 2, ""), (1, "risk", 3, None)], "meeting_id long, kind string, gold_id long, text string")
    assert [r.item_id for r in match_items_to_gold(items, gold).collect()] == [1]


def test_a_run_has_few_shuffles(jobs_of_a_run):
    """Every shuffle costs the driver plans, generated code and threads, whatever the data: 86 of them before."""
    plans, _ = jobs_of_a_run
    assert sum(p.count("Exchange ") for p in plans) <= 75


def test_metrics_do_not_run_what_only_the_meetings_need(jobs_of_a_run):
    """Duration, type and topic of meetings are no metric."""
    assert not [p for p in jobs_of_a_run[0] if "main_topic" in p]


def test_items_that_are_never_boosted_need_no_join(jobs_of_a_run):
    """Only the confidence of decisions depends on their links."""
    assert not [p for p in jobs_of_a_run[0] if "due_date" in p and "Join" in p]


def test_a_chunk_of_a_summary_is_shuffled_once(spark):
    from colloquy.operators.summaries import extractive_summary

    segments = spark.createDataFrame([(1, s, f"We plan lot {s}. Lot {s % 3} is late. ...") for s in range(30)], "meeting_id long, seg_id long, text string")
    assert planned(extractive_summary(segments, chunk_words=20)).count("Exchange ") <= 5
