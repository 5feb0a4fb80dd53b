"""The corpus pipeline on a small fixture: planted copies, passages and leaks go, clean documents stay."""

import random

import corpus_pipeline


def test_pipeline_drops_what_is_planted_and_keeps_the_rest(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    clean = {i: text(120) for i in range(20)}
    item, passage = text(30), text(60)
    rows = {i: " ".join(w) for i, w in clean.items()}
    rows[20] = rows[3]
    rows[21] = " ".join(clean[4][:60] + ["new"] + clean[4][60:])
    rows[22] = " ".join(text(50) + item + text(50))
    rows[23] = " ".join(text(40) + passage + text(40))
    rows[24] = " ".join(text(40) + passage + text(40))
    rows[25], rows[26] = None, "12345 67890"
    table = [(i, t, "en", "s", len(t or ""), "extra") for i, t in rows.items()]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == {*range(20), 23, 24}
    assert all(kept[i] == rows[i] for i in (*range(20), 23)) and len(kept[24].split()) == 80
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
