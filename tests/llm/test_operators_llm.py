"""Training-data operators against brute force, and on nulls, blanks, ties, repeats, empty tables and clashing names."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import (decontamination, html_extract, jaccard_join, language_id, license_scan, packing, quality_rules, substring_dedup, token_counts,
                          tokens, url_filter)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, batch int, `key` string, n int"


def rows_of(seed=0, count=60):
    """Documents with exact and near copies, shared passages, blanks, nulls and columns whose names operators also use."""
    rng = random.Random(seed)
    words = ["Ka", "lo", "mi", "ter", "an", "der", "vo", "sel", "ru", "pha", "dé", "the", "of", "and"]
    passage = [rng.choice(words) + str(i) for i in range(30)]
    texts = []
    for i in range(count):
        w = [rng.choice(words) + rng.choice(["", "x", "y"]) for _ in range(rng.choice([0, 1, 4, 20, 90, 200]))]
        if i % 5 == 0 and texts:
            w = (texts[rng.randrange(len(texts))] or "").split()
        if i % 7 == 0 and len(w) > 30:
            w[rng.randrange(len(w))] = "edit"
        if i % 4 == 1:
            w = w[:10] + passage + w[10:]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += [None, "", " \n\t", "a\x0bb\x0cc", "word " * 3000]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None]), len(t or ""), 1, "k", 2) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[9], "en", "s0", 1, 1, "k", 2), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_substring_dedup_equals_brute_force(docs, empty):
    last = 1 << 62
    first = {}
    for r in rows_of():
        w = split(r[1])
        for p in range(len(w) - 12):
            k = tuple(w[p:p + 13])
            first[k] = min(first.get(k, last), last if r[0] is None else r[0])
    want = Counter()
    for r in rows_of():
        w, gone = split(r[1]), set()
        for p in range(len(w) - 12):
            if first[tuple(w[p:p + 13])] < (last if r[0] is None else r[0]):
                gone.update(range(p, p + 13))
        want[(r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())] += 1
    got = Counter((r.id, r.n_words, sum(x["count"] for x in r.removed), hashlib.sha256((r.kept or "").encode()).hexdigest())
                  for r in substring_dedup.remove_repeats(docs, carry=["batch", "n"]).collect())
    assert got == want
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("size,threshold,tile", [(3, (9, 10), 512), (5, (4, 5), 2)])
def test_jaccard_components_equal_brute_force(docs, empty, monkeypatch, size, threshold, tile):
    monkeypatch.setattr(jaccard_join, "LEADER_TILE", tile)
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    rows = [r for r in rows_of() if r[0] is not None]
    sets = []
    for r in rows:
        w = (r[1] or "").encode().translate(low).split()
        sets.append({tuple(w[p:p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) * threshold[1] >= threshold[0] * len(a | b):
                head[find(i)] = find(j)
    group = {}
    for i, r in enumerate(rows):
        group[find(i)] = min(group.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), group[find(i)]) for i, r in enumerate(rows))
    got = jaccard_join.link_components(docs, size=size, threshold=threshold).filter("id is not null").collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard_join.link_components(empty).count() == 0


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokens.public_path()), tokens.WordIds(tokens.public_path())
    for text in ["don't DON'T <|endoftext|>x <|ENDOFTEXT|> a.,b 12ab ÀÉ×÷ ªº µ İ Σς é", "a b\x1cd\x85e\x0b\x0cf", "#$%'s 'LL i'm' ###$$$", "中文 😀", ""]:
        assert own.text_ids(text.encode()) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_word_ends_and_small_letters_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokens.public_path()), tokens.WordIds(tokens.public_path())
    rng = random.Random(11)
    letters = ["a", "b", "th", "é", "ß", "ÿ", "É", "Ö", "×", "÷", "e\u0301", "\u0338", "ñ", "7", "'s", "'", "ª", "İ", "ſ"]
    marks = [",", ".", "###", "$$$", "&&&", "%%%", "!?", "(", "*", "-", "'", "’", "<|", "|>"]
    texts = []
    for _ in range(1500):
        words = ["".join(rng.choices(letters, k=rng.randint(0, 5)) + rng.choices(marks, k=rng.choice([0, 0, 1, 2])) + rng.choices(letters, k=rng.choice([0, 0, 1])))
                 for _ in range(rng.randint(0, 8))]
        texts.append(" ".join(words))
    got = own.texts_ids([t.encode() for t in texts])
    assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_merges_of_the_vocabulary_agree_with_least_ids():
    """What makes merging by least id the same as merging in the file's order (see tokens.py), over the whole file."""
    with open(tokens.public_path(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, merges = model["vocab"], [tuple(m) for m in model["merges"]]
    ids = [vocabulary[a + b] for a, b in merges]
    assert ids == sorted(set(ids))
    assert max(i for w, i in vocabulary.items() if len(w.removesuffix("</w>")) == 1) < ids[0]
    rank = {m: i for i, m in enumerate(merges)}
    for a, b in merges:
        body = list((a + b).removesuffix("</w>"))
        body[-1] += "</w>" * b.endswith("</w>")
        while len(body) > 2:
            k = min(range(len(body) - 1), key=lambda i: rank.get((body[i], body[i + 1]), len(rank)))
            assert (body[k], body[k + 1]) in rank
            body[k:k + 2] = [body[k] + body[k + 1]]
        assert body == [a, b]


def test_words_of_letters_at_the_byte_limit():
    from tokenizers import Tokenizer
    whole, own, rng = Tokenizer.from_file(tokens.public_path()), tokens.WordIds(tokens.public_path()), np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeinrstàßöøÿ"), n)) for n in [*range(1, 60), 120, 127, 128, 255, 256, 257, 5000]]
    words += ["a" * n for n in (255, 256, 257, 40_000)] + ["ß" * 128, "ß" * 129]
    words += [w + m for w in words for m in (",", "...", "!?")]
    assert own.texts_ids([w.encode() for w in words]) == [np.array(whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]


def test_packing_is_whole_gapless_and_tight(docs, empty):
    got = packing.pack_documents(docs, capacity=256, keep_ids=True).collect()
    by_seq, own = {}, tokens.WordIds(tokens.public_path())
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(by_seq) <= -(-total // 256) + 1
    want = Counter((r[0], len(own.text_ids((r[1] or "").encode())) // 4 + 1) for r in rows_of() if r[0] is not None and r[0] != 3)
    mine = Counter()
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            mine[r.doc_id] += r.length
    assert Counter(mine.items()) == want
    assert packing.pack_documents(empty).count() == 0


def test_local_search_empties_a_bin():
    lengths = np.array([5, 4, 6, 2, 3])  # takes two exchanges and a move
    bins = packing.local_search([[0, 1], [2, 3], [4]], lengths, 10)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == list(range(5)) and all(lengths[b].sum() == 10 for b in bins)


def test_search_is_without_caps():
    """Tiny inputs against the fewest bins there are; no donor, size or pair is left out."""
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(1, 10) for _ in range(rng.randint(1, 8))]
        fewest = [0] + [99] * (2 ** len(sizes) - 1)
        for had in range(1, 2 ** len(sizes)):
            part = had
            while part:
                if sum(x for i, x in enumerate(sizes) if part >> i & 1) <= 10:
                    fewest[had] = min(fewest[had], fewest[had ^ part] + 1)
                part = (part - 1) & had
        lengths = np.array(sizes)
        bins = packing.local_search([[i] for i in range(len(sizes))], lengths, 10)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(lengths[b].sum() <= 10 for b in bins)
        assert len(packing.local_search(packing.best_fit(lengths, 10), lengths, 10)) <= fewest[-1] + (len(sizes) > 6)
    # the only exchange: a pair of the donor's 33rd and 34th sizes for the one document of a bin with a gap of one
    donor = [*range(1, 33), 100, 103]
    bins = packing.local_search([list(range(34)), [34], [35]], np.array([*donor, 202, 1999]), 2000)
    assert sum(np.array([*donor, 202, 1999])[b].sum() ** 2 for b in bins) > sum(donor) ** 2 + 202 ** 2 + 1999 ** 2


def test_pack_deals_evenly_and_keeps_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    rows = spark.range(0, 4096, 1, 64).selectExpr("id doc_id", "1 + id % 7 length", "id part", "'x' `open`", "-1L sequence_id", "'y' Offset", "id `a.b`")
    got = packing.pack(rows, 64).collect()
    assert sorted((r.doc_id, r.part, r.open, r["a.b"]) for r in got) == [(i, i, "x", i) for i in range(4096)]
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        assert sum(x for _, x in parts) <= 64 and sorted(parts)[0][0] == 0
    assert len(by_seq) <= -(-sum(r.length for r in got) // 64) + 1
    parts = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64).cast("bigint")).alias("p")).groupBy("p").count().collect()
    assert len(parts) == 64 and max(r["count"] for r in parts) < 128


def test_rollup_is_additive_and_idempotent(spark, docs, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path))
    change = lambda *rows: spark.createDataFrame(rows, "op string, source string, lang string, version string, tokens long, old_version string, old_tokens long")
    assert rollup.totals().count() == 0
    insert = change(("insert", "a", None, "1", 5, None, None), ("insert", "a", None, "1", None, None, None), ("insert", "b", "en", "1", 7, None, None))
    assert rollup.commit("x", insert) and not rollup.commit("x", insert)
    rollup.commit("y", change(("revise", "a", None, "2", 6, "1", 5), ("delete", "b", "en", "1", 7, None, None)))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", None, "1", 1, 0), ("a", None, "2", 1, 6)}
    withdrawn = spark.createDataFrame([(5,), (5,), (None,)], "doc_id long")
    got = {tuple(r) for r in token_counts.maintain(docs, withdrawn).collect()}
    own, want = tokens.WordIds(tokens.public_path()), {}
    for r in rows_of():
        if r[0] != 5:
            x = want.setdefault((r[3], r[2], "word_bpe_49k"), [0, 0])
            x[0] += 1
            x[1] += len(own.text_ids((r[1] or "").encode())) // 4
    assert got == {(*k, *v) for k, v in want.items()}


def test_license_scan_finds_edited_templates(spark, empty):
    filler = "the work of the license is here " * 40
    rows = [(1, filler + "Licensed under the Apache License, Version 2.0. " + filler), (2, "licensed UNDER the old Apache license version 2.0"), (3, filler), (4, None),
            (5, "Released under the MIT License.\n" * 2)]
    got = {(r.id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "Apache-2.0"), (2, "Apache-2.0"), (5, "MIT")}
    assert license_scan.scan(empty).count() == 0
    assert license_scan.patience([1, 2, 3, 4, 5], [1, 9, 3, 4, 9, 5]) == 4


def test_language_uses_text_declaration_and_host(spark, empty):
    texts = {"en": "the house and the garden of this town were old ", "fr": "la maison et le jardin de cette ville sont vieux ", "de": "das haus und der garten dieser stadt sind alt "}
    rows = [(i, texts[k] * 3, k, k + "-host", 1) for i, k in enumerate(list(texts) * 30)]
    rows += [(900, texts["fr"], "en", "fr-host", 1), (901, "1234 5678", "en", "x", 1), (902, None, "en", "x", 1), (903, "", None, None, 1), (None, texts["de"], None, None, 1)]
    got = {r.id: r for r in language_id.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, confidence int")).collect()}
    assert all(got[i].lang == r[2] and got[i].kept for i, r in enumerate(rows[:90]))
    assert got[900].lang == "fr" and got[None].lang == "de"
    assert not any(got[i].kept or got[i].lang for i in (901, 902, 903))
    assert language_id.identify_documents(empty).count() == 0


def test_language_tells_all_declared_languages_apart(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for k in range(270):  # the last ones are the rarest
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)]
        rows += [(3 * k + j, " ".join(rng.choices(own, k=40)), f"l{k:03}", None) for j in range(3 if k < 256 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in language_id.identify_documents(docs).collect()}
    assert all(got[i].text_lang == got[i].lang == lang and got[i].kept for i, _, lang, _ in rows)
    few = docs.filter("doc_id < 21")
    whole = {tuple(r) for r in language_id.identify_documents(few).collect()}
    monkeypatch.setattr(language_id, "BLOCK", 3)
    assert {tuple(r) for r in language_id.identify_documents(few).collect()} == whole


def test_url_rules_and_words(spark):
    urls = ["http://Example.COM/en/1", "https://www.example.com/en/2", "http://a.net/es/x?q", "http://a.net/en/x", "b.com/en", None, "ftp://x.org", "http://xcom/", "http://c.com#f"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://casinowin.net/es/{i}") for i in range(20)] + [(200 + i, f"http://gardenhouse.com/a/{i}") for i in range(20)]
    rows += [(300, "http://casino-win.org/es/1"), (301, "http://garden-house.org/a/1")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/2", "www.example.com/en/"), ("a.net", "/es/x", "net/es/"), ("a.net", "/en/x", None),
        ("", "", None), ("", "", None), ("x.org", "", None), ("xcom", "/", None), ("c.com", "", None)]
    assert got[300].verdict == "block" and got[301].verdict == "allow" and "casino" in got[300].words


def test_url_segmentation_splits_concatenated_names(spark):
    long = "internationalisations"
    rows = [(i, f"http://casinowin.org/x/{i}", "garden tools") for i in range(200)]  # the hot host
    rows += [(300 + i, f"http://casino-win{i}.net/es/{i}", "free bets") for i in range(3)] + [(400 + i, f"http://house{i}.com/a", "the garden house") for i in range(3)]
    rows += [(500, "http://freebets.org/x", None), (501, f"http://my{long}.org/x", long), (502, "http://zorbqutaplixvendoramukty.org/freebets", None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, title string"), texts=F.col("title")).collect()}
    assert {"casino", "win"} <= set(got[0].words) and "casinowin" not in got[0].words
    assert got[0].verdict == got[199].verdict == "block"
    assert {"free", "bets"} <= set(got[500].words) and {"free", "bets", "zorbqutaplixvendoramukty"} <= set(got[502].words)
    assert long in got[501].words


def test_html_extraction_on_held_out_pages(spark):
    pages = html_extract.labelled_pages(120, seed=5)
    table = spark.createDataFrame([(i, "u", p, "x") for i, (p, _) in enumerate(pages)] + [(900, None, None, "x"), (901, "u", "", "x"), (902, "u", "<p>cut <b", "x")],
                                  "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(table).collect()}
    assert sum(got[i] == t for i, (_, t) in enumerate(pages)) >= 0.85 * len(pages)
    assert got[900] == got[901] == ""
    page = "<nav><ul><li><a>x</a></li></ul></nav><article><h1>A &amp; b</h1><p><b>One  two.<br>three.<p>Four &lt;5.</p></article><footer>&copy; z</footer>"
    assert html_extract.main_text(page, html_extract.trained()) == "A & b\nOne two. three.\nFour <5."


def test_html_keeps_text_after_unclosed_and_self_closed_elements():
    text = lambda page: [t for t, _ in html_extract.leaf_blocks(page)]
    for tag in ("<svg width='3'/>", "<object data=x />", "<svg>", "<object>", "<noscript>", "<template>"):
        assert text(f"<p>One.</p>{tag}<p>Two.</p>{tag}<p>Three.</p>") == ["One.", "Two.", "Three."]
    assert text("<svg/><p>One.</p><svg><text>no</text></svg><p>Two.</p>") == ["One.", "Two."]
    assert text("<p>One.</p><script>var x; <p>Two.</p>") == ["One."] and text("<p>One.</p><style>p {} <p>Two.</p>") == ["One."]


def test_decontamination_finds_passages_and_paraphrases(spark, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    item = [word() for _ in range(30)]
    text = lambda n: [word() for _ in range(n)]
    near = [w for i, w in enumerate(item) if i % 4 or i >= 24]
    rows = [(1, " ".join(text(200) + item + text(100))), (2, " ".join(text(60) + near + text(60))), (3, " ".join(text(400))), (4, None), (5, ""), (6, " ".join(item[:9] + text(50))),
            (7, " ".join(rng.sample(item, 30)))]
    bench = spark.createDataFrame([(10, " ".join(item) + "."), (11, None), (12, "")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == {(1, 10), (2, 10)}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 and decontamination.contaminated(empty, bench).count() == 0
    a, b = [rng.randrange(5) for _ in range(40)], [rng.randrange(5) for _ in range(60)]
    table = np.zeros((41, 61), int)
    for i in range(40):
        for j in range(60):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    assert decontamination.common_length(np.array(a), np.array(b)) == table[40, 60]


def test_license_places_against_all_regions(spark):
    """Every template alone, all pairs side by side, and random texts against every region of the longest width."""
    names = sorted(license_scan.TEMPLATES)
    rows = [(i, f"so {license_scan.TEMPLATES[n]} and on") for i, n in enumerate(names)]
    pairs = [(a, b) for a in names for b in names]
    rows += [(100 + i, f"{license_scan.TEMPLATES[a]} then {license_scan.TEMPLATES[b]}") for i, (a, b) in enumerate(pairs)]
    rows += [(1000, "Released x x x under y y y the z z z MIT License"), (1001, "Licensed under nothing. Licensed under CC BY-SA 4.0")]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.id, []).append((r.first_word, r.license, r.coverage, r.last_word))
    for i, n in enumerate(names):
        assert [x[1:3] for x in got.pop(i)] == [(n, 1.0)]
    for i, (a, b) in enumerate(pairs):
        assert [x[1] for x in sorted(got.pop(100 + i))] == [a, b]
    assert got == {1000: [(0, "MIT", 1.0, 13)], 1001: [(3, "CC-BY-SA-4.0", 1.0, 9)]}
    rng = random.Random(9)
    templates = {"long": "a b c d e f", "part": "a b d e", "other": "e a a"}
    texts = [" ".join(rng.choices("abcdefxy", k=rng.randint(0, 14))) for _ in range(300)]
    found = {}
    for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates, least=0.75).collect():
        found.setdefault(r.id, []).append(r)
        own, part = templates[r.license].split(), texts[r.id].split()[r.first_word:r.last_word + 1]
        table = np.zeros((len(own) + 1, len(part) + 1), int)
        for i, x in enumerate(own):
            for j, y in enumerate(part):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert 0.75 <= r.coverage <= table[-1, -1] / len(own)
    hit = set()
    for d, text in enumerate(texts):
        words = [ord(x) for x in text.split()]
        for t in templates.values():
            own = [ord(x) for x in t.split()]
            if any(license_scan.patience(own, words[s:s + 4 * len(own)]) >= 0.75 * len(own) for s in range(len(words))):
                hit.add(d)
        spans = sorted((r.first_word, r.last_word) for r in found.get(d, []))
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert set(found) == hit and 20 < len(hit) < 300


def test_decontamination_compares_short_items_by_words(spark):
    number = lambda w: int(decontamination.word_numbers([w.encode()])[0][0])
    same = next(w for w in (f"w{i}" for i in range(10**6)) if number(w) == number("photosynthesis"))
    rows = [(1, f"found in the {same} of"), (2, "Found in the Photosynthesis, of"), (3, "a red fox"), (4, "a red"), (5, "fox a red"), (None, "A red fox."), (7, None)]
    bench = spark.createDataFrame([(1, "photosynthesis"), (2, "A red fox"), (3, "a RED fox!"), (None, "red fox"), (5, " ")], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.id, r.item_id, r.overlap) for r in got} == {(2, 1, 1.0)} | {(d, i, 1.0) for d in (3, None) for i in (2, 3, None)}


def test_decontamination_finds_evenly_stretched_paraphrases(spark):
    """Against the longest common subsequence with every passage; filler words are in no item."""
    rng = random.Random(3)
    word, fill = (lambda: "".join(rng.choices("abcdefghij", k=6))), (lambda: "".join(rng.choices("qrstuvwxyz", k=6)))
    items = {k: [word() for _ in range(n)] for k, n in enumerate([9, 17, 25, 33, 56, 57, 90, 130, 300])}
    docs, ids, want = [], [], set()
    for k, item in items.items():
        n = len(item)
        for share, end, shift in [(1.0, False, 0), (0.8, False, 3), (0.8, False, 5), (0.65, True, 1), (0.65, True, 6), (0.65, False, 2), (0.5, True, 4)]:
            tail = n - 6 if end else n
            take = sorted(rng.sample(range(tail), max(0, -int(-share * n // 1) - (n - tail)))) + list(range(tail, n))
            if not end:
                take = [i for i in take if i < n - 2] if share < 1 else take
            size = int(1.5 * n)
            text = [fill() for _ in range(size)]
            for j, i in enumerate(take):
                text[j * (size - 1) // max(1, len(take) - 1)] = item[i]
            docs.append([fill() for _ in range(40 + shift)] + text + [fill() for _ in range(100)])
    rows = []
    for d, text in enumerate(docs):
        rows.append((d, " ".join(text)))
        numbers = decontamination.word_numbers([" ".join(text).encode()])[0]
        for k, item in items.items():
            w = decontamination.word_numbers([" ".join(item).encode()])[0]
            parts = [numbers[i:i + int(1.5 * len(w)) + 2] for i in range(len(numbers))]
            held = [decontamination.common_length(w, p) for p in parts]
            good = [x for x, p in zip(held, parts, strict=True) if x >= 0.8 * len(w) or x >= 0.55 * len(w) and decontamination.common_length(w[-5:], p) >= 0.9 * 5]
            if good:
                want.add((d, None if k == 2 else k, round(max(good) / len(w), 9)))
    assert len(want) > 3 * len(items)
    bench = spark.createDataFrame([(None if k == 2 else k, " ".join(w), " ".join(w[-5:])) for k, w in items.items()], "item_id long, text string, answer string")
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.id, r.item_id, round(r.overlap, 9)) for r in got} == want


def test_quality_statistics_and_bounds(spark, docs, empty):
    for r in quality_rules.measure(docs).collect():
        text = next(x[1] for x in rows_of() if x[0] == r.doc_id)
        if r.doc_id is None:
            continue
        w = [x.decode() for x in split(text)]
        c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
    p = quality_rules.upper_bound(3, 200, 0.05)
    tail = sum(np.prod([(200 - i) / (i + 1) for i in range(k)]) * p**k * (1 - p) ** (200 - k) for k in range(4))
    assert abs(tail - 0.05) < 1e-6 and quality_rules.upper_bound(5, 5, 0.05) == 1.0
    body = " ".join(f"word{i}" for i in range(30))
    rows = [(i, body + (" ##$$ &&&& ####" if i % 3 == 0 else ""), "en") for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(3000)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    assert all(r.kept == (r.doc_id % 3 > 0) for r in got)
    assert quality_rules.judge(empty, labels).count() == 0
