"""Periodic runs, MinHash join and collocations against brute force, and on nulls, blanks, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from colloquy.llm import collocations, jaccard_join, minhash_join, periodic_runs
from colloquy.llm.words import words_of

SCHEMA = "doc_id bigint, text string, lang string, runs string, words int, shard string, sid int, mark string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2, "z") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# ---- periodic runs

def brute_runs(words):
    found = {}
    for lag in range(1, len(words)):
        i = lag
        while i < len(words):
            first = i
            while i < len(words) and words[i] == words[i - lag]:
                i += 1
            length = i - first + lag
            if i > first and length >= max(6, 4 * lag):
                found[first - lag, length] = min(lag, found.get((first - lag, length), lag))
            i = max(i, first + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def noisy(rng, kinds, most):
    words = [rng.choice("abcdefgh"[:kinds]) for _ in range(rng.randint(0, most))]
    if words and rng.random() < 0.7:
        p = rng.randint(1, len(words))
        s = rng.randint(0, len(words) - p)
        words = words[:s] + words[s:s + p] * rng.randint(2, 9) + words[s:]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        docs = [noisy(rng, rng.choice([1, 2, 3, 8]), 30) * rng.choice([1, 1, 3, 5]) for _ in range(3)]
        found = periodic_runs.runs_of(words_of([" ".join(w).encode() for w in docs]), 6, 4)
        for d, words in enumerate(docs):
            assert [tuple(r[1:]) for r in found[found[:, 0] == d].tolist()] == brute_runs(words)


def test_run_digests_with_planted_repeats(spark, empty):
    rng = random.Random(4)
    texts = [rng.choice([" ", "\n\t", "\x0b"]).join(noisy(rng, 4, 60)) for _ in range(150)]
    texts += [None, "", " \n", "word " * 4000, " ".join(f"w{i}" for i in range(5000)), "é ü " * 30]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(7, texts[9], "fr"), (7, texts[9], "fr"), (None, "a b " * 9, None), (None, None, None)]
    want = Counter()
    for i, t, _ in rows:
        words = (t or "").encode().split()
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p if k >= a else k] for k in range(n)]
        runs = brute_runs(words) if len(set(words)) > 1 and len(words) < 1000 else [(0, len(words), 1)] if len(set(words)) == 1 and len(words) > 5 else []
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want[(i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
              hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
              hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())] += 1
    run = lambda df: periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_repeats(df)))
    assert Counter(tuple(r) for r in run(table(spark, rows)).collect()) == want
    assert run(empty).count() == 0
    plain = {r.id: r for r in periodic_runs.periodic_runs(table(spark, rows[:3] + [(9, None, "en")])).collect()}
    assert plain[9].collapsed is None and plain[9].n_words == 0 and plain[9].runs == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(empty, min_exponent=2)


# ---- MinHash join

def shingles(text, size):
    words = re.findall(rb"[^ \t-\r]+", (text or "").encode())
    words = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in words]
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and both * den >= num * (len(sets[x]) + len(sets[y]) - both):
                up[top(x)] = top(y)
    least = defaultdict(lambda: None)
    for x, (i, _) in enumerate(rows):
        if i is not None and (least[top(x)] is None or i < least[top(x)]):
            least[top(x)] = i
    return Counter((i, len(sets[x]), least[top(x)] if sets[x] else i) for x, (i, _) in enumerate(rows))


def near_copies(seed, groups, copies, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(*length))]
        for _ in range(rng.choice(copies)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy).replace("a", rng.choice("aaA")))
    return texts + [None, "", " \t", "one", "one two", "ONE two", "word " * 3000]


@pytest.mark.parametrize("tile", [1 << 14, 3])
def test_minhash_components_equal_brute_force(spark, empty, monkeypatch, tile):
    monkeypatch.setattr(minhash_join, "LIST_TILE", tile)
    texts = near_copies(5, 25, [1, 2, 5, 12], (20, 160))
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[4]), (None, texts[5]), (None, texts[5]), (None, texts[40]), (None, None)]
    got = minhash_join.near_duplicates(table(spark, [(i, t, "en") for i, t in rows]))
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 5, 17, 20)
    assert minhash_join.near_duplicates(empty).count() == 0


def test_many_rows_without_ids(spark):
    """Near copies and exact copies of null id: the work grows with the rows, not with their square."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    texts = []
    for k in range(4000):
        copy = list(base)
        copy[k % 120] = f"x{k // 2}"
        texts.append(" ".join(copy))
    docs = table(spark, [(None, t, "en") for t in texts] + [(5, texts[0], "en")])
    for find in (minhash_join.near_duplicates, jaccard_join.link_components):
        got = Counter((r.id, r.component_id, r.set_id is not None) for r in find(docs).collect())
        assert got == {(None, 5, True): 4000, (5, 5, True): 1}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    pairs = [(np.unique(pool[:2000]), np.unique(pool[k:2000 + k])) for k in (0, 150, 600)]
    for (x, y), k in zip(pairs, (0, 150, 600), strict=True):
        a, b = minhash_join.signatures([x, y], 512)
        assert abs((a == b).mean() - (2000 - k) / (2000 + k)) < 0.07


# ---- collocations

def test_double_array_walk_equals_lookup():
    rng = random.Random(2)
    for _ in range(60):
        kinds, depth = rng.choice([2, 5, 50, 400]), rng.randint(1, 5)
        phrases = np.array(sorted({tuple(int(rng.paretovariate(.7)) % kinds + 1 for _ in range(depth)) for _ in range(rng.choice([1, 3, 30, 500]))}), np.int32)
        alphabet, local = np.unique(phrases, return_inverse=True)
        arrays = collocations.double_array(local.reshape(phrases.shape) + 1)
        x = np.array([int(rng.paretovariate(.7)) % (kinds + 1) for _ in range(2000)] + [0], np.int32)
        at, row = collocations.walk(x, (0, depth, alphabet.astype(np.int32), phrases.ravel(), *arrays))
        number = {tuple(p): i for i, p in enumerate(phrases.tolist())}
        seen = [(i, number[tuple(x[i:i + depth].tolist())]) for i in range(len(x) - depth) if tuple(x[i:i + depth].tolist()) in number]
        assert seen == list(zip(at.tolist(), row.tolist(), strict=True))


def brute_collocations(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if a >= least}
        longer = Counter()
        for p, a in often.items():
            for k in range(1, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        found = []
        for p, a in often.items():
            if len(p) > 1 and longer[p] < a:
                score, _, l, r = min((1000 * a * n[lang] // (often[p[:k]] * often[p[k:]]), k, often[p[:k]], often[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard,top", [(1 << 19, 2000), (7, 9)])
def test_collocations_equal_brute_force(spark, empty, shard, top):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(25)] + ["New", "york", "city", "é", "naïve", "*"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randint(0, 25)):
            words += rng.choice([[rng.choice(vocabulary[:31])], ["New", "york"], ["big", "New", "york", "city", "hall"], ["of", "of", "of"]])
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "!\x0b", " "]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und", ""])))
    rows += [(1, None, "en"), (2, "", None), (3, "only " * 500, "xx"), (None, rows[5][1], "en"), rows[6], rows[6]]
    got = collocations.collocations(table(spark, rows).repartition(3), least=12, top=top, shard=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 12, 5, top)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(table(spark, [(1, "a b", "en"), (2, None, None)])).count() == 0
