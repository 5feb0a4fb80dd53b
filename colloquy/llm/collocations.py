"""Collocations: frequent phrases of two to five words whose parts meet far more often than chance, per language.

Method: level by level. Words of a language that occur often enough get consecutive numbers, and every text becomes one array
of these numbers, with 0 where a phrase cannot go on (a piece ends, or a rare word stands there). Phrases are dealt to shards of
bounded size; a task makes each shard a double-array trie, the tries are broadcast a few at a time, and every task advances the
states of all its text positions at once, one word a step. A level's candidates are Apriori-safe: a walk over the frequent
phrases of the level before notes which frequent word follows each, every task reports how often (up to the threshold), and
extensions that reach it together are candidates. So candidates are read off the texts and never made by joining all left with
all right neighbours of a common word. A second walk counts the candidates' accepting states exactly; the tasks' sums are added
in slices, in two steps.

Only shards reach the driver and the broadcasts: SHARD phrases or words each, SHARDS_AT_ONCE a pass; more phrases mean more
passes over the arrays of numbers. Scores use 38-digit whole numbers. A top list is cut in two steps, so that a language that
holds most phrases is not sorted in one task.

Defined cases: null text is empty; null language is `und`; a language without phrases gives no rows; an empty table gives no
rows; repeated rows count again; ids and other columns are not read. Words of any length count, as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm import shuffles
from colloquy.llm.words import SPACE, binary_list, chunks, from_planes, mix, pack_sorted, planes, unpack_sorted, words_of
from colloquy.session import materialize

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
GAP = BREAK | SPACE
SHARD = 1 << 19
SHARDS_AT_ONCE = 4
WORD_BUCKET = 1 << 16
TOP_SALT = 64
SLICE = 1 << 14
BUCKET_KEYS = 1 << 21


def _languages(lang: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Number, names and hashes of the languages of some rows."""
    names = ["und" if x is None else x for x in lang]
    kinds = sorted(set(names))
    number = {x: i for i, x in enumerate(kinds)}
    hashes = words_of([b"_" + x.encode().hex().encode() for x in kinds]).hash
    return np.fromiter((number[x] for x in names), np.int64, len(names)), kinds, hashes


def _keys(lang_hash: np.ndarray, word_hash: np.ndarray) -> np.ndarray:
    return mix(word_hash ^ mix(lang_hash + np.uint64(1))).view(np.int64)


def _word_counts(batches):
    """Per batch and language: key, bytes and count of every distinct word."""
    for batch in batches:
        texts = binary_list(batch.column(0))
        lang, kinds, hashes = _languages(batch.column(1).to_pylist())
        for lo, hi in chunks(texts, 1 << 22):
            words = words_of(texts[lo:hi], lower=True, space=GAP)
            of = lang[lo:hi][words.doc]
            key, first, count = np.unique(_keys(hashes[of], words.hash), return_index=True, return_counts=True)
            text = [words.data[i:j].tobytes() for i, j in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array([kinds[i] for i in of[first].tolist()], pa.string()), pa.array(text, pa.binary()).cast(pa.string()),
                 pa.array(count)], names=["key", "lang", "word", "a"])


def _encode(keys: np.ndarray, first_id: int, first: bool, last: bool):
    """Word numbers of texts, from one shard of the words; a later shard fills its numbers in."""

    def numbered(hashed: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        if len(keys):
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            hit = keys[at] == hashed
            ids[hit] = at[hit] + first_id
        if last:
            x = np.concatenate([np.zeros(1, np.int32), ids, np.zeros(1, np.int32)])
            ids = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        return pa.RecordBatch.from_arrays([pa.array([None if last else hashed.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())],
                                          names=["hashed", "ids"])

    def run(batches):
        for batch in batches:
            if not first:
                for hashed, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield numbered(np.frombuffer(hashed, np.int64), np.frombuffer(ids, np.int32).copy())
                continue
            texts = binary_list(batch.column(0))
            lang, _, hashes = _languages(batch.column(1).to_pylist())
            for lo, hi in chunks(texts):
                words = words_of(texts[lo:hi], lower=True, space=GAP)
                piece = np.cumsum(BREAK[words.data])[words.start]
                new = np.cumsum(np.diff(piece, prepend=piece[:1]) != 0)
                at = np.arange(len(piece)) + new
                hashed = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.int64)
                hashed[at] = _keys(hashes[lang[lo:hi][words.doc]], words.hash)
                yield numbered(hashed, np.zeros(len(hashed), np.int32))

    return run


def double_array(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, accept) of a trie over rows of equally many words 1 … top; the rows are sorted and distinct.

    A state s goes on with word x to t = base[s] + x if check[t] = s; accept[t] is the row that ends in t. The root is state
    0. On each level, nodes with several children are placed first, most children first; single children then fill the holes.
    check is longer than the states by `top`, so that any base + x lies inside.
    """
    rows, depth = phrases.shape
    top = int(phrases.max())
    room = top + rows * depth + 2
    base, check, accept, taken = np.zeros(room, np.int64), np.full(room, -1), np.full(room, -1), np.zeros(room, bool)
    taken[0] = True

    def reach(place: int) -> None:
        nonlocal base, check, accept, taken
        if place >= len(base):
            more = place + len(base) // 2
            base, check, accept, taken = (np.append(x, np.full(more, v, x.dtype)) for x, v in ((base, 0), (check, -1), (accept, -1), (taken, False)))

    state = np.zeros(rows, np.int64)  # where each row's prefix ends
    for level in range(depth):
        fresh = np.ones(rows, bool)  # first row of every prefix that is one word longer
        fresh[1:] = (state[1:] != state[:-1]) | (phrases[1:, level] != phrases[:-1, level])
        at = np.flatnonzero(fresh)
        parent, word = state[at], phrases[at, level].astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        count = np.diff(np.append(begin, len(parent)))
        place = np.zeros(len(at), np.int64)
        kind = start = 0
        for i in np.argsort(-count, kind="stable")[: int((count > 1).sum())]:
            kids = word[begin[i]:begin[i] + count[i]]
            if int(count[i]).bit_length() != kind:  # smaller nodes look through the holes again
                kind, start = int(count[i]).bit_length(), int(taken.argmin())
            start = max(start, int(kids[0]) + 1)
            spread, span, look = kids - kids[0], int(kids[-1] - kids[0]), 32
            while True:
                reach(start + look + span)
                free = ~taken[start:start + look]
                for off in spread[1:]:
                    free &= ~taken[start + off:start + off + look]
                    if not free.any():
                        break
                else:
                    start += int(free.argmax())
                    if free.any():
                        break
                start, look = start + look, min(2 * look, 4096)
            place[begin[i]:begin[i] + count[i]] = start + spread
            taken[start + spread] = True
        single = begin[count == 1]
        single = single[np.argsort(word[single], kind="stable")]
        if len(single):
            holes = np.flatnonzero(~taken)
            # the lowest ascending choice of holes behind each word; past the last hole there is room
            at_hole = np.searchsorted(holes, word[single] + 1) - np.arange(len(single))
            at_hole = np.maximum.accumulate(at_hole) + np.arange(len(single))
            over = max(len(taken), top + 1) - len(holes)
            place[single] = np.where(at_hole < len(holes), holes[np.minimum(at_hole, len(holes) - 1)] if len(holes) else 0, at_hole + over)
            reach(int(place[single].max()))
            taken[place[single]] = True
        base[parent] = place - word
        check[place] = parent
        state = place[np.cumsum(fresh) - 1]
    accept[state] = np.arange(rows)
    last = int(np.flatnonzero(taken)[-1]) + 1
    return base[:last].astype(np.int32), np.append(check[:last], np.full(top, -1)).astype(np.int32), accept[:last].astype(np.int32)


def _make_trie(table: pa.Table) -> pa.Table:
    """One shard's trie over its own alphabet, and its phrases in the order of their accepting numbers."""
    words = table["words"].combine_chunks()
    phrases = np.asarray(words.flatten()).reshape(len(words), -1)
    phrases = phrases[np.lexsort(phrases.T[::-1])]
    alphabet, local = np.unique(phrases, return_inverse=True)
    arrays = [alphabet, phrases, *double_array(local.reshape(phrases.shape) + 1)]
    return pa.table([table["shard"].combine_chunks().slice(0, 1), pa.array([phrases.shape[1]], pa.int32()),
                     *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in arrays]],
                    names=["shard", "depth", "alphabet", "phrases", "base", "check", "accept"])


def walk(x: np.ndarray, trie: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Places in an array of word numbers, ending with 0, where a phrase of the trie starts, and the phrase's row."""
    _, depth, alphabet, _, base, check, accept = trie
    own = np.minimum(np.searchsorted(alphabet, x), len(alphabet) - 1)
    own = np.where(alphabet[own] == x, own + 1, 0).astype(np.int32)
    at = np.flatnonzero(own)
    state = np.zeros(len(at), np.int32)
    for step in range(depth):
        word = own[at + step]
        go = base[state] + word
        ok = (word > 0) & (check[go] == state)
        at, state = at[ok], go[ok]
    return at, accept[state]


def _tries(sent: Broadcast) -> list[tuple]:
    return [(shard, depth, *[np.frombuffer(a, np.int32) for a in arrays]) for shard, depth, *arrays in sent.value]


def _count(sent: Broadcast):
    """Occurrences of every phrase in a partition, in slices of the shards' phrases."""

    def run(batches):
        tries = _tries(sent)
        sums = [np.zeros(len(t[3]) // t[1], np.int64) for t in tries]
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                for total, trie in zip(sums, tries, strict=True):
                    total += np.bincount(walk(np.frombuffer(ids, np.int32), trie)[1], minlength=len(total))
        salt = TaskContext.get().partitionId()
        for total, trie in zip(sums, tries, strict=True):
            parts = [planes(total[i:i + SLICE]) for i in range(0, len(total), SLICE) if total[i:i + SLICE].any()]
            where = [i // SLICE for i in range(0, len(total), SLICE) if total[i:i + SLICE].any()]
            yield pa.RecordBatch.from_arrays([pa.array([trie[0]] * len(parts), pa.int64()), pa.array(where, pa.int64()), pa.array([salt] * len(parts), pa.int64()),
                                              pa.array(parts, pa.binary())], names=["shard", "slice", "salt", "counts"])

    return run


def _add(table: pa.Table) -> pa.Table:
    """Sum of the count slices of a group."""
    total = None
    for blob in table["counts"].to_pylist():
        own = from_planes(blob, "<i8")
        total = own.copy() if total is None else total + own
    return pa.table([*[table[c].combine_chunks().slice(0, 1) for c in ("shard", "slice", "salt")], pa.array([planes(total)], pa.binary())],
                    names=["shard", "slice", "salt", "counts"])


def _extend(sent: Broadcast, least: int, bits: int):
    """Phrases of the tries (shard, row) with the word that follows, and how often a partition holds that, up to `least`: one row per hash bucket."""

    def run(batches):
        tries = _tries(sent)
        seen = [_Counts(least) for _ in tries]
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                x = np.frombuffer(ids, np.int32)
                for counts, trie in zip(seen, tries, strict=True):
                    at, row = walk(x, trie)
                    after = x[at + trie[1]]
                    counts.add((row[after > 0].astype(np.uint64) << np.uint64(32)) | after[after > 0].astype(np.uint64))
        for counts, trie in zip(seen, tries, strict=True):
            keys, many = counts.fold()
            bucket = (mix(keys) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, many, bucket = keys[order], many[order], bucket[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            for lo in range(0, len(cut) - 1, 256):
                parts = list(zip(cut[lo:lo + 256].tolist(), cut[lo + 1:lo + 257].tolist(), strict=False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([trie[0]] * len(parts), pa.int64()), pa.array([int(bucket[i]) for i, _ in parts], pa.int64()),
                     pa.array([pack_sorted(keys[i:j]) for i, j in parts], pa.binary()), pa.array([planes(many[i:j].astype("<u4")) for i, j in parts], pa.binary())],
                    names=["shard", "bucket", "keys", "counts"])

    return run


def _often(least: int):
    """Extensions of a bucket that all partitions together hold `least` times."""

    def run(table: pa.Table) -> pa.Table:
        counts = _Counts(least)
        for keys, many in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True):
            counts.add(unpack_sorted(keys), from_planes(many, "<u4"))
        keys, many = counts.fold()
        keys = keys[many >= least]
        return pa.table({"shard": pa.array(np.full(len(keys), table["shard"][0].as_py()), pa.int64()), "row": pa.array((keys >> np.uint64(32)).astype(np.int32)),
                         "word": pa.array(keys.astype(np.uint32).astype(np.int32))})

    return run


class _Counts:
    """Counts of numbers up to a limit, folded whenever as many new distinct ones wait as are held."""

    def __init__(self, limit: int) -> None:
        self.keys, self.counts, self.limit = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], limit

    def add(self, values: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            values, counts = np.unique(values, return_counts=True)
        self.keys.append(values)
        self.counts.append(counts)
        if sum(map(len, self.keys[1:])) > max(1 << 20, len(self.keys[0])):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(back, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts = [keys], [np.minimum(counts, self.limit)]
        return self.keys[0], self.counts[0]


def _named(batches):
    """Phrases of the tries by shard and row."""
    for batch in batches:
        for shard, depth, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = np.frombuffer(blob, np.int32).reshape(-1, depth)
            for i in range(0, len(words), SLICE):
                part = words[i:i + SLICE]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * depth), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard), pa.int64()), pa.array(np.arange(i, i + len(part), dtype=np.int32)), lists],
                                                 names=["shard", "row", "words"])


def _number(batches):
    """(shard, row, a) of count slices."""
    for batch in batches:
        for shard, slice_, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            total = from_planes(blob, "<i8")
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), shard), pa.int64()), pa.array((hit + slice_ * SLICE).astype(np.int32)), pa.array(total[hit])],
                                             names=["shard", "row", "a"])


def _tries_of(phrases: DataFrame, shard: int) -> tuple[DataFrame, int]:
    """One trie per shard of the phrases (arrays `words` of one length), and the number of shards."""
    rows = phrases.count()
    shards = 1 if rows <= shard else -(-2 * rows // shard)  # half full on average
    return materialize(phrases.select("words", F.pmod(F.xxhash64("words"), F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(
        _make_trie, "shard bigint, depth int, alphabet binary, phrases binary, base binary, check binary, accept binary")), shards


def _passes(texts: DataFrame, tries: DataFrame, shards: int, work, schema: str) -> DataFrame:
    """Rows of work(broadcast tries) over the texts, SHARDS_AT_ONCE shards a pass."""
    out = None
    for first in range(0, shards, SHARDS_AT_ONCE):
        some = tries.filter(F.col("shard").between(first, first + SHARDS_AT_ONCE - 1)).collect()
        sent = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in some])
        found = materialize(texts.mapInArrow(work(sent), schema))
        sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def extensions(texts: DataFrame, level: DataFrame, least: int, shard: int, words: int) -> DataFrame:
    """Candidates one word longer than the frequent phrases of `level`: arrays `words` that occur `least` times. `words` sizes the buckets."""
    tries, shards = _tries_of(level, shard)
    bits = shuffles.buckets(texts.sparkSession, words, BUCKET_KEYS).bit_length() - 1
    found = (_passes(texts, tries, shards, lambda sent: _extend(sent, least, bits), "shard bigint, bucket bigint, keys binary, counts binary")
             .groupBy("shard", "bucket").applyInArrow(_often(least), "shard bigint, row int, word int"))
    named = tries.select("shard", "depth", "phrases").mapInArrow(_named, "shard bigint, row int, words array<int>")
    return materialize(found.join(named, ["shard", "row"]).select(F.concat("words", F.array("word")).alias("words")))


def count_phrases(texts: DataFrame, candidates: DataFrame, shard: int) -> DataFrame:
    """(words, a) of all candidates that occur; candidates are distinct arrays `words` of one length."""
    tries, shards = _tries_of(candidates, shard)
    schema = "shard bigint, slice bigint, salt bigint, counts binary"
    sums = _passes(texts, tries, shards, _count, schema)
    salts = max(1, round(texts.rdd.getNumPartitions() ** 0.5))  # so many slices meet in a task, twice
    sums = sums.withColumn("salt", F.pmod("salt", F.lit(salts))).groupBy("shard", "slice", "salt").applyInArrow(_add, schema)
    sums = sums.groupBy("shard", "slice").applyInArrow(_add, schema).select("shard", "slice", "counts").mapInArrow(_number, "shard bigint, row int, a bigint")
    named = tries.select("shard", "depth", "phrases").mapInArrow(_named, "shard bigint, row int, words array<int>")
    return materialize(sums.join(named, ["shard", "row"]).select("words", "a"))


def frequent_words(docs: DataFrame, text_col: str, lang_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all languages, and (id, key, lang, word, a) of words with at least `least` occurrences, numbered from 1 by key."""
    counted = materialize(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
                          .mapInArrow(_word_counts, "key bigint, lang string, word string, a bigint")
                          .groupBy("key", "lang", "word").agg(F.sum("a").alias("a")))
    often = counted.filter(F.col("a") >= least)
    buckets = max(1, -(-often.count() // WORD_BUCKET))
    often = often.withColumn("bucket", F.floor((F.col("key").cast("double") / float(1 << 64) + 0.5) * buckets).cast("int"))
    starts = often.groupBy("bucket").count()
    starts = starts.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
    words = often.withColumn("rank", rank).join(starts, "bucket")
    return (materialize(counted.groupBy("lang").agg(F.sum("a").alias("n"))),
            materialize(words.select((F.col("start") + F.col("rank")).cast("int").alias("id"), "key", "lang", "word", "a")))


def numbered_texts(docs: DataFrame, words: DataFrame, text_col: str, lang_col: str, shard: int = SHARD) -> DataFrame:
    """Arrays of word numbers (int32), one for about a megabyte of text, each beginning and ending with 0."""
    out = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    total = words.count()
    for lo in range(0, max(1, total), shard):
        keys = np.sort(words.filter(F.col("id").between(lo + 1, lo + shard)).select("key").toArrow()["key"].to_numpy())
        out = materialize(out.mapInArrow(_encode(keys, lo + 1, lo == 0, lo + shard >= total), "hashed binary, ids binary"))
    return out.select("ids")


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, least: int, longest: int, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), the frequent words, and (words, a) of all phrases up to `longest` words that occur at least `least` times."""
    total, words = frequent_words(docs, text_col, lang_col, least)
    texts = numbered_texts(docs, words, text_col, lang_col, shard)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 4
    level = words.select(F.array("id").alias("words"), "a")
    levels = [level]
    for _ in range(2, longest + 1):
        longer = extensions(texts, level, least, shard, size)
        if longer.isEmpty():
            break
        level = count_phrases(texts, longer, shard).filter(F.col("a") >= least)
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return total, words, out


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000,
                 shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, count and phrase.

    A phrase's score is floor(1000 a n / (l r)) at its lowest cut (the earliest of equals) into parts of l and r occurrences. A
    phrase is left out if a longer frequent phrase that holds it occurs as often. Texts are lower-cased in A-Z.
    """
    total, words, phrases = frequent_phrases(docs, text_col, lang_col, least, longest, shard)
    of_lang = words.join(total, "lang").select(F.col("id").alias("first"), "lang", "n")
    several = phrases.filter("size(words) > 1")
    part = phrases.select(F.col("words").alias("part"), F.col("a").alias("f"))
    cuts = (several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
            .withColumn("left", F.expr("slice(words, 1, cut)")).withColumn("right", F.expr("slice(words, cut + 1, size(words) - cut)"))
            .join(part.withColumnRenamed("part", "left").withColumnRenamed("f", "l"), "left")
            .join(part.withColumnRenamed("part", "right").withColumnRenamed("f", "r"), "right")
            .withColumn("first", F.element_at("words", 1)).join(of_lang, "first"))
    whole = "cast({} as decimal(19,0))".format
    score = F.expr(f"({whole('a')} * {whole('n')} * 1000) div ({whole('l')} * {whole('r')})")
    scored = cuts.groupBy("words", "lang", "n", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    inside = (several.filter("size(words) > 2")
              .select(F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), F.col("a").alias("longer"))
              .groupBy("words").agg(F.max("longer").alias("longer")))
    kept = scored.join(inside, "words", "left").filter("longer is null or longer < a").select("words", "lang", "n", "a", "low.*")
    by_score = [F.desc("score"), F.desc("a")]
    kept = kept.withColumn("place", F.rank().over(Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(TOP_SALT))).orderBy(*by_score)))
    kept = kept.filter(F.col("place") <= top).withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*by_score)))
    kept = materialize(kept.filter(F.col("place") <= top))
    text = (kept.select("words", F.posexplode("words").alias("pos", "id")).join(words.select("id", "word"), "id")
            .groupBy("words").agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, word))), x -> x.word), ' ')").alias("phrase")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*by_score, "phrase"))
    return (kept.join(text, "words").withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
