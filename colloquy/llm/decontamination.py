"""Benchmark decontamination by latent semantic retrieval, checked word by word.

Words are lower-cased runs of letters and digits. Every text becomes a row of 16-bit word numbers once; all later passes
read those. TF-IDF passages of BLOCK words over SLOTS hashed terms get a randomised SVD: with a random test matrix W, every
task sums its part of A'(A W) (a table of fixed size), Spark adds the parts, and an orthonormal basis of the sum is the
latent space. Benchmark items are searched for in windows of the texts that hold every passage an item may be stretched
to (`reach`). An inverted index of the items' rare words leaves the windows that can hold `loose` of an item (a lossless
bound); those of a cosine of at least COSINE in the latent space, or that can hold `exact` of it, are candidates. An item without rare words is compared with
every window. The longest common subsequence of the item and any passage of at most `reach` words in and around the window
decides: at least `exact` of the item, or at least `loose` together with `answer` of the item's answer (column answer if
given, else its last sentence, or its last five words if that is short). Items are the stated query set: they are read in groups of ITEM_GROUP and meet all rows group by group.

Items shorter than SHORT words count only as exact runs of words. They are looked up in the texts by 64-bit hashes of runs of
their lengths, as few 16-bit numbers would also agree by chance.

Defined cases: null or blank texts and items match nothing;
rows that repeat an id are judged by their own text; items of null id count and share one row a text; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import BREAK, WORD_BASE, binary_list, chunks, shed, sliced, words_of
from colloquy.session import materialize

RANK, EXTRA = 48, 8
BLOCK = 8
PASSAGE = 32
MOST_BLOCKS = 12  # of a window; longer items have windows of wider blocks
COSINE = 0.2
COMMON = 0.01
SHORT = 8
ITEM_GROUP = 2048
PARTS = 16


def word_numbers(texts: list[bytes | None]) -> list[np.ndarray]:
    """16-bit word numbers of every text."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        words = words_of(texts[lo:hi], lower=True, space=BREAK)
        out += np.split((words.hash >> np.uint64(48)).astype(np.uint16), words.first[1:-1])
    return out


def _number(batches):
    shed()
    for batch in sliced(batches):
        numbers = word_numbers(binary_list(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n.tobytes() for n in numbers], pa.binary())], names=["id", "words"])


def _vocabulary(batches):
    for batch in batches:
        numbers = word_numbers(binary_list(batch.column(batch.schema.get_field_index("text"))))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(numbers) if numbers else []).astype(np.int32))], names=["number"])


def _batches(numbers: list[np.ndarray], limit: int = 1 << 18):
    lo = total = 0
    for i, n in enumerate(numbers):
        if i > lo and total + len(n) > limit:
            yield lo, numbers[lo:i]
            lo, total = i, 0
        total += len(n)
    if lo < len(numbers):
        yield lo, numbers[lo:]


def _hits(numbers: list[np.ndarray], term_of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block (of `width` words) and term of every word that is a term, and the first block of every text."""
    size = np.fromiter(map(len, numbers), np.int64, len(numbers))
    first_block = np.concatenate([[0], np.cumsum(-(-size // width))])
    term = term_of[np.concatenate(numbers)]
    at = np.flatnonzero(term >= 0)
    text = np.searchsorted(np.cumsum(size), at, side="right")
    return first_block[text] + (at - (np.cumsum(size) - size)[text]) // width, term[at], first_block


def _frequency(term_of: np.ndarray):
    """Passages that hold a term, summed over a task; term -1 counts the passages."""

    def run(batches):
        df, passages, terms = np.zeros(term_of.max() + 1, np.int64), 0, term_of.max() + 1
        for batch in batches:
            for _, numbers in _batches([np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()]):
                block, term, first = _hits(numbers, term_of, PASSAGE)
                passages += int(first[-1])
                df += np.bincount(np.unique(block * terms + term) % terms, minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], passages), pa.int64())], names=["term", "df"])

    return run


def _product(term_of: np.ndarray, weights: np.ndarray):
    """A task's part of A'(A W), as PARTS row blocks. weights: idf * W by term."""

    def run(batches):
        out = np.zeros(weights.shape, np.float64)
        for batch in batches:
            for _, numbers in _batches([np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()]):
                block, term, _ = _hits(numbers, term_of, PASSAGE)
                if not len(term):
                    continue
                edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
                image = np.add.reduceat(weights[term], edge, axis=0)[np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(term))))]
                order = np.argsort(term, kind="stable")
                edge = np.concatenate([[0], np.flatnonzero(np.diff(term[order])) + 1])
                out[term[order][edge]] += np.add.reduceat(image[order], edge, axis=0)
        rows = np.array_split(out.astype(np.float32), PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["part", "cells"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table["cells"])
    return pa.table({"part": table["part"][:1], "cells": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def latent_space(numbered: DataFrame, vocabulary: np.ndarray, rank: int = RANK, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray]:
    """Term of every word number (-1: none), and the idf-weighted orthonormal basis (terms x rank) of the passages' space.

    Terms are the words of the vocabulary (word numbers) that at most a share COMMON of all passages hold. One power step of
    a randomised SVD; at most 65,536 terms, so the tables have a fixed bound.
    """
    words = numbered.select("words")
    term_of = np.full(1 << 16, -1, np.int64)
    term_of[vocabulary] = np.arange(len(vocabulary))
    counts = words.mapInArrow(_frequency(term_of), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(len(vocabulary))
    inner = counts[counts["term"] >= 0]
    df[inner["term"].to_numpy()] = inner["df"].to_numpy()
    passages = max(1, int(counts.loc[counts["term"] < 0, "df"].sum()))
    rare = np.flatnonzero(df <= COMMON * passages)
    term_of[:] = -1
    term_of[vocabulary[rare]] = np.arange(len(rare))
    idf = np.log((passages + 1) / (df[rare] + 1)).astype(np.float32)[:, None]
    test = np.random.default_rng(0).standard_normal((len(rare), rank + extra)).astype(np.float32) * idf
    parts = words.mapInArrow(_product(term_of, test), "part int, cells binary").groupBy("part").applyInArrow(_add, "part int, cells binary").toPandas()
    image = np.zeros((0, rank + extra), np.float32)
    if len(parts) and len(rare):
        image = np.concatenate([np.frombuffer(bytes(x), np.float32) for x in parts.sort_values("part")["cells"]]).reshape(len(rare), -1)
    basis, _, _ = np.linalg.svd((image * idf[: len(image)]).astype(np.float64), full_matrices=False)
    space = np.zeros((len(rare), rank), np.float32)
    space[: len(basis), : min(rank, basis.shape[1])] = (basis[:, :rank] * idf[: len(basis)])
    return term_of, space


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_length(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, one big-integer step per passage word."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in passage.tolist():
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def reach(n: int) -> int:
    """Words of the longest passage that may hold an item of n words: half longer, and two."""
    return int(1.5 * n) + 2


def _overlap(words: np.ndarray, answer_words: np.ndarray, passage: np.ndarray, exact: float, loose: float, answer: float) -> float:
    """Largest share of an item found in order in any `reach` consecutive words of the passage; 0 if it doesn't count."""
    n = len(words)
    inside = np.zeros(1 << 16, bool)
    inside[words] = inside[answer_words] = True
    at = np.flatnonzero(inside[passage])  # a part may as well begin at one of these
    held = passage[at]
    most, full = common_length(words, held), int(np.ceil(exact * n - 1e-9))
    asked = int(np.ceil(answer * len(answer_words) - 1e-9))
    least = int(np.ceil(loose * n - 1e-9)) if common_length(answer_words, held) >= asked else full
    size, best, k = reach(n), 0, 0
    while k < len(at) and max(least, best + 1) <= most:
        end = int(np.searchsorted(at, at[k] + size))
        score = common_length(words, held[k:end])
        lacks = max(least, best + 1) - score
        if lacks > 0:  # no part holds more before it takes in as many further words
            if end + lacks > len(at):
                break
            k = int(np.searchsorted(at, at[end + lacks - 1] - size + 1))
            continue
        if score >= full or common_length(answer_words, held[k:end]) >= asked:
            best = score
        k += 1
    return best / n


def _search(term_of: np.ndarray, space: np.ndarray, items: list[tuple[int, np.ndarray, np.ndarray]], exact: float, loose: float, answer: float):
    pieces = [words for _, words, _ in items]
    length = np.array([len(p) for p in pieces])
    # windows of `span` blocks of BLOCK << wide words hold any `reach` consecutive words, at a step of one such block
    wide = np.array([next(w for w in range(64) if (reach(n) - 2 >> w) // BLOCK + 2 <= MOST_BLOCKS) for n in length.tolist()])
    span = np.array([-(-(reach(n) - 1) // (BLOCK << w)) + 1 for n, w in zip(length.tolist(), wide.tolist(), strict=True)])
    blocks_of = span << wide
    terms = [term_of[p][term_of[p] >= 0] for p in pieces]
    common = length - np.array([len(t) for t in terms])
    latent = _unit(np.stack([space[t].sum(0) for t in terms]))
    # terms that a window must hold for `exact` of an item; for `loose` of it, with those that its text must hold of the answer
    need, need_loose = (np.ceil(x * length - 1e-9).astype(np.int64) - common for x in (exact, loose))
    answers = [a for _, _, a in items]
    need_answer = np.array([int(np.ceil(answer * len(a) - 1e-9)) - int((term_of[a] < 0).sum()) for a in answers])
    last = len(pieces)
    posted = np.unique(np.concatenate([np.stack([t, np.full(len(t), g)], 1) for g, t in enumerate(
        [*terms, *[term_of[a][term_of[a] >= 0] for a in answers]])] or [np.zeros((0, 2), np.int64)]), axis=0).astype(np.int64)
    post = np.searchsorted(posted[:, 0], np.arange(len(space) + 1))
    plain = np.flatnonzero(need_loose <= 0)

    def windows(numbers: list[np.ndarray]):
        """(text, block, item) of windows that can hold an item and lie near it in the latent space."""
        block, term, first = _hits(numbers, term_of, BLOCK)
        blocks = int(first[-1])
        if not blocks:
            return
        text = np.repeat(np.arange(len(numbers)), np.diff(first))
        edge = np.searchsorted(block, np.arange(blocks + 1))
        image = np.concatenate([np.zeros((1, space.shape[1])), np.cumsum(space[term], axis=0, dtype=np.float64)])[edge]
        count = post[term + 1] - post[term]
        at = np.repeat(block, count)
        item = posted[np.repeat(post[term] - np.cumsum(count) + count, count) + np.arange(count.sum()), 1]
        key, back, total = np.unique(text[at] * (2 * last) + item, return_inverse=True, return_counts=True)
        total = np.append(total, 0)

        def held(kind: np.ndarray) -> np.ndarray:
            """Hits of the text for an item or (kind + last) its answer."""
            spot = np.minimum(np.searchsorted(key, kind), len(key) - 1)
            return np.where(key[spot] == kind, total[spot], 0)

        own = item < last
        at, item, back = at[own], item[own], back[own]
        here = total[back]
        asked = held(text[at] * (2 * last) + item + last) >= need_answer[item]
        least = np.where(asked, np.maximum(need_loose, 1)[item], need[item])
        able = here >= least
        at, item, least = at[able], item[able], least[able]
        size = span[item]
        start = first[text[at]]
        back = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        item, at, start, least, size = (np.repeat(x, size) for x in (item, at, start, least, size))
        shifted = start + (((at - start) >> wide[item]) - size + 1 + back << wide[item])
        inside = shifted >= start
        pair, where, total = np.unique(shifted[inside] * last + item[inside], return_index=True, return_counts=True)
        able = total >= least[inside][where]
        at, item, full = pair[able] // last, pair[able] % last, total[able]
        end = np.minimum(at + blocks_of[item], first[text[at] + 1])
        near = (np.einsum("ij,ij->i", _unit(image[end] - image[at]), latent[item]) >= COSINE) | (full >= np.maximum(need[item], 1))
        yield text[at[near]], at[near] - first[text[at[near]]], item[near]
        words = np.concatenate(numbers)
        size = np.fromiter(map(len, numbers), np.int64, len(numbers))
        begin = np.repeat(np.cumsum(size) - size, np.diff(first)) + BLOCK * (np.arange(blocks) - first[text])
        for g in plain:  # nothing rare to look up: every window is compared, by all its words
            end = np.minimum(np.arange(blocks) + blocks_of[g], first[text + 1])
            mine = np.zeros(1 << 16, np.int64)
            mine[pieces[g]] = 1
            total = np.concatenate([[0], np.cumsum(mine[words])])[np.append(begin, len(words))]
            near = np.flatnonzero(total[end] - total[:-1] >= np.ceil(loose * length[g] - 1e-9))
            if common[g] < length[g]:
                full = (total[end] - total[:-1])[near] >= np.ceil(exact * length[g] - 1e-9)
                near = near[full | (_unit(image[end[near]] - image[near]) @ latent[g] >= COSINE)]
            yield text[near], near - first[text[near]], np.full(len(near), g)

    def run(batches):
        shed()
        for batch in sliced(batches):
            numbers = [np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]
            hits: list[dict[int | None, float]] = [{} for _ in numbers]
            for lo, part in _batches(numbers):
                for text, at, item in windows(part):
                    order = np.lexsort((at, item, text))
                    done: tuple = ()
                    for d, b, g in zip(text[order].tolist(), at[order].tolist(), item[order].tolist(), strict=True):
                        item_id, words, answer_words = items[g]
                        own = hits[lo + d]
                        if own.get(item_id, 0.0) >= 1.0 or done[:2] == (d, g) and b <= done[2]:
                            continue
                        done = (d, g, b + int(blocks_of[g]))  # the passage holds the windows that begin up to there
                        passage = part[d][max(0, b * BLOCK - len(words)):(b + 2 * int(blocks_of[g])) * BLOCK + len(words)]
                        score = _overlap(words, answer_words, passage, exact, loose, answer)
                        if score > own.get(item_id, 0.0):
                            own[item_id] = score
            found = [(i, item, score) for i, own in enumerate(hits) for item, score in own.items()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.float64())], names=["row", "item_id", "overlap"])

    return run


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of n word hashes."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(WORD_BASE) + words[i:i + len(out)]
    return out


def _exact_runs(items: list[tuple[int, bytes]]):
    by_length: dict[int, dict[int, set]] = {}
    for item_id, text in items:
        words = words_of([text], lower=True, space=BREAK).hash
        by_length.setdefault(len(words), {}).setdefault(int(_run_hashes(words, len(words))[0]), set()).add(item_id)
    asked = {n: np.array(sorted(ids), np.uint64) for n, ids in by_length.items()}

    def run(batches):
        shed()
        for batch in sliced(batches):
            texts = binary_list(batch.column(1))
            row, item = [], []
            for lo, hi in chunks(texts):
                found = words_of(texts[lo:hi], lower=True, space=BREAK)
                hits = set()
                for n, keys in asked.items():
                    own = _run_hashes(found.hash, n)
                    at = np.flatnonzero(np.isin(own, keys))
                    at = at[found.doc[at] == found.doc[at + n - 1]]
                    hits |= {(d, i) for d, h in set(zip(found.doc[at].tolist(), own[at].tolist(), strict=True)) for i in by_length[n][h]}
                for d, i in hits:
                    row.append(lo + d)
                    item.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()),
                                              pa.array([1.0] * len(row), pa.float64())], names=["row", "item_id", "overlap"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: float = 0.8, loose: float = 0.55,
                 answer: float = 0.9) -> DataFrame:
    """(id, item_id, overlap) for every document and benchmark item it holds; overlap is the share of the item found in order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    numbered = materialize(rows.mapInArrow(_number, f"id {kind}, words binary"))
    given = F.col("answer") if "answer" in benchmark.columns else F.regexp_extract(F.rtrim("text"), r"([^.!?\n]+[.!?]*)$", 1)
    asked = benchmark.filter("text is not null").select(F.col("item_id").cast("bigint"), F.col("text").cast("string"), given.cast("string").alias("answer"))
    words = materialize(asked.mapInArrow(_vocabulary, "number int").distinct()).toPandas()["number"].to_numpy()
    term_of, space = latent_space(numbered, np.sort(words).astype(np.int64))
    out, schema = None, f"row {kind}, item_id bigint, overlap double"

    def searched(group: list) -> DataFrame:
        texts = word_numbers([r.text.encode() for r in group])
        answers = word_numbers([(r.answer or "").encode() for r in group])
        items = [(r.item_id, w, a if len(a) >= 3 else w[-5:]) for r, w, a in zip(group, texts, answers, strict=True) if len(w) >= SHORT]
        short = [(r.item_id, r.text.encode()) for r, w in zip(group, texts, strict=True) if 0 < len(w) < SHORT]
        found = numbered.limit(0).select(F.col("id").alias("row"), F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("overlap"))
        if items:
            found = numbered.mapInArrow(_search(term_of, space, items, exact, loose, answer), schema)
        if short:
            runs = rows.mapInArrow(_exact_runs(short), schema)
            found = found.unionByName(runs) if items else runs
        return found

    group: list = []
    for r in asked.toLocalIterator():
        group.append(r)
        if len(group) == ITEM_GROUP:
            out = searched(group) if out is None else out.unionByName(searched(group))
            group = []
    if group or out is None:
        out = searched(group) if out is None else out.unionByName(searched(group))
    return out.select(F.col("row").alias("id"), "item_id", "overlap")
