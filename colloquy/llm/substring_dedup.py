"""Substring dedup: words covered by a long run of words that an earlier document also holds are removed.

Method: Rabin-Karp hashes of every window of `window` words. Documents are numbered into batches by ranges of their id, so
"a smaller id" means an earlier batch, or an earlier document of the batch. Each batch sends its distinct window hashes,
cut by their high bits, to hash buckets; a bucket counts in which batches a hash occurs and answers with one bit per
hash: seen in an earlier batch or not. The second pass makes the same hashes again, reads the bits in the same order and
merges repeated windows into maximal intervals. A window that occurs in a third of all documents is sent once per batch.

Defined cases: null or blank text has no words and nothing is removed; documents with fewer words than a window keep all;
a repeated id is not smaller than itself, so rows of equal id do not affect each other; a null id counts as the largest.
Windows are judged on the input, not on what is left. Hashes have 64 bits: with N windows a window is taken for another
with probability N / 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import shuffles
from colloquy.llm.words import binary_list, chunks, pack_sorted, unpack_sorted, words_of

BATCH_BYTES = 24 << 20
BUCKET_WINDOWS = 1 << 20
REMOVED = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))


def _ordered(table: pa.Table) -> tuple[pa.Table, list[bytes | None], np.ndarray]:
    """Rows by id and text, so that both passes see one order whatever order the shuffle gave."""
    table = table.sort_by([("key", "ascending"), ("text", "ascending")])
    return table, binary_list(table["text"].combine_chunks()), table["key"].to_numpy()


def _slices(sorted_hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each hash bucket that has rows."""
    if not len(sorted_hashes):
        return []
    if bits == 0:
        return [(0, 0, len(sorted_hashes))]
    bucket = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    return list(zip(bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True))


def _hash_pass(window: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        _, texts, _ = _ordered(table)
        seen = [np.zeros(0, np.uint64)]
        for lo, hi in chunks(texts):
            seen.append(np.unique(words_of(texts[lo:hi]).windows(window)[1]))
        seen = np.unique(np.concatenate(seen))
        found = _slices(seen, bits)
        return pa.table({
            "bucket": pa.array([b for b, _, _ in found], pa.int64()),
            "batch": pa.array([table["batch"][0].as_py()] * len(found), pa.int32()),
            "hashes": pa.array([pack_sorted(seen[i:j]) for _, i, j in found], pa.binary()),
        })

    return run


def _count_bucket(table: pa.Table) -> pa.Table:
    """One bit per hash of each batch: does an earlier batch hold it?"""
    table = table.sort_by("batch")
    parts = [unpack_sorted(x.as_py()) for x in table["hashes"]]
    hashes = np.concatenate(parts)
    order = np.argsort(hashes, kind="stable")
    again = np.zeros(len(hashes), bool)
    ranked = hashes[order]
    again[order[1:]] = ranked[1:] == ranked[:-1]
    cuts = np.cumsum([0, *map(len, parts)])
    rows = [i for i in range(len(parts)) if again[cuts[i]:cuts[i + 1]].any()]
    return pa.table({
        "batch": pa.array([table["batch"][i].as_py() for i in rows], pa.int32()),
        "bucket": pa.array([table["bucket"][i].as_py() for i in rows], pa.int64()),
        "bits": pa.array([np.packbits(again[cuts[i]:cuts[i + 1]]).tobytes() for i in rows], pa.binary()),
    })


def _kept_text(text: bytes, cut: np.ndarray, start: np.ndarray, end: np.ndarray, as_words: bool) -> bytes:
    """Text without the words of the intervals [first, after) of `cut`."""
    if as_words:
        words, at, out = text.split(), 0, []
        for first, after in cut:
            out += words[at:first]
            at = after
        return b" ".join(out + words[at:])
    if not len(cut):
        return text
    at, out = 0, []
    for first, after in cut:
        out.append(text[at:start[first]])
        at = start[after] if after < len(start) else end[after - 1]
    return b"".join([*out, text[at:]])


def _remove_pass(window: int, bits: int, as_words: bool, carried: list[str]):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs, texts, keys = _ordered(docs)
        hashes, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in chunks(texts):
            words = words_of(texts[lo:hi])
            begin, found = words.windows(window)
            doc = words.doc[begin]
            hashes.append(found)
            owner.append(doc + lo)
            place.append(begin - words.first[doc])
        hashes, owner, place = map(np.concatenate, (hashes, owner, place))
        seen, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        earlier = np.zeros(len(seen), bool)
        bits_of = dict(zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist(), strict=True))
        for bucket, i, j in _slices(seen, bits):
            if bucket in bits_of:
                earlier[i:j] = np.unpackbits(np.frombuffer(bits_of[bucket], np.uint8), count=j - i)
        hit = earlier[back] | (keys[owner] > keys[owner[first]][back])
        owner, place = owner[hit], place[hit]
        n_words, removed, kept = [], [], []
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        for d, text in enumerate(texts):
            begin = place[at[d]:at[d + 1]]
            cut = np.zeros((0, 2), np.int64)
            own = None
            if len(begin):
                gap = np.flatnonzero(np.diff(begin) > window) + 1
                cut = np.stack([begin[np.concatenate([[0], gap])], begin[np.concatenate([gap - 1, [len(begin) - 1]])] + window], 1)
                own = words_of([text])
            n_words.append(len(own.start) if own else len((text or b"").split()))
            removed.append([{"first": int(a), "count": int(b - a)} for a, b in cut])
            kept.append(None if text is None else _kept_text(text, cut, own and own.start, own and own.end, as_words))
        return pa.Table.from_arrays([
            docs["id"], *[docs[c] for c in carried], pa.array(n_words, pa.int64()), pa.array(removed, REMOVED),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ], names=["id", *carried, "n_words", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, as_words: bool = True,
                   carry: list[str] | None = None) -> DataFrame:
    """Per document: id, n_words, removed (intervals of words), kept (remaining text), then the `carry` columns by their names.

    as_words joins the kept words by single spaces; otherwise the text is kept byte for byte around the removed intervals.
    A null text stays null. Intervals are maximal: overlapping or adjoining ones are merged.
    """
    spark, carry = docs.sparkSession, carry or []
    carried = [f"carried{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(shuffles.LAST_ID)).alias("key"),
                       F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)])
    rows, _, size = shuffles.with_ranges(rows, "key", "text", BATCH_BYTES)
    bits = shuffles.buckets(spark, size // 6, BUCKET_WINDOWS).bit_length() - 1
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    hashes = rows.groupBy("batch").applyInArrow(_hash_pass(window, bits), "bucket bigint, batch int, hashes binary")
    replies = hashes.groupBy("bucket").applyInArrow(_count_bucket, "batch int, bucket bigint, bits binary")
    out = ", ".join([f"id {types['id']}", *[f"{c} {types[c]}" for c in carried],
                     "n_words bigint, removed array<struct<first:int,count:int>>, kept string"])
    found = rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_remove_pass(window, bits, as_words, carried), out)
    return found.select("id", "n_words", "removed", "kept", *[F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)])
