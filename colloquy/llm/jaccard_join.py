"""Exact Jaccard self-join of word n-gram sets, with set-relation skipping, and the components of its links.

Method. A document's set holds the hashes of its distinct word shingles. Equal sets become one class. Every class is indexed
under its prefix: the shingles of which two sets at the threshold must share one, taken from the rare end of a global
order. Index lists are cut into blocks by position, and a block is skipped when its sizes or the rest of its sets behind
the shared shingle cannot reach the threshold. Inside a list, classes are put into clusters around a leader; only
leader-member pairs and pairs across clusters leave the list. The answers of a leader (the exact difference D of every
member to it) then give the answers of its members without their sets: |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|. Members of
one component need no test. No link between components is lost: two linked sets meet in the list of their first common
shingle, either as a pair or under one leader.

The rare end: shingles held by at least LOCAL_DF documents of one Arrow batch are counted over all documents; the HEAVY
most frequent go last, by frequency. This is a hint for speed; any order gives the same links.

Defined cases: null or blank text has an empty set, no link and its own id as component; a text of fewer words than a
shingle is one shingle; rows of equal text are linked whatever their ids; a null id counts as the largest and names a
component only if it has no other id. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import shuffles
from colloquy.llm.resolution import LEADER_TILE, MEMBER_TILE, document_sets, expand, marked, named_components, resolve, set_id
from colloquy.llm.words import binary_list, from_planes, pack_sorted, planes, shed, unpack_sorted
from colloquy.session import materialize

HEAVY = 1 << 18
LOCAL_DF = 3
CLASSES = 16
BLOCK = 64
BUCKET_ENTRIES = 1 << 18
COLUMNS = ("tok", "sid", "n", "pos", "classes")
ENTRY = np.dtype([("tok", "<u8"), ("sid", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("cls", "u1", (CLASSES,))])


def needed(n, m, num: int, den: int):
    """Smallest intersection of sets of n and m elements at a Jaccard similarity of num / den."""
    return -((-num * (n + m)) // (num + den))


def _frequent(size: int):
    def run(batches):
        shed()
        for batch in batches:
            sets = list(document_sets(binary_list(batch.column(0)), size))
            tokens, df = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            keep = df >= LOCAL_DF
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(df[keep])], names=["tok", "df"])

    return run


def _describe(size: int, num: int, den: int, heavy: np.ndarray, heavy_df: np.ndarray):
    """Per document: set size, set id, prefix in the global order, and counts of its shingles by hash class."""

    def run(batches):
        shed()
        for batch in batches:
            n, sid, prefix, classes = [], [], [], []
            for own in document_sets(binary_list(batch.column(3)), size):
                n.append(len(own))
                sid.append(set_id(own))
                classes.append(np.minimum(np.bincount((own & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes())
                rank = np.zeros(len(own), np.int64)
                if len(heavy) and len(own):
                    at = np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)
                    rank = np.where(heavy[at] == own, heavy_df[at], 0)
                length = len(own) - int(-(-len(own) * num // den)) + 1 if len(own) else 0
                prefix.append(own[np.argsort(rank, kind="stable")[:length]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(prefix, pa.binary()), pa.array(classes, pa.binary())],
                names=["id", "mark", "bytes", "n", "sid", "prefix", "classes"])

    return run


def _index(bits: int):
    """Index entries of the distinct sets of a batch, one row per hash bucket, in columns."""

    def run(batches):
        for batch in batches:
            _, once = np.unique(batch.column("sid").to_numpy(), return_index=True)
            once = once[batch.column("n").to_numpy()[once] > 0]
            batch = batch.take(pa.array(once))
            sets = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
            if not sets:
                continue
            length = np.fromiter(map(len, sets), np.int64, len(sets))
            tok, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), length)
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(length) - length, length)
            order = np.argsort(tok, kind="stable")
            tok, of, pos = tok[order], of[order], pos[order].astype(np.uint32)
            sid, n = batch.column("sid").to_numpy()[of], batch.column("n").to_numpy()[of].astype(np.uint32)
            classes = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint8).reshape(-1, CLASSES)[of]
            bucket = (tok >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tok), np.int64)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            parts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut[:-1]]), *[pa.array([f(x[i:j]) for i, j in parts], pa.binary()) for f, x in (
                    (pack_sorted, tok), (np.ndarray.tobytes, sid), (planes, n), (planes, pos), (np.ndarray.tobytes, classes))]],
                names=["bucket", *COLUMNS])

    return run


def _survive(e: np.ndarray, f: np.ndarray, num: int, den: int) -> np.ndarray:
    """Can the pair reach the threshold, by sizes, by what stands behind the shared shingle, and by class counts?"""
    n, m = e["n"].astype(np.int64), f["n"].astype(np.int64)
    need = needed(n, m, num, den)
    ok = (np.minimum(n, m) >= need) & (np.minimum(n - e["pos"], m - f["pos"]) >= need)
    at = np.flatnonzero(ok)
    apart = np.abs(e["cls"][at].astype(np.int16) - f["cls"][at]).sum(1)
    ok[at] = apart <= (n + m - 2 * need)[at]
    return ok


def _candidates(num: int, den: int):
    """Leader-member pairs and pairs across clusters of every index list of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        shed()
        read = (unpack_sorted, lambda x: np.frombuffer(x, np.int64), lambda x: from_planes(x, "u4"), lambda x: from_planes(x, "u4"),
                lambda x: np.frombuffer(x, np.uint8).reshape(-1, CLASSES))
        entry = np.zeros(sum(len(x) for x in table["sid"].to_pylist()) // 8, ENTRY)
        for field, column, f in zip(ENTRY.names, COLUMNS, read, strict=True):
            entry[field] = np.concatenate([f(x) for x in table[column].to_pylist()])
        # the set with the fewest rarer shingles leads a list: among near copies that is the least edited one, in all lists
        entry = entry[np.lexsort((entry["sid"], entry["pos"], entry["tok"]))]
        again = np.zeros(len(entry), bool)  # equal sets of several batches
        again[1:] = (entry["tok"][1:] == entry["tok"][:-1]) & (entry["sid"][1:] == entry["sid"][:-1])
        entry = entry[~again]
        begin = np.flatnonzero(np.diff(entry["tok"], prepend=entry["tok"][:1] + np.uint64(1)))
        df = np.diff(np.append(begin, len(entry)))
        entry = entry[np.repeat(df > 1, df)]
        size = len(entry)
        seg = np.concatenate([[0], np.cumsum(entry["tok"][1:] != entry["tok"][:-1])]) if size else np.zeros(0, np.int64)
        cluster = np.full(size, -1, np.int64)
        pairs = []
        left = np.arange(size)
        for _ in range(8):  # leaders; whoever is left forms a cluster alone
            if not len(left):
                break
            first = np.concatenate([[True], seg[left][1:] != seg[left][:-1]])
            leader = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
            joined = _survive(entry[leader], entry[left], num, den) | first
            cluster[left[joined]] = leader[joined]
            star = joined & ~first
            pairs.append(np.stack([entry["sid"][leader[star]], entry["sid"][left[star]]], 1))
            left = left[~joined]
        cluster[left] = left
        order = np.lexsort((entry["pos"], cluster, seg))
        entry, seg, cluster = entry[order], seg[order], cluster[order]
        if size:
            edge = lambda x: np.searchsorted(np.flatnonzero(np.diff(x)) + 1, np.arange(size), side="right")
            run_of = edge(cluster + seg * (size + 1))
            run_end = np.append(np.flatnonzero(np.diff(run_of)) + 1, size)[run_of]
            seg_end = np.append(np.flatnonzero(np.diff(seg)) + 1, size)[seg]
            begin = np.arange(0, size, BLOCK)
            rest = entry["n"] - entry["pos"]
            low, high, behind = np.minimum.reduceat(entry["n"], begin), np.maximum.reduceat(entry["n"], begin), np.maximum.reduceat(rest, begin)
            todo = np.flatnonzero(run_end < seg_end)
            b0, b1 = run_end[todo] // BLOCK, (seg_end[todo] - 1) // BLOCK + 1
            for i, k in expand(b1 - b0):
                block, own = b0[i] + k, todo[i]
                n = entry["n"][own].astype(np.int64)
                need = needed(n, np.maximum(low[block], -(-n * num // den)), num, den)
                ok = (low[block] * num <= n * den) & (high[block] * den >= n * num) & (np.minimum(rest[own], behind[block]) >= need)
                own, block = own[ok], block[ok]
                lo, hi = np.maximum(block * BLOCK, run_end[own]), np.minimum(block * BLOCK + BLOCK, seg_end[own])
                for j, step in expand(hi - lo):
                    x, y = own[j], lo[j] + step
                    ok = _survive(entry[x], entry[y], num, den)
                    a, b = entry["sid"][x[ok]], entry["sid"][y[ok]]
                    pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        found = np.unique(found[found[:, 0] != found[:, 1]], axis=0)
        return pa.table({"leader": pa.array(found[:, 0]), "sid": pa.array(found[:, 1])})

    return run


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """Per row of `docs`: id, n_shingles, set_id (equal sets share it) and component_id (smallest id reachable by links).

    Two sets are linked at a Jaccard similarity of at least threshold[0] / threshold[1], tested in whole numbers.
    """
    spark = docs.sparkSession
    num, den = threshold
    rows = marked(docs, id_col, text_col)
    frequent = (rows.select("text").mapInArrow(_frequent(size), "tok bigint, df bigint").groupBy("tok").agg(F.sum("df").alias("df"))
                .orderBy(F.desc("df"), "tok").limit(HEAVY).toArrow())
    heavy = frequent["tok"].to_numpy().view(np.uint64)
    rank = np.argsort(heavy)
    heavy_df = frequent["df"].to_numpy()[rank]
    sets = materialize(rows.mapInArrow(_describe(size, num, den, heavy[rank], heavy_df),
                                       "id bigint, mark bigint, bytes bigint, n bigint, sid bigint, prefix binary, classes binary"))
    entries = sets.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0] // 8
    bits = shuffles.buckets(spark, entries, BUCKET_ENTRIES).bit_length() - 1
    pairs = materialize(sets.select("sid", "n", "prefix", "classes").mapInArrow(_index(bits), "bucket bigint, tok binary, sid binary, n binary, pos binary, classes binary")
                        .groupBy("bucket").applyInArrow(_candidates(num, den), "leader bigint, sid bigint").distinct())

    found = resolve(rows, sets, pairs, size, threshold, LEADER_TILE, MEMBER_TILE)
    return named_components(sets, found)
