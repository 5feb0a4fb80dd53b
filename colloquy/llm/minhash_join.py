"""MinHash near-duplicates by an inverted join of signature coordinates, with exact confirmation.

Method. A document's set holds the hashes of its distinct word shingles; equal sets are one class. A class has a signature of
COORDINATES minima, and each pair of coordinate and value is a token under which the class is posted. Two sets of similarity s
share a token with probability s per coordinate, so linked sets share MATCHES of them but for a chance below 1e-11 a pair (at
0.85 and the defaults; higher similarities are safer, and `matches` is an argument). Collisions are counted with two kinds of skipping:
* prefix: a class with fewer than MATCHES tokens that others hold has no partner. The others are posted under the rarest
  COORDINATES - MATCHES + 1 of their tokens only; two classes with MATCHES common tokens meet in one of these lists at least.
* merging: in a list, classes join a leader with which they collide at half the match threshold; only leader-member
  pairs and, by size and a count of all coordinates, pairs across clusters above the threshold leave the list. Lists of one class
  and pairs inside a cluster are skipped.
Every link is then confirmed on full sets (`resolution`): members of a leader are compared through their differences to it.

Lists longer than LIST_TILE are split into tiles that meet two by two, so no task holds a whole hot list. Exact copies are
folded before anything is posted. Defined cases: null or blank text has an empty set, no link and its own id as component; a text of
fewer words than a shingle is one shingle; rows of equal text are linked whatever their ids; a null id counts as the largest and
names a component only if it has no other id; an empty table gives no rows; other columns are not read. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import shuffles
from colloquy.llm.resolution import document_sets, expand, marked, named_components, resolve, set_id
from colloquy.llm.words import binary_list, chunks, mix
from colloquy.session import materialize

COORDINATES = 48
MATCHES = 20
LIST_TILE = 1 << 14
BUCKET_ENTRIES = 1 << 17
LEADERS = 8


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """Minimum of every coordinate's hash over each non-empty set, made distinct between coordinates."""
    begin = np.cumsum([0, *map(len, sets[:-1])])
    tokens = np.concatenate(sets)
    seeds = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64))
    out = np.empty((len(sets), coordinates), np.uint64)
    for c in range(coordinates):
        x = (tokens ^ seeds[2 * c]) * (seeds[2 * c + 1] | np.uint64(1))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        out[:, c] = mix(np.minimum.reduceat(x, begin) ^ seeds[2 * c + 1])
    return out


def _describe(size: int, coordinates: int):
    """Per document: set size and set id; per distinct set of a batch also its tokens, and their low bytes."""

    def run(batches):
        for batch in batches:
            texts = binary_list(batch.column(3))
            for lo, hi in chunks(texts):
                sets = list(document_sets(texts[lo:hi], size))
                sid = np.array([set_id(own) for own in sets], np.int64)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                _, once = np.unique(sid, return_index=True)
                once = np.sort(once[n[once] > 0])
                tokens, low = [None] * len(sets), [None] * len(sets)
                if len(once):
                    for i, own in zip(once.tolist(), signatures([sets[i] for i in once], coordinates), strict=True):
                        tokens[i], low[i] = own.view(np.int64), own.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[:3]), pa.array(n), pa.array(sid), pa.array(tokens, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                    names=["id", "mark", "bytes", "n", "sid", "tokens", "low"])

    return run


def _meet(matches: int, num: int, den: int):
    """Leader-member pairs and pairs across clusters above the match threshold, of every list of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("list", "ascending"), ("pos", "ascending"), ("sid", "ascending")])
        of, sid, n = (table[c].to_numpy() for c in ("list", "sid", "n"))
        low = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(len(sid), -1)
        same = lambda x, y: (low[x] == low[y]).sum(1)
        seg = np.cumsum(np.diff(of, prepend=of[:1]) != 0)
        cluster = np.full(len(sid), -1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        left = np.arange(len(sid))
        for _ in range(LEADERS):  # whoever is left forms a cluster alone
            if not len(left):
                break
            first = np.concatenate([[True], seg[left][1:] != seg[left][:-1]])
            leader = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
            joined = first.copy()
            for i in range(0, len(left), 1 << 16):
                joined[i:i + (1 << 16)] |= same(leader[i:i + (1 << 16)], left[i:i + (1 << 16)]) >= matches // 2
            cluster[left[joined]] = leader[joined]
            star = joined & ~first
            pairs.append(np.stack([sid[leader[star]], sid[left[star]]], 1))
            left = left[~joined]
        cluster[left] = left
        order = np.lexsort((cluster, seg))
        seg, cluster = seg[order], cluster[order]
        ends = lambda x: np.append(np.flatnonzero(np.diff(x)) + 1, len(x))[np.cumsum(np.diff(x, prepend=x[:1]) != 0)]
        if len(order):
            begin, end = ends(cluster), ends(seg)
            for i, k in expand(end - begin):
                x, y = order[i], order[begin[i] + k]
                ok = np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num
                x, y = x[ok], y[ok]
                ok = same(x, y) >= matches
                a, b = sid[x[ok]], sid[y[ok]]
                pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"leader": pa.array(found[:, 0]), "sid": pa.array(found[:, 1])})

    return run


def candidates(sets: DataFrame, coordinates: int, matches: int, threshold: tuple[int, int]) -> DataFrame:
    """(leader, sid): pairs of set ids such that two sets with `matches` common coordinates are a pair or members of one leader."""
    spark = sets.sparkSession
    classes = sets.filter("tokens is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("low").alias("low"))
    posted = classes.select("sid", F.explode("tokens").alias("tok"))
    held = posted.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    shared = (posted.join(held, "tok").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("held"))
              .filter(F.size("held") >= matches))
    kept = materialize(shared.join(classes.select("sid", "n", "low"), "sid").select(
        "sid", "n", "low", (F.lit(coordinates) - F.size("held")).alias("rare"), F.slice("held.tok", 1, F.size("held") - F.lit(matches - 1)).alias("prefix")))
    entries = kept.select("sid", "n", "low", "rare", F.posexplode("prefix").alias("at", "tok")).withColumn("pos", F.col("rare") + F.col("at"))
    lists = kept.select(F.explode("prefix").alias("tok")).groupBy("tok").agg(F.ceil(F.count("*") / LIST_TILE).cast("int").alias("t"), F.count("*").alias("df"))
    entries = entries.join(lists.filter("df > 1"), "tok").withColumn("own", F.pmod(F.xxhash64("sid"), "t").cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    entries = entries.select(F.xxhash64("tok", F.least("own", "other"), F.greatest("own", "other")).alias("list"), "pos", "sid", "n", "low")
    count = kept.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    buckets = shuffles.buckets(spark, count, BUCKET_ENTRIES)
    return materialize(entries.groupBy(F.pmod("list", F.lit(buckets)).alias("bucket"))
                       .applyInArrow(_meet(matches, *threshold), "leader bigint, sid bigint").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (17, 20),
                    coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """Per row of `docs`: id, n_shingles, set_id (equal sets share it) and component_id (smallest id reachable by links).

    Two sets are linked at a Jaccard similarity of at least threshold[0] / threshold[1], tested in whole numbers on full sets.
    """
    rows = marked(docs, id_col, text_col)
    sets = materialize(rows.mapInArrow(_describe(size, coordinates),
                                       "id bigint, mark bigint, bytes bigint, n bigint, sid bigint, tokens array<bigint>, low binary"))
    pairs = candidates(sets, coordinates, matches, threshold)
    return named_components(sets, resolve(rows, sets, pairs, size, threshold))
