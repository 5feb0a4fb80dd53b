"""From candidate pairs of word n-gram sets to the exact components of their links.

A candidate is a pair (leader, member) of set ids; two sets that link must be such a pair or members of one leader. Each
leader's members are compared with it exactly; its answers (the difference D of every member to it) then give the answers among
its members without their sets: |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|. Members of one component need no test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import shuffles
from colloquy.llm.components import components
from colloquy.llm.words import binary_list, chunks, mix, shed, words_of
from colloquy.session import materialize

LEADER_TILE = 512
MEMBER_TILE = 4096
TILE_BYTES = 8 << 20
BROADCAST_ROWS = 1_000_000


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark, bytes and text of every row; rows are told apart by id and mark, a hash of the text, so null ids do not meet."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("bytes"), F.col(text_col).alias("text"))


def document_sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every document."""
    for lo, hi in chunks(texts):
        words = words_of(texts[lo:hi], lower=True)
        begin, found = words.windows(size)
        cut = np.searchsorted(words.doc[begin], np.arange(hi - lo + 1))
        for d in range(hi - lo):
            own = found[cut[d]:cut[d + 1]]
            if not len(own) and words.first[d] < words.first[d + 1]:
                n = int(words.first[d + 1] - words.first[d])
                own = words_of([texts[lo + d]], lower=True).windows(n)[1]
            yield np.unique(own)


def set_id(tokens: np.ndarray) -> int:
    return int(np.sum(mix(tokens), dtype=np.uint64).view(np.int64)) if len(tokens) else 0


def expand(count: np.ndarray, limit: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, k) for k < count[i], in pieces of about `limit` rows."""
    total = np.cumsum(count)
    lo = 0
    while lo < len(count):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, side="right")))
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        lo = hi


def derived_links(n: np.ndarray, comp: np.ndarray, diffs: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between members of one leader that are in different components, from their differences to the leader.

    For a member outside the largest component, one link to each other component it is linked with.
    """
    names, kind, count = np.unique(comp, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    out: list[tuple[int, int]] = []
    size = np.fromiter(map(len, diffs), np.int64, len(diffs))
    tokens, back = np.unique(np.concatenate(diffs), return_inverse=True)
    by_token = np.argsort(back, kind="stable")
    holder, edge = np.repeat(np.arange(len(n)), size)[by_token], np.searchsorted(back[by_token], np.arange(len(tokens) + 1))
    begin = np.cumsum(size) - size
    for y in np.flatnonzero(kind != count.argmax()):
        mine = back[begin[y]:begin[y] + size[y]]
        shared = np.zeros(len(n), np.int64)
        for i, k in expand(edge[mine + 1] - edge[mine]):
            shared += np.bincount(holder[edge[mine[i]] + k], minlength=len(n))
        total = n + n[y]
        both = (total - (size + size[y] - 2 * shared)) // 2
        linked = np.flatnonzero((both * den >= num * (total - both)) & (kind != kind[y]))
        out += [(int(y), int(x)) for x in linked[np.unique(kind[linked], return_index=True)[1]]]
    return out


def _verify(size: int, num: int, den: int):
    """Links of a leader's members: all of them where the leader has one tile of members, else those with the leader, and
    every member's difference to it."""

    def run(table: pa.Table) -> pa.Table:
        shed()
        table = table.sort_by([("leader", "ascending"), ("tile", "ascending")])
        leader, tile, tiles, sid = (table[c].to_numpy() for c in ("leader", "tile", "tiles", "sid"))
        texts = binary_list(table["text"].combine_chunks())
        cut = np.flatnonzero((np.diff(leader) != 0) | (np.diff(tile) != 0)) + 1
        out: dict[str, list] = {c: [] for c in ("leader", "sid", "n_leader", "n", "linked", "diff")}

        def add(*row) -> None:
            for c, v in zip(out, row, strict=True):
                out[c].append(v)

        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(leader)], strict=True):
            sets = {}
            for x, own in zip(sid[i:j].tolist(), document_sets(texts[i:j], size), strict=True):
                if set_id(own) == x:  # rows that repeat an id with another text are not this set
                    sets[x] = own
            first = int(leader[i])
            head = sets.pop(first)
            diffs = [np.setxor1d(head, own, assume_unique=True) for own in sets.values()]
            n = np.array([len(own) for own in sets.values()], np.int64)
            both = (len(head) + n - np.array([len(d) for d in diffs], np.int64)) // 2
            linked = both * den >= num * (len(head) + n - both)
            names = list(sets)
            if tiles[i] > 1:
                for x, m, hit, diff in zip(names, n.tolist(), linked.tolist(), diffs, strict=True):
                    add(first, x, len(head), m, hit, diff.tobytes())
                continue
            for x in np.flatnonzero(linked):
                add(first, names[x], len(head), int(n[x]), True, None)
            for y, x in derived_links(n, np.where(linked, -1, np.arange(len(n))), diffs, num, den):
                add(names[y], names[x], int(n[y]), int(n[x]), True, None)
        kinds = {"diff": pa.binary(), "linked": pa.bool_()}
        return pa.table([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], names=list(out))

    return run


def _across(num: int, den: int):
    """Links between components among the members of tiles of one leader."""

    def run(table: pa.Table) -> pa.Table:
        leader, tile, sid, n, comp = (table[c].to_numpy() for c in ("leader", "tile", "sid", "n", "comp"))
        diffs = [np.frombuffer(x, np.uint64) for x in table["diff"].to_pylist()]
        order = np.lexsort((tile, leader))
        cut = np.flatnonzero((np.diff(leader[order]) != 0) | (np.diff(tile[order]) != 0)) + 1
        found = [(int(sid[at[y]]), int(sid[at[x]])) for at in np.split(order, cut)
                 for y, x in derived_links(n[at], comp[at], [diffs[i] for i in at], num, den)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return run


def _wanted_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (key, mark, copies, …) with the text of one row of that id and text each."""
    texts = rows.select(F.coalesce("id", F.lit(shuffles.LAST_ID)).alias("key"), "mark", "text")
    few = wanted.count() <= BROADCAST_ROWS  # a few numbers a row

    def joined(source: DataFrame, part: DataFrame) -> DataFrame:
        return source.join(F.broadcast(part) if few else part, ["key", "mark"])

    once = joined(texts, wanted.filter("copies = 1"))
    more = wanted.filter("copies > 1")
    if more.isEmpty():
        return once
    single = joined(texts, more.select("key", "mark").distinct()).groupBy("key", "mark").agg(F.first("text").alias("text"))
    return once.unionByName(single.join(more, ["key", "mark"]).select(*once.columns))


def resolve(rows: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, threshold: tuple[int, int],
            leader_tile: int = LEADER_TILE, member_tile: int = MEMBER_TILE) -> DataFrame:
    """(node, component) of the set ids that have a link. `rows` from marked(); `sets` with id, mark, bytes, n, sid; `pairs` with leader, sid.

    Work goes out in tiles of at most leader_tile members or about TILE_BYTES of text, several to a task by bytes.
    """
    spark = rows.sparkSession
    num, den = threshold
    place = materialize(sets.filter("n > 0").groupBy("sid", F.coalesce("id", F.lit(shuffles.LAST_ID)).alias("key"), "mark")
                        .agg(F.count("*").alias("copies"), F.max("bytes").alias("bytes"))
                        .groupBy("sid").agg(F.min(F.struct("key", "mark", "copies", "bytes")).alias("p")).select("sid", "p.*"))
    placed = pairs.join(place, "sid")
    tiles = placed.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / leader_tile), F.ceil(F.sum("bytes") / TILE_BYTES)).cast("int").alias("tiles"))
    tiles = tiles.withColumn("tiles", F.greatest("tiles", F.lit(1)))
    columns = ["leader", "sid", "tile", "tiles", "key", "mark", "copies", "bytes"]
    members = placed.join(tiles, "leader").withColumn("tile", F.pmod(F.xxhash64("sid"), "tiles").cast("int")).select(*columns)
    heads = tiles.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("sid", F.col("leader"))
    full = materialize(members.unionByName(heads.join(place, "sid").select(*columns)))
    work = full.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(shuffles.partitions(spark), -(-work // TILE_BYTES))
    texts = _wanted_texts(rows, full.drop("bytes")).select("leader", "tile", "tiles", "sid", "text")
    checked = materialize(
        texts.groupBy(F.pmod(F.xxhash64("leader", "tile"), F.lit(parts)).alias("part")).applyInArrow(
            _verify(size, num, den), "leader bigint, sid bigint, n_leader bigint, n bigint, linked boolean, diff binary"))
    links = checked.filter("linked").select(F.col("leader").alias("a"), F.col("sid").alias("b"))
    found = components(links)

    wide = checked.filter("diff is not null")
    group = wide.select("leader", "sid", "n", "diff").unionByName(
        wide.groupBy("leader").agg(F.first("n_leader").alias("n")).select("leader", F.col("leader").alias("sid"), "n", F.lit(b"").alias("diff")))
    group = group.join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    mixed = (group.groupBy("leader").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
             .select("leader", F.ceil(F.col("rows") / member_tile).cast("int").alias("t")))
    group = group.join(mixed, "leader").withColumn("own", F.pmod(F.xxhash64("sid"), "t").cast("int"))
    group = group.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    group = group.select("leader", "sid", "n", "diff", "comp", (F.least("own", "other") * F.col("t") + F.greatest("own", "other")).alias("tile"))
    more = materialize(group.groupBy(F.pmod(F.xxhash64("leader", "tile"), F.lit(parts)).alias("part")).applyInArrow(_across(num, den), "a bigint, b bigint"))
    return found if more.isEmpty() else components(links.unionByName(more))


def named_components(sets: DataFrame, found: DataFrame) -> DataFrame:
    """Per row of `sets`: id, n_shingles, set_id and component_id, the smallest id of its component; a row without links keeps its id."""
    named = sets.select("id", "n", "sid").join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    first = named.filter("n > 0").groupBy("comp").agg(F.min("id").alias("first"))
    return named.join(first, "comp", "left").select(
        "id", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id")).alias("component_id"))
