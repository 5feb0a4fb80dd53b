"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

Documents become pieces of at most `capacity` tokens; only longer documents are cut. Pieces are dealt evenly to groups of
about GROUP by a hash of their place; a group packs by best fit, longest first, and then empties underfull bins: starting from the least filled
one, it moves documents, exchanges one for one, two for one or one for two with other underfull bins, always raising the
sum of squared fills, until the group is at its lower bound or none of these exchanges improves it. Bins that stay underfull are opened, and
their pieces meet those of other groups in a further round of the same kind, until one group holds them all or a round
closes less than half of them.

Defined cases: null and empty texts give the closing id alone; rows that repeat an id are packed like any other rows; a
null id is kept. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.tokens import LOADED, public_path, word_ids
from colloquy.llm.words import binary_list, shed, sliced
from colloquy.session import materialize

CAPACITY = 2048
GROUP = 8192
OPEN_BELOW = 0.998


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None,
                 keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and with keep_ids the ids as little-endian 32-bit bytes (else null)."""
    path = path or public_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        shed(LOADED)
        ids_of = word_ids(path)
        for batch in sliced(batches):
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(ids_of.texts_ids(binary_list(batch.column(1)))):
                ids += b"\0\0\0\0"
                for k in range(-(-len(ids) // (4 * capacity))):
                    own = ids[4 * capacity * k:4 * capacity * (k + 1)]
                    row.append(i)
                    piece.append(k)
                    start.append(capacity * k)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    kept.append(own if keep_ids else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(kept, pa.binary()),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of row numbers: longest first, each into the fullest bin that takes it."""
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit g: some bin has a gap of g
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = filled >> need
        if fit:
            gap = need + (fit & -fit).bit_length() - 1
            at = by_gap[gap].pop()
            if not by_gap[gap]:
                filled &= ~(1 << gap)
            bins[at].append(i)
        else:
            gap, at = capacity, len(bins)
            bins.append([i])
        gap -= need
        by_gap[gap].append(at)
        filled |= 1 << gap
    return bins


def _two_of_a_size(where: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of the places `of`, ordered by bin, at most two of every size in a bin: no pair of sizes is lost."""
    of = of[np.lexsort((size[of], where[of]))]
    return of[np.concatenate([np.ones(min(2, len(of)), bool), (where[of[2:]] != where[of[:-2]]) | (size[of[2:]] != size[of[:-2]])])]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchange documents between underfull bins, raising the sum of squared fills, until bins empty.

    The donor is the least filled bin. Its documents a go to a bin B in return for b (nothing, one or two documents of B,
    or one for a pair a), so that the donor loses 0 < a - b <= gap of B, the most that any exchange offers. A donor without
    an exchange waits until another bin changes and then looks at the changed bins only. The search ends at the lower
    bound or when no exchange of these kinds is left; every exchange raises the sum, so it does end.
    """
    fill = np.array([lengths[b].sum() for b in bins], np.int64)
    under = np.flatnonzero(fill < capacity)
    if not len(under) or (capacity - fill[under]).sum() < capacity:
        return bins
    rows = np.concatenate([bins[i] for i in under])
    where = np.repeat(under, [len(bins[i]) for i in under])
    size = lengths[rows]
    seen = np.full(len(bins), -1)  # the step up to which a donor has looked at all bins
    changed = np.zeros(len(bins), np.int64)
    step = 0
    while True:
        live = under[(fill[under] > 0) & (fill[under] < capacity)]
        if (capacity - fill[live]).sum() < capacity:
            break
        free = live[seen[live] < step]
        if not len(free):
            break
        donor = free[fill[free].argmin()]
        others = live[(live != donor) & (fill[live] >= fill[donor]) & (changed[live] > seen[donor])]  # others would lower the sum
        if not len(others):
            seen[donor] = step
            continue
        open_to = np.zeros(len(bins), bool)
        open_to[others] = True
        theirs = np.flatnonzero(open_to[where])
        gap = capacity - fill[where[theirs]]
        mine = np.flatnonzero(where == donor)
        ones = {}
        for i in mine:
            ones.setdefault(int(size[i]), i)
        ordered = sorted(ones.items())
        two = {a + b: (i, j) for x, (a, i) in enumerate(ordered) for b, j in ordered[x + 1:]}
        two |= {2 * a: tuple(mine[size[mine] == a][:2]) for a, _ in ordered if (size[mine] == a).sum() > 1}
        offers = two | {a: (i,) for a, i in ordered}
        single, offered = np.array([a for a, _ in ordered]), np.array(sorted(offers))
        best = (0, (), ())
        gaps = capacity - fill[others]
        fits = single[single <= gaps.max()]
        if len(fits):  # move
            a = int(fits[-1])
            best = (a, offers[a], (int(others[np.where(gaps >= a, gaps, capacity + 1).argmin()]),))
        most = np.searchsorted(offered, size[theirs] + gap, side="right") - 1  # for one document of another bin: the most it may be replaced by
        win = np.where(most >= 0, offered[most] - size[theirs], 0)
        take = int(win.argmax())
        if win[take] > best[0]:
            best = (int(win[take]), offers[int(offered[most[take]])], (int(where[theirs[take]]), theirs[take]))
        if not best[0]:  # one for two documents of a bin
            order = _two_of_a_size(where, size, theirs)
            for apart in range(1, len(order)):
                same = np.flatnonzero(where[order[apart:]] == where[order[:-apart]])
                if not len(same):
                    break
                x, y = order[same], order[same + apart]
                pair = size[x] + size[y]
                most = np.searchsorted(single, pair + capacity - fill[where[x]], side="right") - 1
                win = np.where(most >= 0, single[most] - pair, 0)
                k = int(win.argmax())
                if win[k] > best[0]:
                    best = (int(win[k]), offers[int(single[most[k]])], (int(where[x[k]]), x[k], y[k]))
        if not best[0]:
            seen[donor] = step
            continue
        won, give, (target, *take) = best
        where[list(give)] = target
        where[take] = donor
        fill[donor] -= won
        fill[target] += won
        step += 1
        changed[[donor, target]] = step
        seen[[donor, target]] = -1  # their own documents are others now
    closed = np.setdiff1d(np.arange(len(bins)), under)
    order = np.argsort(where, kind="stable")
    cut = np.flatnonzero(np.diff(where[order])) + 1
    return [bins[i] for i in closed] + [part.tolist() for part in np.split(rows[order], cut)]


def _pack(capacity: int, turn: int, length: str):
    def run(table: pa.Table) -> pa.Table:
        lengths = table[length].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        rows = np.concatenate(bins)
        count = np.fromiter(map(len, bins), np.int64, len(bins))
        fill = np.array([lengths[b].sum() for b in bins], np.int64)
        size = lengths[rows]
        begin = np.cumsum(size) - size
        first = np.repeat(begin[np.cumsum(count) - count], count)
        number = np.repeat(np.arange(len(bins)), count) + (table["part"][0].as_py() << 32) + (turn << 57)
        under = np.repeat(fill < OPEN_BELOW * capacity, count)
        table = table.drop_columns(["part"]).take(pa.array(rows))
        return table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(begin - first)).append_column("open", pa.array(under))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (length at most `capacity`, other columns as they are) with sequence_id and offset, gapless from 0 in each
    sequence; columns of these two names are replaced."""
    pieces = pieces.drop("sequence_id", "offset")
    given = pieces.columns
    kept = materialize(pieces.toDF(*[f"c{i}" for i in range(len(given))]))  # any names, those used here included
    length = f"c{given.index('length')}"

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept.schema] + ["sequence_id bigint, `offset` bigint, open boolean"])
    left, done, turn = kept, None, 0
    count = left.count()
    while True:
        groups = max(1, -(-count // GROUP))
        # of a stored table; hashed, as the number's low bits are the place in a partition and its high bits the partition
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups).cast("bigint")))
        packed = materialize(dealt.groupBy("part").applyInArrow(_pack(capacity, turn, length), schema))
        before, turn = count, turn + 1
        count = packed.filter("open").count() if groups > 1 else 0
        final = not count or 2 * count > before or turn == 32
        closed = packed if final else packed.filter("not open")
        done = closed if done is None else done.unionByName(closed)
        if final:
            return done.drop("open").toDF(*given, "sequence_id", "offset")
        left = materialize(packed.filter("open").select(*kept.columns))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None,
                   keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset."""
    return pack(token_pieces(docs, id_col, text_col, capacity, path, keep_ids), capacity)
