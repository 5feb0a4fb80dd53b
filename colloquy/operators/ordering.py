"""Order-dependent building blocks that never put a whole key into one task.

A plain Window.partitionBy("meeting_id") sends every row of one meeting to one
task. If one meeting holds a large share of all rows that task is the job. Here a
key is cut into blocks of consecutive order values; each block is one window
group, and only small per-block facts (a count, a sum, a last value, a few edge
rows) travel between blocks.

`order` is the name of a non-negative integer column; `ties` are further columns
for rows that share an order value. A block holds at most BLOCK order values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.session import materialize

BLOCK = 8192
BLOCKS_PER_GROUP = 1024
_BLK = "_blk"


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn(_BLK, F.floor(F.col(order) / block).cast("long"))


def blocks_by_count(df: DataFrame, keys: list[str], order: str, rows: int = BLOCK) -> DataFrame:
    """Blocks of equal width per key, as many as its rows fill, so that sparse order values do not make a block per row."""
    o = F.col(order)
    span = F.max(o) - F.min(o) + 1
    width = df.groupBy(*keys).agg(F.min(o).alias("_lo"), F.greatest(F.lit(1.0), span / F.ceil(F.count(F.lit(1)) / rows)).alias("_width"))
    return df.join(width, keys).withColumn(_BLK, F.floor((o - F.col("_lo")) / F.col("_width")).cast("long")).drop("_lo", "_width")


def _in_block(keys, order, ties):
    return Window.partitionBy(*keys, _BLK).orderBy(order, *ties)


def _before_block(keys):
    return Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column],
    ties: tuple[str, ...] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Inclusive running sums per key: sums inside a block plus the total of earlier blocks."""
    b = _blocked(df, order, block)
    w = _in_block(keys, order, ties).rowsBetween(Window.unboundedPreceding, 0)
    names = list(sums)
    totals = b.groupBy(*keys, _BLK).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    before = totals.select(
        *keys, _BLK, *[F.coalesce(F.sum(f"_t_{n}").over(_before_block(keys)), F.lit(0)).alias(f"_b_{n}") for n in names]
    )
    local = b.select("*", *[F.coalesce(F.sum(e).over(w), F.lit(0)).alias(f"_l_{n}") for n, e in sums.items()])
    return local.join(before, [*keys, _BLK]).select(
        *df.columns, *[(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in names]
    )


def with_position(
    df: DataFrame, keys: list[str], order: str, name: str = "pos", ties: tuple[str, ...] = (), block: int | None = BLOCK
) -> DataFrame:
    """Dense 0-based position of a row inside its key. Sparse order columns, such as item ids, take block=None: blocks by count."""
    b = blocks_by_count(df, keys, order) if block is None else _blocked(df, order, block)
    counts = b.groupBy(*keys, _BLK).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*keys, _BLK, F.coalesce(F.sum("_n").over(_before_block(keys)), F.lit(0)).alias("_off"))
    local = b.withColumn("_rn", F.row_number().over(_in_block(keys, order, ties)))
    return local.join(before, [*keys, _BLK]).select(*df.columns, (F.col("_off") + F.col("_rn") - 1).alias(name))


def carry_forward(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, str], ties: tuple[str, ...] = (), block: int = BLOCK
) -> DataFrame:
    """Last non-null value at or before the row, for each source column → new name."""
    b = _blocked(df, order, block)
    rank = F.struct(order, *ties)
    lasts = b.groupBy(*keys, _BLK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_v_{n}") for c, n in cols.items()]
    )
    before = lasts.select(
        *keys, _BLK, *[F.last(f"_v_{n}", ignorenulls=True).over(_before_block(keys)).alias(f"_b_{n}") for n in cols.values()]
    )
    w = _in_block(keys, order, ties).rowsBetween(Window.unboundedPreceding, 0)
    local = b.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"_l_{n}") for c, n in cols.items()])
    return local.join(before, [*keys, _BLK]).select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_b_{n}").alias(n) for n in cols.values()]
    )


def near_window(
    df: DataFrame,
    keys: list[str],
    order: str,
    reach: int,
    exprs: dict[str, Callable],
    ties: tuple[str, ...] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Window expressions that look at most `reach` rows back or ahead.

    Rows well inside a block see all their neighbours there. The first and last
    2·reach rows of every block are windowed once more across blocks, which is a
    few rows per block. Each expression is a function WindowSpec → Column.
    """
    w = _in_block(keys, order, ties)
    ranked = (
        _blocked(df, order, block)
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, _BLK)))
    )
    rn, n = F.col("_rn"), F.col("_n")
    at_edge = (rn <= reach) | (rn > n - reach)
    near_edge = (rn <= 2 * reach) | (rn > n - 2 * reach)
    inside = ranked.select("*", *[e(w).alias(c) for c, e in exprs.items()]).filter(~at_edge)
    across = Window.partitionBy(*keys).orderBy(order, *ties)
    edges = ranked.filter(near_edge).select("*", *[e(across).alias(c) for c, e in exprs.items()]).filter(at_edge)
    cols = [*df.columns, *exprs]
    return inside.select(*cols).unionByName(edges.select(*cols))


# --------------------------------------------------------------------------- state scan
def scan_states(
    df: DataFrame,
    keys: list[str],
    order: str,
    inputs: list[str],
    n_states: int,
    step: Callable,
    first_state: int = 0,
    name: str = "state_before",
    ties: tuple[str, ...] = (),
    block: int = BLOCK,
    group: int = BLOCKS_PER_GROUP,
) -> DataFrame:
    """State before each row of a small state machine that runs along a key.

    step(states: int array, *row_inputs) -> int array is the rule of one row. A
    reset-on-overflow loop cannot be a window sum, but a block of rows is a
    function state → state with n_states entries. Blocks are turned into such
    functions in parallel, the functions are chained (first in groups of blocks,
    then over the groups), and every block is replayed from its own entry state.
    No task sees more than one block of rows or one list of block functions. The rows
    and the replayed result are checkpointed, since both are read more than once.
    """
    key_fields = [df.schema[k] for k in keys]
    fn_schema = T.StructType([*key_fields, T.StructField(_BLK, T.LongType()), T.StructField("_fn", T.ArrayType(T.IntegerType()))])
    out_schema = T.StructType([*[f for f in df.schema.fields], T.StructField(name, T.IntegerType())])
    sort_cols = [order, *ties]
    cols = df.columns
    group_cols = [*keys, _BLK]

    def block_functions(batches):
        for part, bounds in _whole_blocks(batches, group_cols):
            values = [part[c].tolist() for c in inputs]
            out = []
            for first, end in bounds:
                live, where = np.arange(n_states, dtype=np.int64), np.arange(n_states)
                for i in range(first, end):
                    live = step(live, *[v[i] for v in values])
                    if i % 16 == 0 and len(live) > 1:
                        # different entry states soon meet: keep one copy of each
                        live, back = np.unique(live, return_inverse=True)
                        where = back[where]
                out.append(live[where].astype("int32"))
            result = part.iloc[[first for first, _ in bounds]][group_cols].copy()
            result["_fn"] = out
            yield result

    def replay(batches):
        for part, bounds in _whole_blocks(batches, group_cols):
            values = [part[c].tolist() for c in inputs]
            entry = part["_entry"].to_numpy()
            before = np.empty(len(part), dtype="int32")
            for first, end in bounds:
                state = np.array([entry[first]], dtype=np.int64)
                for i in range(first, end):
                    before[i] = state[0]
                    state = step(state, *[v[i] for v in values])
            out = part[cols].copy()
            out[name] = before
            yield out

    def sorted_blocks(rows):
        return rows.repartition(*group_cols).sortWithinPartitions(*group_cols, *sort_cols)

    b = materialize(_blocked(df, order, block))
    need = list(dict.fromkeys([*keys, _BLK, *sort_cols, *inputs]))
    fns = materialize(sorted_blocks(b.select(*need)).mapInPandas(block_functions, fn_schema))
    grouped = fns.withColumn("_grp", F.floor(F.col(_BLK) / group).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct(_BLK, "_fn")))
    lists = grouped.groupBy(*keys, "_grp").agg(ordered.alias("_l"))
    every_state = F.sequence(F.lit(0), F.lit(n_states - 1))
    chained = lists.withColumn(
        "_fn", F.aggregate("_l", every_state, lambda acc, f: F.transform(acc, lambda s: F.get(f["_fn"], s)))
    )
    group_list = chained.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_grp").alias(_BLK), "_fn"))).alias("_g"))
    group_entry = group_list.select(*keys, F.explode(_entries(F.col("_g"), F.lit(first_state))).alias("_e")).select(
        *keys, F.col(f"_e.{_BLK}").alias("_grp"), F.col("_e.state").alias("_start")
    )
    block_entry = (
        lists.join(group_entry, [*keys, "_grp"])
        .select(*keys, F.explode(_entries(F.col("_l"), F.col("_start"))).alias("_e"))
        .select(*keys, F.col(f"_e.{_BLK}").alias(_BLK), F.col("_e.state").alias("_entry"))
    )
    return materialize(sorted_blocks(b.join(block_entry, [*keys, _BLK])).mapInPandas(replay, out_schema))


def _whole_blocks(batches, group_cols):
    """Sorted rows batch by batch, cut at block ends: (rows, [(first, end) of each block]).

    A block that is split over batches is held back until it is complete, so at most
    one block is kept besides the batch at hand.
    """
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows.empty:
            continue
        groups = rows[group_cols]
        starts = np.flatnonzero((groups != groups.shift()).any(axis=1).to_numpy())
        last = starts[-1]
        if last > 0:
            yield rows.iloc[:last], list(zip(starts[:-1], starts[1:]))
        held = rows.iloc[last:].reset_index(drop=True)
    if held is not None:
        yield held, [(0, len(held))]


def _entries(functions: Column, start: Column) -> Column:
    """State on entering each function of an ordered list: array of (block, state)."""
    step = lambda acc, f: F.concat(
        acc,
        F.array(F.struct(f[_BLK].alias(_BLK), F.element_at(acc, -1)["next"].alias("state"), F.get(f["_fn"], F.element_at(acc, -1)["next"]).alias("next"))),
    )
    seed = F.array(F.struct(F.lit(-1).cast("long").alias(_BLK), F.lit(-1).alias("state"), start.cast("int").alias("next")))
    return F.filter(F.aggregate(functions, seed, step), lambda e: e[_BLK] >= 0)
