"""Block-wise operators against plain loops, with blocks far smaller than a key."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.operators import ordering as o


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    return [(m, s * 3 + rnd.randint(0, 1), rnd.choice(["a", "b", None]), rnd.randint(1, 9)) for m in range(3) for s in range(50)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k int, s int, sp string, w int")


@pytest.fixture(scope="module")
def pdf(rows):
    return pd.DataFrame(rows, columns=["k", "s", "sp", "w"]).sort_values(["k", "s"])


def ordered(df):
    return df.toPandas().sort_values(["k", "s"])


def test_position_and_sums(df, pdf):
    assert ordered(o.with_position(df, ["k"], "s", block=16)).pos.tolist() == pdf.groupby("k").cumcount().tolist()
    got = ordered(o.running_sums(df, ["k"], "s", {"total": F.col("w")}, block=16))
    assert got.total.tolist() == pdf.groupby("k").w.cumsum().tolist()


def test_carry_forward(df, pdf):
    got = ordered(o.carry_forward(df, ["k"], "s", {"sp": "last"}, block=16))
    assert got["last"].fillna("").tolist() == pdf.groupby("k").sp.ffill().fillna("").tolist()


def test_near_window(df, pdf):
    got = ordered(o.near_window(df, ["k"], "s", 2, {"near": lambda w: F.collect_list("w").over(w.rowsBetween(-2, 1))}, block=16))
    want = []
    for _, g in pdf.groupby("k"):
        w = g.w.tolist()
        want += [w[max(0, i - 2) : i + 2] for i in range(len(w))]
    assert [list(x) for x in got.near] == want


def test_scan_states(df, pdf):
    got = ordered(o.scan_states(df, ["k"], "s", ["w"], 30, lambda s, w: np.where(s + w > 20, w, s + w), block=16, group=2))
    want = []
    for _, g in pdf.groupby("k"):
        c = 0
        for w in g.w:
            want.append(c)
            c = w if c + w > 20 else c + w
    assert got.state_before.tolist() == want


def test_sparse_order_values_fill_blocks_by_count(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 10_000).alias("o"))
    sizes = [r["count"] for r in o.blocks_by_count(rows, ["k"], "o", rows=1000).groupBy("k", "_blk").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 1001
    got = o.with_position(rows, ["k"], "o", block=None).filter("pos <> o div 20000")
    assert got.isEmpty()
