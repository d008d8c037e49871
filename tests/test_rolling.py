import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridcells.model import GridTable
from gridcells.operators import windows


def plain(rows, width, descending=False):
    axis = sorted({t for t, _, _, _ in rows if t is not None}, reverse=descending)
    at = {t: i for i, t in enumerate(axis)}
    out = []
    for t, x, s, _ in rows:
        near = [v for u, y, r, v in rows if t is not None and u is not None and (repr(y), r) == (repr(x), s) and v is not None
                and at[t] - width < at[u] <= at[t]]
        out.append((t, repr(x), s, round(sum(near) / len(near), 9) if near else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,bucket", [(1, 4096), (3, 4096), (12, 5), (40, 4096), (7, 6), (3, 1)])
def test_as_stated(spark, width, bucket):
    rng = random.Random(width * 100 + bucket)
    rows = []
    for x in (1.5, None, float("nan"), 2.0):
        for s in ("a", None, ""):
            for d in range(40):
                if rng.random() < .6:
                    rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(d), x, s, None if rng.random() < .2 else rng.choice([1e3, -1e3, rng.random()])))
    rows += [(None, 1.5, "a", 3.0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, x double, s string, v double").repartition(5)
    for descending in ((), ("time",)):
        grid = GridTable(df, ("time", "x", "s"), "v", unique_cells=True, descending=descending)
        out = windows.rolling_mean(grid, width, bucket=bucket)
        got = sorted(((r.time, repr(r.x), r.s, None if r.v is None else round(r.v, 9)) for r in out.df.collect()), key=str)
        want = plain(rows, width, bool(descending))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        for g, w in zip(got, want):
            assert (g[3] is None) == (w[3] is None) and (w[3] is None or abs(g[3] - w[3]) <= 2e-9)


def test_infinite_values_end_with_their_windows(spark):
    inf = float("inf")
    values = [1.0, inf, 2.0, 3.0, 4.0, -inf, inf, 5.0, None, None, None, 6.0]
    df = spark.createDataFrame(list(enumerate(values)), "time int, v double")
    grid = GridTable(df, ("time",), "v", roles={"time": "time"}, unique_cells=True)
    got = [r.v for r in windows.rolling_mean(grid, 3).df.orderBy("time").collect()]
    assert repr(got) == repr([1.0, inf, inf, inf, 3.0, -inf, float("nan"), float("nan"), inf, 5.0, None, 6.0])
    exact = [r.v for r in windows.rolling_mean(grid, 3, frame="exact").df.orderBy("time").collect()]
    assert repr(exact) == repr(got)


def test_without_other_dims(spark):
    df = spark.range(50).select(F.col("id").cast("int").alias("time"), F.col("id").cast("int").alias("v"))
    grid = GridTable(df, ("time",), "v", roles={"time": "time"}, unique_cells=True)
    got = {r.time: r.v for r in windows.rolling_mean(grid, 4).df.collect()}
    assert got == {i: sum(range(max(0, i - 3), i + 1)) / min(4, i + 1) for i in range(50)}
    assert windows.rolling_mean(grid.with_df(df.limit(0)), 4).df.count() == 0
