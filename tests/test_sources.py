import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridcells.model import GridDataset, GridTable
from gridcells.sources import arrays, readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def labels(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"position int, label {kind}")


def test_flatten_two_dimensions(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, None]]), (2, [[5.0], None, []]), (3, None), (4, [[7.0, float("nan"), 9.0]])],
                               "id int, a array<array<double>>")
    grid = arrays.flatten_grid(df, ["id"], "a", {"lat": labels(spark, [10.0, 20.0], "double"), "lon": labels(spark, ["x", "y"])})
    assert grid.dims == ("id", "lat", "lon") and grid.value == "a"
    assert sorted(map(tuple, grid.df.collect()), key=str) == sorted([
        (1, 10.0, "x", 1.0), (1, 10.0, "y", 2.0), (1, 20.0, "x", 3.0), (1, 20.0, "y", None), (2, 10.0, "x", 5.0),
        (4, 10.0, "x", 7.0), (4, 10.0, "y", None), (4, 10.0, None, 9.0)], key=str)


def test_flatten_other_numbers_of_dimensions(spark):
    df = spark.createDataFrame([(1, 2.5, [[[1], [2]], [[3], [4]]])], "id int, v double, c array<array<array<int>>>")
    assert [tuple(r) for r in arrays.flatten_grid(df, ["id"], "v", {}).df.collect()] == [(1, 2.5)]
    cube = arrays.flatten_grid(df, ["id"], "c", {"t": None, "y": None, "x": None})
    assert sorted(map(tuple, cube.df.collect())) == [(1, 0, 0, 0, 1), (1, 0, 1, 0, 2), (1, 1, 0, 0, 3), (1, 1, 1, 0, 4)]
    assert "Exchange" not in plan(cube.df)
    for axes in ({"t": None}, {"t": None, "y": None, "id": None}):
        with pytest.raises(ValueError):
            arrays.flatten_grid(df, ["id"], "c", axes)
    twice = spark.createDataFrame([(0, "a"), (0, "b")], "position int, label string")
    with pytest.raises(ValueError):
        arrays.flatten_grid(df, ["id"], "c", {"t": twice, "y": None, "x": None})
    assert arrays.flatten_grid(df.limit(0), ["id"], "c", {"t": None, "y": None, "x": None}).df.count() == 0


def days(spark, first, n, station="a"):
    return spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(first + i), station, float(i)) for i in range(n)],
                                 "time timestamp_ntz, station string, v double")


def test_parts_apart_are_not_shuffled(spark, monkeypatch):
    parts = [days(spark, 0, 5), days(spark, 5, 5), days(spark, 3, 9, "b"), days(spark, 50, 0)]
    assert readers.parts_that_meet(readers.part_bounds(parts, ["time", "station"]), ["time", "station"]) == set()
    out = readers.combine_parts(parts, ["time", "station"])
    assert out.count() == 19 and "Exchange" not in plan(out)


def test_true_overlaps_raise_and_boxes_that_only_touch_do_not(spark):
    dims = ["time", "station"]
    with pytest.raises(ValueError):
        readers.combine_parts([days(spark, 0, 5), days(spark, 9, 2), days(spark, 4, 3)], dims)
    holes = [days(spark, 0, 9).where("v % 2 = 0"), days(spark, 0, 9).where("v % 2 = 1")]
    assert readers.combine_parts(holes, dims).count() == 9
    nulls = [days(spark, i, 1).withColumn("station", F.lit(None).cast("string")) for i in (0, 1)]
    assert readers.combine_parts(nulls, dims).count() == 2
    with pytest.raises(ValueError):
        readers.combine_parts([nulls[0], days(spark, 3, 2), nulls[0]], dims)
    nan = spark.createDataFrame([(float("nan"), 1.0)], "x double, v double")
    with pytest.raises(ValueError):
        readers.combine_parts([nan, nan], ["x"])


def test_sweep_agrees_with_all_pairs():
    import random
    rng = random.Random(2)
    for _ in range(200):
        bounds = []
        for _ in range(rng.randrange(9)):
            box = {}
            for d in "ab":
                lo = rng.choice([None, *range(6)])
                box[d] = (lo, None if lo is None else lo + rng.randrange(3), lo is None or rng.random() < .2)
            bounds.append(box if rng.random() < .9 else {})
        want = {x for i, p in enumerate(bounds) for j, q in enumerate(bounds) if i < j and p and q
                and all(readers._meet(p[d], q[d]) for d in "ab") for x in (i, j)}
        assert readers.parts_that_meet(bounds, ["a", "b"]) == want


def test_many_variables_meet_in_one_exchange(spark):
    frames = {n: spark.createDataFrame([(i, None if i % 2 else "s", float(i * k))  for i in range(k, 9)], f"x int, s string, {n} double")
              for k, n in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))}
    out = readers.merge_variables(frames, ["x", "s"])
    assert plan(out).split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    got = {(r.x, r.s): (r.a, r.b, r.c, r.d) for r in out.collect()}
    assert got == {(i, None if i % 2 else "s"): tuple(float(i * k) if i >= k else None for k in (1, 2, 3, 4)) for i in range(1, 9)}
    frames["d"] = frames["d"].union(frames["d"].limit(1))
    with pytest.raises(Exception, match="cell twice"):
        readers.merge_variables(frames, ["x", "s"]).collect()
    static = spark.createDataFrame([("s", 1.0), (None, 2.0)], "s string, e double")
    both = readers.merge_variables({"a": frames["a"], "e": static, "b": frames["b"]}, ["x", "s"])
    assert {(r.x, r.s, r.e) for r in both.collect()} == {(i, None if i % 2 else "s", 2.0 if i % 2 else 1.0) for i in range(1, 9)}


def test_static_variables_are_kept_once(spark):
    height = GridTable.from_frame(spark.createDataFrame([("a", 5.0)], "station string, h double"), ("station",), "h")
    files = [GridDataset({"v": GridTable.from_frame(days(spark, k, 2), ("time", "station"), "v"), "h": height}, attrs={"by": "x", "n": str(k)})
             for k in (0, 2, 4)]
    both = readers.combine_datasets(files, "time")
    assert both.table("v").df.count() == 6 and both.table("h").df.count() == 1 and both.attrs == {"by": "x"}
