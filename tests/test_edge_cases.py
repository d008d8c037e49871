"""FIXTURES F11: missing values, empty grids, constant columns, one-row
series, zero denominators, gaps, NULL keys."""

import datetime as dt


from gridcells.model import GridTable
from gridcells.operators import charts, compare, profile, reduce, select, series, windows
from gridcells.operators.preview import downsample, preview
from gridcells.sources import arrays


def _grid(spark, rows, unique=True):
    df = spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, v double")
    return GridTable.from_frame(df, ("time", "lat", "lon"), "v", unique_cells=unique)


def D(day):
    return dt.datetime(2024, 1, day)


def test_empty_grid_everywhere(spark):
    g = _grid(spark, [])
    assert reduce.spatial_mean(g).df.count() == 0
    assert reduce.resample(g, "MS").df.count() == 0
    assert windows.rolling_mean(g, 3).df.count() == 0
    assert windows.monthly_anomaly(g).df.count() == 0
    assert preview(g, 10).count() == 0
    assert charts.histogram(g.df, "v").count() == 0
    assert charts.spatial_bins(g.df, "lat", "lon", "v").count() == 0
    stats = {r.column: r for r in profile.statistics(g.df).collect()}
    assert stats["v"].non_null == 0 and stats["v"].mean is None
    assert downsample(g.df, ["time", "lat", "lon"], 5).count() == 0
    assert profile.query_cost(g, g).collect()[0].full_rows == 0


def test_nan_and_null_cells_are_missing(spark):
    g = _grid(spark, [(D(1), 0.0, 0.0, float("nan")), (D(1), 0.0, 1.0, None), (D(1), 1.0, 0.0, 4.0),
                      (D(2), 0.0, 0.0, 2.0)])
    got = {r.time.day: r.v for r in reduce.spatial_mean(g).df.collect()}
    assert got == {1: 4.0, 2: 2.0}
    sums = {(r.lat, r.lon): r.v for r in reduce.reduce_dims(g, ["time"], "sum").df.collect()}
    assert sums[(0.0, 1.0)] == 0.0  # sum of an all-missing cell is 0
    med = {(r.lat, r.lon): r.v for r in reduce.reduce_dims(g, ["time"], "median").df.collect()}
    assert med[(0.0, 1.0)] is None and med[(0.0, 0.0)] == 2.0
    roll = {(r.time.day, r.lat, r.lon): r.v for r in windows.rolling_mean(g, 2).df.collect()}
    assert roll[(2, 0.0, 0.0)] == 2.0 and roll[(1, 0.0, 1.0)] is None


def test_densify_then_drop_restores_cells(spark):
    g = _grid(spark, [(D(1), 0.0, 0.0, 1.0), (D(2), 1.0, 1.0, 2.0)])
    dense = arrays.densify(g)
    assert dense.df.count() == 8
    assert select.drop_missing(dense.df, ["v"]).count() == 2


def test_one_row_series_and_gaps(spark):
    s = spark.createDataFrame([(D(1), 1.0), (D(5), 3.0), (D(9), None)], "time timestamp_ntz, v double")
    idx = series.with_time_step(s, "time", "v")
    assert sorted(r.time_step for r in idx.collect()) == [0, 1]  # missing point dropped before numbering
    roll = {r.time.day: r.rolling for r in series.series_rolling(idx, "v", 2).collect()}
    assert roll == {1: 1.0, 5: 2.0}  # gaps in time do not matter: windows count points
    one = series.with_time_step(s.where("v = 1.0"), "time", "v")
    assert series.trend_fit(one, "v").collect()[0].slope is None


def test_zero_denominator_and_constant_sides(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)], "a double, b double")
    cmp = compare.compare_values(df, "a", "b")
    assert all(r.ratio is None for r in cmp.collect())
    s = compare.compare_summary(cmp, "a", "b").collect()[0]
    assert s.correlation is None and s.ratio_mean is None and s.rows_joined == 3


def test_single_point_pairs_correlation_null(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert compare.compare_summary(compare.compare_values(df, "a", "b"), "a", "b").collect()[0].correlation is None


def test_reversed_range_and_null_key(spark):
    g = _grid(spark, [(D(1), 5.0, 0.0, 1.0), (D(1), 15.0, 0.0, 2.0)])
    assert select.select_grid(g, lat=(10, 0)).df.count() == 1
    a = spark.createDataFrame([(None, 1.0)], "k string, a double")
    b = spark.createDataFrame([(None, 3.0)], "k string, b double")
    joined, keys = compare.compare_join(GridTable(a, ("k",), "a"), GridTable(b, ("k",), "b"))
    assert keys == ["k"] and joined.count() == 1


def test_constant_histogram_and_statistics(spark):
    df = spark.createDataFrame([(7.0,)] * 5, "v double")
    h = charts.histogram(df, "v", 80).collect()
    assert sum(r["count"] for r in h) == 5 and len(h) == 8
    st = profile.statistics(df).collect()[0]
    assert st.std == 0.0 and st.unique == 1
