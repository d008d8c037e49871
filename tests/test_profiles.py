import math

from pyspark.sql import functions as F

from gridcells.model import GridTable
from gridcells.operators import charts, compare, profile, select, series
from gridcells.operators.reduce import series_reduce


def test_query_cost(synthetic):
    sel = select.select_grid(synthetic, lat=(10, 10))
    r = profile.query_cost(synthetic, sel).collect()[0]
    assert (r.selected_rows, r.full_rows, r.selection_ratio) == (4, 8, 0.5)
    assert (r.column_count, r.bytes_per_row, r.risk) == (4, 32, "low")


def test_coverage_full(synthetic):
    rows = {r.dimension: r for r in profile.coverage(synthetic.df, synthetic.df, list(synthetic.dims)).collect()}
    assert set(rows) == {"time", "lat", "lon"}
    for r in rows.values():
        assert (r.selected_unique, r.total_unique, r.selected_pct) == (2, 2, 100.0)


def test_statistics_kinds(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("a", None), (None, 3.0)], "s string, v double")
    rows = {r.column: r for r in profile.statistics(df).collect()}
    assert rows["v"].non_null == 2 and rows["v"].missing == 2 and rows["v"].mean == 2.0
    assert rows["s"].min_text == "a" and rows["s"].unique == 2 and rows["s"].mean is None
    one = spark.createDataFrame([(1.0,)], "v double")
    assert profile.statistics(one).collect()[0].std is None


def test_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "s string")
    assert profile.statistics(df).collect()[0].min_text == "a"


def test_series_trend(synthetic):
    s = series_reduce(synthetic)
    assert sorted(r.temperature for r in s.collect()) == [2.5, 6.5]
    idx = series.with_time_step(s, "time", "temperature")
    fit = series.trend_fit(idx, "temperature").collect()[0]
    assert math.isclose(fit.slope, 4.0) and math.isclose(fit.intercept, 2.5)
    summ = series.series_summary(s, "time", "temperature").collect()[0]
    assert summ.points == 2 and summ.mean == 4.5


def test_one_point_series(spark):
    import datetime as dt
    s = spark.createDataFrame([(dt.datetime(2024, 1, 1), 3.0)], "time timestamp_ntz, v double")
    idx = series.with_time_step(s, "time", "v")
    assert series.trend_line(idx, "v").collect()[0].trend == 3.0
    assert series.series_summary(s, "time", "v").collect()[0].std == 0.0


def test_compare(multi_table):
    t, h = multi_table
    joined, keys = compare.compare_join(t, h)
    assert keys == ["time", "station"] and joined.count() == 6
    cmp = compare.compare_values(joined, "temperature", "humidity")
    diffs = sorted(r.difference for r in cmp.collect())
    assert diffs == sorted([-35, -36, -35.5, -37.5, -35, -39])
    s = compare.compare_summary(cmp, "temperature", "humidity").collect()[0]
    assert round(s.primary_mean, 4) == 21.6667 and s.compare_mean == 58.0
    assert round(s.correlation, 5) == 0.98169 and round(s.difference_mean, 4) == -36.3333


def test_compare_null_key_and_zero_ratio(spark):
    a = spark.createDataFrame([(None, 1.0), ("x", 2.0)], "k string, a double")
    b = spark.createDataFrame([(None, 0.0), ("x", 4.0)], "k string, b double")
    joined, _ = compare.compare_join(GridTable(a, ("k",), "a"), GridTable(b, ("k",), "b"))
    cmp = compare.compare_values(joined, "a", "b")
    got = {r.k: r.ratio for r in cmp.collect()}
    assert got == {None: None, "x": 0.5}


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    cmp = compare.compare_values(df, "a", "b")
    assert compare.compare_summary(cmp, "a", "b").collect()[0].correlation is None


def test_no_shared_coordinates(spark):
    a = GridTable(spark.createDataFrame([(1.0, 1.0)], "x double, a double"), ("x",), "a")
    b = GridTable(spark.createDataFrame([(1.0, 1.0)], "y double, b double"), ("y",), "b")
    joined, keys = compare.compare_join(a, b)
    assert keys == [] and joined.count() == 0


def test_histogram_counts_and_constant(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"))
    h = charts.histogram(df, "v", 150).collect()
    assert len(h) == 15 and sum(r["count"] for r in h) == 1000
    import numpy as np
    counts, edges = np.histogram(np.arange(1000) % 97, bins=15)
    assert [r["count"] for r in sorted(h, key=lambda r: r.bin)] == counts.tolist()
    const = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    c = charts.histogram(const, "v", 10).collect()
    assert len(c) == 8 and min(r.left for r in c) == 1.5 and max(r.right for r in c) == 2.5


def test_spatial_bins(spark):
    import itertools
    rows = [(float(a), float(o), float(a + o)) for a, o in itertools.product(range(30), range(30))]
    df = spark.createDataFrame(rows, "lat double, lon double, v double")
    out = charts.spatial_bins(df, "lat", "lon", "v", 8)
    assert out.count() == 64
    small = charts.spatial_bins(df.where("lat < 3 and lon < 3"), "lat", "lon", "v", 8)
    assert small.count() == 9  # raw points


def test_bar_means_keeps_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", 4.0)], "x string, y double")
    got = {r.x: r.y for r in charts.bar_means(df, "x", "y").collect()}
    assert got == {None: 1.0, "a": 3.0}


def test_approx_distinct_options(spark, synthetic):
    rows = {r.column: r.unique for r in profile.statistics(synthetic.df, approx=True).collect()}
    assert rows == {"time": 2, "lat": 2, "lon": 2, "temperature": 8}
    cov = profile.coverage(synthetic.df, synthetic.df, list(synthetic.dims), approx=True).collect()
    assert all(r.selected_pct == 100.0 for r in cov)
    assert profile.query_cost(synthetic, synthetic, approx=True).collect()[0].full_rows == 8


def test_coverage_text_matches_report_format(synthetic):
    rows = {r.dimension: r for r in profile.coverage(synthetic.df, synthetic.df, list(synthetic.dims)).collect()}
    assert (rows["lat"].min, rows["lat"].max) == ("10.0000", "20.0000")
    assert rows["time"].min == "2024-01-01T00:00:00"
    empty = profile.coverage(synthetic.df.limit(0), synthetic.df, list(synthetic.dims)).collect()
    assert all(r.min == "n/a" and r.selected_unique == 0 for r in empty)
