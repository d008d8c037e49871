import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridcells.model import GridTable
from gridcells.operators import reduce, windows


def cell(df, lat=10.0, lon=70.0, t="time", v="temperature"):
    return [r[v] for r in df.where((F.col("lat") == lat) & (F.col("lon") == lon)).orderBy(t).collect()]


def test_rolling_mean(monthly):
    out = windows.rolling_mean(monthly, 3).df
    assert out.count() == 24
    assert cell(out) == [0, 2, 4, 8, 12, 16]


@pytest.mark.parametrize("bucket", [2, 3, 4, 100])
def test_rolling_mean_bucket_independent(monthly, bucket):
    assert cell(windows.rolling_mean(monthly, 3, bucket=bucket).df) == [0, 2, 4, 8, 12, 16]


def test_rolling_counts_positions_not_rows(spark):
    # the cell lacks position 1 on the time axis: window at pos 2 covers 0..2
    rows = [(dt.datetime(2024, 1, d), 0.0, v) for d, v in ((1, 1.0), (3, 5.0))]
    rows += [(dt.datetime(2024, 1, d), 1.0, 0.0) for d in (1, 2, 3)]
    g = GridTable.from_frame(spark.createDataFrame(rows, "time timestamp_ntz, lat double, v double"), ("time", "lat"), "v")
    out = windows.rolling_mean(g, 2).df.where("lat = 0").orderBy("time").collect()
    assert [r.v for r in out] == [1.0, 5.0]


def test_resample_qs_dec(monthly):
    out = reduce.resample(monthly, "QS-DEC", "mean").df
    assert out.count() == 12
    got = {r.time: r.temperature for r in out.where("lat = 10 and lon = 70").collect()}
    assert got == {dt.datetime(2023, 12, 1): 2.0, dt.datetime(2024, 3, 1): 12.0, dt.datetime(2024, 6, 1): 20.0}


def test_resample_fill_empty(spark):
    rows = [(dt.datetime(2024, 1, 15), 1.0), (dt.datetime(2024, 4, 2), 3.0)]
    g = GridTable.from_frame(spark.createDataFrame(rows, "time timestamp_ntz, v double"), ("time",), "v")
    out = reduce.resample(g, "MS", "mean", fill_empty=True).df.orderBy("time").collect()
    assert [r.v for r in out] == [1.0, None, None, 3.0]
    s = reduce.resample(g, "MS", "sum", fill_empty=True).df.orderBy("time").collect()
    assert [r.v for r in s] == [1.0, 0.0, 0.0, 3.0]


def test_climatology_months_present_only(monthly):
    out = reduce.climatology(monthly).df
    assert sorted({r.month for r in out.collect()}) == [1, 2, 3, 4, 5, 6]
    assert out.count() == 24
    src = monthly.df.select(F.month("time").alias("month"), "lat", "lon", F.col("temperature").alias("orig"))
    joined = out.join(src, ["month", "lat", "lon"])
    assert joined.count() == 24 and joined.where(F.col("temperature") != F.col("orig")).count() == 0


def test_spatial_mean(monthly):
    out = reduce.spatial_mean(monthly).df.orderBy("time").collect()
    assert [r.temperature for r in out] == [1.5, 5.5, 9.5, 13.5, 17.5, 21.5]


def test_zonal_mean(monthly):
    out = reduce.zonal_mean(monthly).df
    assert out.count() == 12
    for r in out.collect():
        i, j = r.time.month - 1, (0 if r.lat == 10 else 1)
        assert r.temperature == 4 * i + 2 * j + 0.5


def test_monthly_anomaly_single_year_is_zero(monthly):
    out = windows.monthly_anomaly(monthly).df
    assert out.count() == 24 and out.where("temperature != 0").count() == 0


def test_mean_anomaly(monthly):
    out = windows.mean_anomaly(monthly).df
    assert out.groupBy("lat", "lon").agg(F.sum("temperature").alias("s")).where("abs(s) > 1e-9").count() == 0


def test_reducers_sum_of_missing_is_zero(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, 3.0)], "x double, v double")
    g = GridTable.from_frame(df, ("x",), "v")
    got = {r.x: r.v for r in reduce.reduce_dims(g, [], "sum").df.collect()}
    assert got == {1.0: 0.0, 2.0: 3.0}
    means = {r.x: r.v for r in reduce.reduce_dims(g, [], "mean").df.collect()}
    assert means[1.0] is None


def test_spatial_mean_requires_dims(spark):
    g = GridTable.from_frame(spark.createDataFrame([(1.0, 2.0)], "a double, v double"), ("a",), "v")
    with pytest.raises(ValueError):
        reduce.spatial_mean(g)
    with pytest.raises(ValueError):
        windows.rolling_mean(g, 3)


def test_focus_profile_prefers_month(monthly):
    clim = reduce.climatology(monthly)
    out = reduce.focus_profile(clim)
    assert out.dims == ("month",) and out.df.count() == 6


@pytest.mark.parametrize("parts", [1, 5])
def test_exact_median_sorted_matches_collect(spark, parts):
    from gridcells.operators.reduce import exact_median
    import random
    rnd = random.Random(7)
    rows = [("hot", float(rnd.randint(0, 50))) for _ in range(3001)]          # one hot group, odd count
    rows += [("even", float(v)) for v in (1, 2, 3, 10)]                      # even count -> mean of middle two
    rows += [("one", 4.0), ("nulls", None), ("nulls", None), (None, 8.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.v for r in exact_median(df, ["k"], "v", num_partitions=parts).collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want and got["even"] == 2.5 and got["nulls"] is None and got[None] == 8.5


def test_anomaly_join_path_with_sorted_median(spark):
    rows = [(dt.datetime(2000 + y, m, 1), "a", float(y * 10 + m)) for y in range(3) for m in (1, 2)]
    g = GridTable.from_frame(spark.createDataFrame(rows, "time timestamp_ntz, c string, v double"), ("time", "c"), "v")
    a = {r.time: r.v for r in windows.monthly_anomaly(g, "median", median_strategy="counts").df.collect()}
    b = {r.time: r.v for r in windows.monthly_anomaly(g, "median", strategy="window").df.collect()}
    assert a == b and a[dt.datetime(2001, 1, 1)] == 0.0


def test_apply_transform_dispatch_and_summary(monthly):
    from gridcells.operators.transforms import apply_transform
    out, did = apply_transform(monthly, "spatial mean", measure=True)
    assert did.dims_after == ("time",) and did.parameters["over"] == ("lat", "lon") and did.dtype == "double"
    assert did.sizes == {"before": {"time": 6, "lat": 2, "lon": 2}, "after": {"time": 6}}
    with pytest.raises(ValueError):
        apply_transform(monthly, "warp")
    same, did = apply_transform(monthly, "none")
    assert same.dims == monthly.dims
    clim, did = apply_transform(monthly, "climatology")
    assert clim.dims == did.dims_after == ("month", "lat", "lon")
    anom, did = apply_transform(monthly, "anomaly")
    assert did.parameters["baseline"] == "mean of each month"


def test_time_analysis_modes(monthly):
    from gridcells.operators.series import time_analysis
    frame, summ = time_analysis(monthly, "mean", "trend", resolution=4)
    rows = frame.orderBy("time").collect()
    assert len(rows) == 4 and [r.time_step for r in rows] == [0, 1, 3, 5]
    assert all(abs(r.trend - r.raw) < 1e-9 for r in rows)  # the series is exactly linear
    s = summ.collect()[0]
    assert s.points == 6 and s.mean == 11.5
    cum, _ = time_analysis(monthly, "mean", "cumulative")
    assert [r.value for r in cum.orderBy("time").collect()][-1] == sum(4 * i + 1.5 for i in range(6))


def test_exact_median_hot_group_of_equal_values_spreads(spark):
    from gridcells.operators.reduce import exact_median
    rows = [("hot", 5.0)] * 4000 + [("hot", 6.0)] + [("cold", 1.0), ("cold", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r.v for r in exact_median(df, ["k"], "v", num_partitions=6).collect()}
    assert got == {"hot": 5.0, "cold": 2.0}


@pytest.mark.parametrize("bucket", [2, 5, 4096])
def test_rolling_observations_equal_direct_window(spark, bucket):
    from pyspark.sql import Window
    rows = [(dt.datetime(2024, 1, 1 + (i % 9)), "hot" if i % 3 else "cold", float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, c string, v double")
    g = GridTable.from_frame(df, ("time", "c"), "v")  # several rows per (time, c)
    out = windows.rolling_mean(g, 3, bucket=bucket).df
    pos = df.select("time").distinct().withColumn("p", F.dense_rank().over(Window.orderBy("time")))
    direct = df.join(pos, "time").withColumn(
        "v", F.avg("v").over(Window.partitionBy("c").orderBy("p").rangeBetween(-2, 0))).drop("p")
    assert out.count() == 300
    assert out.exceptAll(direct.select(*out.columns)).count() == 0


def test_filled_resample_keeps_null_labels_and_times(spark):
    rows = [(dt.datetime.fromisoformat("2024-01-01"), None, 1.0), (dt.datetime.fromisoformat("2024-01-20"), None, 3.0), (dt.datetime.fromisoformat("2024-03-01"), None, 5.0), (dt.datetime.fromisoformat("2024-03-01"), "a", 7.0), (None, "a", 9.0)]
    from gridcells.operators.transforms import apply_transform
    grid = GridTable.from_frame(spark.createDataFrame(rows, "time timestamp_ntz, station string, v double"), ("time", "station"), "v")
    out, _ = apply_transform(grid, "resample", aggregation="sum", resample_rule="MS")
    got = {(str(r.time)[:7] if r.time else None, r.station): r.v for r in out.df.collect()}
    assert got == {("2024-01", None): 4.0, ("2024-02", None): 0.0, ("2024-03", None): 5.0, ("2024-01", "a"): 0.0, ("2024-02", "a"): 0.0,
                   ("2024-03", "a"): 7.0, (None, "a"): 9.0}


def test_bars_in_numeric_order(spark):
    from gridcells.operators.charts import bar_means
    df = spark.createDataFrame([(x, float(x or 0)) for x in (10, 2, 1, None, 10, 33)], "x int, y double")
    assert [r.x for r in bar_means(df, "x", "y").collect()] == ["1", "2", "10", "33", None]


def test_densify_of_a_single_value(spark):
    from gridcells.sources.arrays import densify
    grid = GridTable(spark.createDataFrame([(4.0,)], "v double"), (), "v")
    assert [tuple(r) for r in densify(grid).df.collect()] == [(4.0,)]
