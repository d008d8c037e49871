import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gridcells.model import CLUSTER_KEY, GridDataset, GridTable
from gridcells.operators import partials, preview, profile, reduce, select, windows
from gridcells.session import scratch_path
from gridcells.source import GridSource
from gridcells.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    df = df.drop(CLUSTER_KEY)
    return sorted((tuple(None if isinstance(v, float) and v != v else round(v, 8) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def grid(spark):
    t = F.add_months(F.lit("2001-01-01").cast("date"), (F.col("id") % 50).cast("int")).cast("timestamp_ntz")
    df = spark.range(50 * 12).where("id % 7 <> 3").select(t.alias("time"), F.when(F.col("id") % 12 != 5, F.col("id") % 4 * 1.5).alias("lat"),
                                                          (F.floor(F.col("id") / 50)).alias("lon"), F.when(F.col("id") % 11 != 0, F.sin("id")).alias("v"))
    return GridTable.from_frame(df, ("time", "lat", "lon"), "v", unique_cells=True, attrs={"units": "K"})


@pytest.fixture(scope="module")
def saved(spark, grid):
    return sinks.save_dataset(GridDataset({"v": grid}), scratch_path(spark, "it's stored"), clustered=True, num_files=5)


def test_windows_over_a_clustered_table_exchange_no_cells(spark, grid, saved):
    stored = sinks.load_dataset(spark, saved).table("v")
    assert stored.clustered and len([f for f in os.listdir(os.path.join(saved, "v").removeprefix("file:")) if f.endswith(".parquet")]) <= 5
    for build in (lambda g: windows.rolling_mean(g, 6), windows.monthly_anomaly):
        out = build(stored)
        assert "Exchange hashpartitioning" not in plan(out.df) and rows(out.df) == rows(build(grid).df)
    some = select.select_grid(stored, time=("2001-06", "2003-05"), lon=[1, 2, 5])
    want = select.select_grid(grid, time=("2001-06", "2003-05"), lon=[1, 2, 5])
    out = windows.monthly_anomaly(some)
    assert "Exchange hashpartitioning" not in plan(out.df) and rows(out.df) == rows(windows.monthly_anomaly(want).df)
    assert rows(windows.rolling_mean(some, 3).df) == rows(windows.rolling_mean(want, 3).df)


def test_another_session_registers_the_table(spark, grid, saved):
    spark.sql(f"DROP TABLE {sinks._table_name(os.path.join(saved, 'v'))}")
    stored = sinks.load_dataset(spark, saved).table("v")
    out = windows.rolling_mean(stored, 6).df
    assert "Exchange hashpartitioning" not in plan(out) and rows(out) == rows(windows.rolling_mean(grid, 6).df)


def test_axes_answer_without_cells(spark, grid, saved):
    stored = sinks.load_dataset(spark, saved).table("v")
    info = profile.dimension_info(stored)
    assert os.path.join(saved, "v/") not in plan(info) and rows(info) == rows(profile.dimension_info(grid))
    assert stored.catalog.sizes() == {"time": 50, "lat": 4, "lon": 12}
    assert rows(preview.preview(stored, 70).select("time", "lat", "lon", "v")) == rows(preview.preview(grid, 70))
    source = GridSource(GridDataset({"v": stored}))
    one = source.estimate_query_cost("v", time=("2001-06", "2002-05"))
    assert rows(one) == rows(profile.query_cost(grid, select.select_grid(grid, time=("2001-06", "2002-05"))))
    two = source.estimate_query_cost("v", time=("2001-06", "2002-05"), lat=[0.0, 99.0]).first()
    assert (two.selected_rows, two.selected_cells, two.full_rows) == (12 * 1 * 12, None, 50 * 4 * 12)
    covered = {r.dimension: (r.selected_unique, r.total_unique) for r in stored.catalog.coverage(stored, time=("2001-06", "2002-05")).collect()}
    assert covered == {"time": (12, 50), "lat": (4, 4), "lon": (12, 12)}
    files = stored.catalog.files()
    assert files.agg(F.sum("rows")).first()[0] == grid.df.count() and {"time_min", "lat_max"} <= set(files.columns)


def test_axes_follow_the_files(spark, grid):
    path = sinks.save_dataset(GridDataset({"v": grid}), scratch_path(spark, "grown"), partition_by_year=False, num_files=3)
    more = spark.createDataFrame([(dt.datetime(2030, 1, 1), 9.0, 3, 1.0)], "time timestamp_ntz, lat double, lon bigint, v double")
    more.write.mode("append").parquet(os.path.join(path, "v"))
    stored = sinks.load_dataset(spark, path).table("v")
    assert stored.catalog.sizes() == {"time": 51, "lat": 5, "lon": 12}
    first = stored.catalog.files().where("time_max < '2030'").orderBy("file").first()
    os.remove("/" + first.file.removeprefix("file:").lstrip("/"))
    again = sinks.load_dataset(spark, path).table("v")
    assert again.catalog.sizes() == {d: again.df.select(d).where(f"{d} is not null").distinct().count() for d in again.dims}
    assert again.catalog.labels("lon").agg(F.sum("rows")).first()[0] == again.df.count()


def test_tables_that_cannot_be_clustered_are_written_by_time(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0)], "t int, s string, v double")
    path = sinks.save_dataset(GridDataset({"v": GridTable(df, ("t", "s"), "v")}), scratch_path(spark, "plain"), clustered=True)
    stored = sinks.load_dataset(spark, path).table("v")
    assert not stored.clustered and rows(stored.df) == rows(df)


def test_one_aggregation_serves_all(spark, grid):
    nulls = grid.with_df(grid.df.withColumn("time", F.when(F.col("lon") != 7, F.col("time"))), unique_cells=False)
    for g in (grid, nulls):
        parts = partials.monthly_partials(g, keep=True)
        for how in partials.HOWS:
            assert rows(parts.climatology(how).df) == rows(reduce.climatology(g, how).df)
            for rule in ("MS", "QS-DEC", "YS"):
                assert rows(parts.resample(rule, how).df) == rows(reduce.resample(g, rule, how).df)
            assert rows(parts.resample("QS-DEC", how, fill_empty=True).df) == rows(reduce.resample(g, "QS-DEC", how, fill_empty=True).df)
            assert rows(parts.anomaly(how).df) == rows(windows.monthly_anomaly(g, how).df)
        with pytest.raises(ValueError):
            parts.climatology("median")
    kept = partials.load_partials(spark, grid, partials.monthly_partials(grid).save(scratch_path(spark, "parts")))
    assert rows(kept.climatology().df) == rows(reduce.climatology(grid).df)
