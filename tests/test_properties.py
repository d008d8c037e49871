"""Property checks: partition-count independence on the supplied
tables, and invariants of preview, histogram and ranges on random grids."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sample_data import SF001
from gridcells.model import GridTable
from gridcells.operators import charts, select
from gridcells.operators.preview import preview

KEYS = ["rolling_mean", "monthly_anomaly", "resample_qs_dec", "cumulative", "downsample", "preview",
        "histogram", "spatial_bins", "compare_summary", "statistics", "axis_position_distributed"]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_partition_count_independent(spark, key):
    from __spark_entry__ import queries
    q = queries()[key]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _rows(q(spark, SF001))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        seven = _rows(q(spark, SF001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == seven


cells = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 5), st.integers(0, 4),
                           st.one_of(st.none(), st.floats(-100, 100, allow_nan=False))),
                 min_size=0, max_size=60, unique_by=lambda c: c[:3])


def _grid(spark, rows):
    data = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=t), float(a), float(o), v) for t, a, o, v in rows]
    df = spark.createDataFrame(data, "time timestamp_ntz, lat double, lon double, v double")
    return GridTable.from_frame(df, ("time", "lat", "lon"), "v", unique_cells=True)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=cells, limit=st.integers(0, 40))
def test_preview_is_the_leading_rectangle(spark, rows, limit):
    from gridcells.operators.preview import preview_extent
    g = _grid(spark, rows)
    got = sorted((r.time.day, r.lat, r.lon) for r in preview(g, limit).collect())
    # brute force: rank labels per dim, keep ranks below the extent
    axes = [sorted({r[i] for r in rows}) for i in range(3)]
    keep = preview_extent([len(a) for a in axes], limit) if limit > 0 else [len(a) for a in axes]
    want = sorted((1 + t, float(a), float(o)) for t, a, o, _ in rows
                  if axes[0].index(t) < keep[0] and axes[1].index(a) < keep[1] and axes[2].index(o) < keep[2])
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=cells, res=st.integers(1, 500))
def test_histogram_total_is_non_null_count(spark, rows, res):
    g = _grid(spark, rows)
    h = charts.histogram(g.df, "v", res).collect()
    n = sum(1 for r in rows if r[3] is not None)
    assert sum(r["count"] for r in h) == n
    if n:
        assert len(h) == min(max(res // 10, 8), 40)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=cells, a=st.integers(-2, 12), b=st.integers(-2, 12))
def test_reversed_range_equals_range(spark, rows, a, b):
    g = _grid(spark, rows)
    x = select.select_grid(g, lat=(a, b)).df
    y = select.select_grid(g, lat=(b, a)).df
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0
    assert x.count() == sum(1 for r in rows if min(a, b) <= r[1] <= max(a, b))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=cells, strategy=st.sampled_from(["window", "join"]))
def test_monthly_anomaly_means_are_zero(spark, rows, strategy):
    from gridcells.operators.windows import monthly_anomaly
    g = _grid(spark, rows)
    out = monthly_anomaly(g, strategy=strategy).df
    means = out.groupBy(F.month("time"), "lat", "lon").agg(F.avg("v").alias("m")).where("abs(m) > 1e-9")
    assert means.count() == 0
    assert out.count() == len(rows)
