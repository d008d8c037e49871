import pytest
from pyspark.sql import functions as F

from gridcells.model import GridTable
from gridcells.operators import select
from gridcells.operators.preview import preview, preview_extent


def test_filter_out_of_range_is_empty_with_columns(synthetic):
    sel = select.select_grid(synthetic, lat=(99, 100))
    df = select.project_columns(sel)
    assert df.count() == 0
    assert df.columns == ["time", "lat", "lon", "temperature"]


def test_descending_axis_range(spark):
    rows = [(lat, lon, lat + lon) for lat in (20.0, 10.0, 0.0) for lon in (100.0, 110.0)]
    g = GridTable.from_frame(spark.createDataFrame(rows, "lat double, lon double, sst double"), ("lat", "lon"), "sst")
    out = select.select_grid(g, lat=(0, 10)).df
    assert out.count() == 4
    assert sorted({r.lat for r in out.collect()}, reverse=True) == [10.0, 0.0]
    # reversed bounds select the same cells
    rev = select.select_grid(g, lat=(10, 0)).df
    assert rev.exceptAll(out).count() == 0 and out.exceptAll(rev).count() == 0


def test_scalar_drops_dim_keeps_column(synthetic):
    sel = select.select_grid(synthetic, lat=10.0, __private=1, unknown=3)
    assert sel.dims == ("time", "lon")
    assert "lat" in sel.df.columns and sel.df.count() == 4


def test_datetime_string_is_an_instant(synthetic):
    sel = select.select_grid(synthetic, time=("2024-01", "2024-01-01"))
    assert sel.df.count() == 4


def test_filter_in_strict_missing_label(synthetic):
    with pytest.raises(KeyError):
        select.filter_in(synthetic.df, "lat", [10.0, 30.0], strict=True)
    assert select.filter_in(synthetic.df, "lat", [10.0], strict=True).count() == 4


def test_long_in_list_becomes_semi_join(spark):
    df = spark.range(5000).withColumn("v", F.col("id").cast("double"))
    out = select.filter_in(df, "id", list(range(0, 5000, 2)))
    assert out.count() == 2500


def test_first_slice_then_lat(synthetic):
    first = select.first_slice(synthetic)
    out = select.select_grid(first, lat=10.0).df
    assert out.count() == 2


def test_project_columns_filterable(synthetic):
    assert select.project_columns(synthetic, filterable=["time", "lat"]).columns == ["time", "lat", "temperature"]


def test_squeeze_drops_single_label_dims(synthetic):
    sel = select.select_grid(synthetic, lat=[10.0])
    sq = select.squeeze(sel)
    assert sq.dims == ("time", "lon") and "lat" not in sq.df.columns


def test_to_timestamp_safe_all_or_nothing(spark):
    ok = spark.createDataFrame([("2001-01-01 00:00:00",), ("2001-02-01 00:00:00",)], "time string")
    assert dict(select.to_timestamp_safe(ok, "time").dtypes)["time"] == "timestamp_ntz"
    bad = spark.createDataFrame([("2001-01-01 00:00:00",), ("2001-02-30 00:00:00",)], "time string")
    assert dict(select.to_timestamp_safe(bad, "time").dtypes)["time"] == "string"


def test_to_numeric_coerces(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r.v for r in select.coerce_numeric(df, ["v"]).collect()] == [1.5, None, None]


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (2.0, 4.0)], "x double, v double")
    g = GridTable.from_frame(df, ("x",), "v")
    assert g.df.where(F.col("v").isNull()).count() == 1


def test_preview_extent_arithmetic():
    assert preview_extent([2920, 25, 53], 250) == [1, 5, 53]
    assert preview_extent([624, 89, 180], 250) == [1, 2, 180]
    assert preview_extent([3, 0, 5], 10) == [0, 1, 5]  # an empty later dim empties the leading ones


def test_preview_leading_rectangle(synthetic):
    out = preview(synthetic, 3)
    # sizes (2,2,2), limit 3 -> keep (1, 2, 2): 4 rows, may exceed the limit
    assert out.count() == 4
    assert {r.time.day for r in out.collect()} == {1}


def test_preview_empty_selection(synthetic):
    sel = select.select_grid(synthetic, lat=(99, 100))
    out = preview(sel, 10)
    assert out.count() == 0 and out.columns == synthetic.df.columns


def test_strict_scalar_and_list(synthetic):
    with pytest.raises(KeyError):
        select.select_grid(synthetic, strict=True, lat=15.0)
    with pytest.raises(KeyError):
        select.select_grid(synthetic, strict=True, lat=[10.0, 15.0])
    assert select.select_grid(synthetic, strict=True, lat=10.0).df.count() == 4


def test_format_scalar(spark):
    from gridcells.functions.scalar import format_number, format_scalar
    df = spark.createDataFrame([(1.23456, "x"), (None, None)], "v double, s string")
    rows = df.select(format_number("v").alias("a"), format_scalar("s").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [("1.2346", "x"), ("n/a", "n/a")]


def test_preview_uses_whole_axes_on_sparse_grids(spark):
    import datetime as dt
    # day 1 lacks lat 1.0; the lat cut-off must still be the 2nd label of the axis
    rows = [(dt.datetime(2024, 1, 1), 0.0, 1.0), (dt.datetime(2024, 1, 1), 2.0, 1.0),
            (dt.datetime(2024, 1, 2), 1.0, 1.0), (dt.datetime(2024, 1, 2), 2.0, 1.0)]
    g = GridTable.from_frame(spark.createDataFrame(rows, "time timestamp_ntz, lat double, v double"),
                             ("time", "lat"), "v")
    out = preview(g, 2)  # sizes (2, 3): keep 1 day x 2 lat labels {0, 1}
    assert [(r.time.day, r.lat) for r in out.collect()] == [(1, 0.0)]


def test_datetime_literals_ignore_session_zone(spark, synthetic):
    import datetime as dt
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        for bound in ("2024-01-02", dt.datetime(2024, 1, 2)):
            sel = select.select_grid(synthetic, time=(bound, bound))
            assert sel.df.count() == 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
