import os

import pytest
from pyspark.sql import functions as F

from gridcells.model import GridDataset
from gridcells.operators import sql
from gridcells.session import scratch_path
from gridcells.sources import arrays, guard, readers, sinks


def test_sql_mean_by_lat(spark, synthetic):
    out = sql.sql_execute(spark, {"temperature": synthetic},
                          'SELECT "lat", AVG("temperature") AS m FROM "temperature" GROUP BY "lat"')
    assert {r.lat: r.m for r in out.collect()} == {10.0: 3.5, 20.0: 5.5}


@pytest.mark.parametrize("bad", ["DELETE FROM temperature", "   ", "WITH t AS (SELECT 1) INSERT INTO temperature SELECT * FROM t"])
def test_sql_rejects(spark, synthetic, bad):
    with pytest.raises(Exception):
        sql.sql_execute(spark, {"temperature": synthetic}, bad)


def test_sql_cap_keeps_order(spark, synthetic):
    out = sql.sql_execute(spark, {"temperature": synthetic},
                          'SELECT * FROM "temperature" ORDER BY "temperature" DESC', max_rows=3)
    assert [r.temperature for r in out.collect()] == [8.0, 7.0, 6.0]


def test_combine_two_parts(spark, synthetic):
    base = scratch_path(spark, "parts")
    days = sorted({r.time for r in synthetic.df.collect()})
    for i, d in enumerate(days):
        synthetic.df.where(F.col("time") == d).write.parquet(os.path.join(base, f"part{i}.parquet"))
    paths = readers.expand_input_uris(os.path.join(base, "part*.parquet"), spark)
    assert len(paths) == 2
    parts = [readers.open_single(spark, p) for p in paths]
    assert readers.combine_parts(parts, ["time", "lat", "lon"]).count() == 8
    with pytest.raises(ValueError):
        readers.combine_parts(parts + parts[:1], ["time", "lat", "lon"])
    assert readers.combine_parts(parts + parts[:1], ["time", "lat", "lon"], on_overlap="first").count() == 8


def test_unmatched_glob_kept_literally():
    assert readers.expand_input_uris("/nonexistent/*.parquet") == ["/nonexistent/*.parquet"]


def test_merge_attrs_drops_conflicts(spark):
    meta = spark.createDataFrame([(0, "t", "units", "K"), (1, "t", "units", "K"), (0, "t", "note", "a"),
                                  (1, "t", "note", "b")], "part int, owner string, key string, value string")
    assert [(r.key, r.value) for r in readers.merge_attrs(meta).collect()] == [("units", "K")]


def test_row_guard(synthetic):
    assert guard.row_guard(synthetic.df, 8).count() == 8
    with pytest.raises(guard.RowLimitExceeded):
        guard.row_guard(synthetic.df, 7)


def test_densify_and_flatten(spark, synthetic):
    sparse = synthetic.with_df(synthetic.df.where("temperature != 3"))
    dense = arrays.densify(sparse)
    assert dense.df.count() == 8 and dense.df.where("temperature is null").count() == 1
    packed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "id long, arr array<double>")
    flat = arrays.flatten_array(packed, ["id"], "arr")
    assert sorted(tuple(r) for r in flat.collect()) == [(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0)]


def test_save_and_load_dataset_prunes_years(spark, monthly):
    path = sinks.save_dataset(GridDataset({"temperature": monthly}), scratch_path(spark, "ds"))
    loaded = sinks.load_dataset(spark, path).table("temperature")
    assert loaded.df.count() == 24 and loaded.coord_attrs["lat"]["units"] == "degrees_north"
    from gridcells.operators.select import select_grid
    sel = select_grid(loaded, time=("2024-02-01", "2024-03-01"))
    plan = sel.df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "year#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sel.df.count() == 8


def test_export_roundtrip(spark, synthetic):
    p = sinks.export_csv(synthetic.df, scratch_path(spark, "csv"))
    back = sinks.read_csv(spark, p, synthetic.df.schema)
    assert back.exceptAll(synthetic.df).count() == 0
    j = sinks.export_json(synthetic.df, scratch_path(spark, "json"))
    assert sinks.read_json(spark, j, synthetic.df.schema).exceptAll(synthetic.df).count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_open_formats_by_extension(spark, synthetic, fmt):
    path = scratch_path(spark, "fmt") + f".{fmt}"
    w = synthetic.df.write
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
    opts = {"header": "true"} if fmt == "csv" else {}
    df = readers.open_single(spark, path, schema=synthetic.df.schema, **opts)
    assert df.exceptAll(synthetic.df).count() == 0 and synthetic.df.exceptAll(df).count() == 0
    multi = readers.open_multi(spark, f"{path};{path}", schema=synthetic.df.schema, **opts)
    assert multi.count() == 16
