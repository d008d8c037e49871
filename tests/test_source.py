import os

import pytest

from gridcells.model import GridDataset
from gridcells.session import scratch_path
from gridcells.source import GridSource
from gridcells.sources.guard import RowLimitExceeded


def test_source_requires_input():
    with pytest.raises(ValueError):
        GridSource()


def test_source_api(spark, synthetic):
    src = GridSource(GridDataset({"temperature": synthetic}), max_rows=6)
    assert src.get_tables() == ["temperature"]
    assert src.get("temperature", lat=(10, 10)).count() == 4
    with pytest.raises(RowLimitExceeded):
        src.get("temperature").count()
    assert src.sample("temperature", limit=2).count() == 2
    cost = src.estimate_query_cost("temperature", lat=(10, 10)).collect()[0]
    assert cost.selected_rows == 4 and cost.full_rows == 8
    assert {r.column for r in src.get_schema("temperature").collect()} == {"time", "lat", "lon", "temperature"}
    assert src.get_dimension_info("temperature").count() == 3 and src.describe().count() == 3
    assert len(src.example_queries()) == 4
    out = src.execute('SELECT "lat", AVG("temperature") AS m FROM "temperature" GROUP BY "lat"')
    assert {r.lat: r.m for r in out.collect()} == {10.0: 3.5, 20.0: 5.5}
    grid, did = src.transform("temperature", "spatial mean", query={"time": ("2024-01-01", "2024-01-01")}, squeeze=True)
    assert did.dims_after == () and grid.df.collect()[0].temperature == 2.5
    assert {r.column: r.selected_role for r in src.coordinate_roles("temperature").collect()}["lat"] == "latitude"


def test_source_from_uri_globs(spark, synthetic):
    base = scratch_path(spark, "uri")
    synthetic.df.where("lat = 10").write.parquet(os.path.join(base, "a.parquet"))
    synthetic.df.where("lat = 20").write.parquet(os.path.join(base, "b.parquet"))
    src = GridSource(uri=os.path.join(base, "*.parquet"), spark=spark, dims=("time", "lat", "lon"), value="temperature")
    assert src.dataset.source_mode == "multi" and len(src.dataset.source_uris) == 2
    assert src.get("temperature").count() == 8
