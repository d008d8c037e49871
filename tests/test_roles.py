from gridcells.model import GridTable
from gridcells.operators import roles


def test_synthetic_roles(synthetic):
    got = roles.detect_roles(synthetic)
    assert got == {"time": "time", "latitude": "lat", "longitude": "lon", "vertical": None}
    scores = {r.column: r.best_score for r in roles.column_roles(synthetic).collect()}
    assert scores == {"time": 18, "lat": 17, "lon": 17}


def test_cf_attributes(spark):
    df = spark.createDataFrame([(0, 10.0, 20.0, 1000.0, 280.0)],
                               "forecast_reference_time bigint, y double, x double, isobaric double, air double")
    attrs = {
        "forecast_reference_time": {"standard_name": "time", "units": "hours since 2024-01-01 00:00:00", "axis": "T"},
        "y": {"units": "degrees_north", "axis": "Y"},
        "x": {"units": "degrees_east", "axis": "X"},
        "isobaric": {"standard_name": "air_pressure", "units": "hPa", "positive": "down", "axis": "Z"},
    }
    g = GridTable(df, ("forecast_reference_time", "y", "x", "isobaric"), "air", coord_attrs=attrs)
    assert roles.detect_roles(g) == {"time": "forecast_reference_time", "latitude": "y", "longitude": "x",
                                     "vertical": "isobaric"}


def test_generic_xy_stays_unassigned(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "y double, x double, intensity double")
    got = roles.detect_roles(GridTable(df, ("y", "x"), "intensity"))
    # bounds alone (4 points) do not reach the threshold
    assert got["latitude"] is None and got["longitude"] is None


def test_curvilinear_aux(spark):
    rows = [(y, x, 50.0 + y, 200.0 + x, float(y * 3 + x)) for y in range(2) for x in range(3)]
    df = spark.createDataFrame(rows, "y bigint, x bigint, yc double, xc double, sst double")
    g = GridTable(df, ("y", "x"), "sst", aux=("yc", "xc"), aux_dims={"yc": ("y", "x"), "xc": ("y", "x")},
                  coord_attrs={"yc": {"units": "degrees_north"}, "xc": {"units": "degrees_east"}})
    assert roles.detect_roles(g)["latitude"] == "yc"
    meta = {r.column: r for r in roles.coord_metadata(g).collect()}
    assert meta["yc"].curvilinear and meta["xc"].curvilinear and not meta["y"].curvilinear


def test_enrich_schema(spark):
    schema = spark.createDataFrame([("lat", "number"), ("temperature", "number")], "column string, type string")
    meta = spark.createDataFrame([("temperature", "description", "Air temperature"), ("temperature", "units", "degC")],
                                 "column string, key string, value string")
    role = spark.createDataFrame([("lat", "latitude")], "column string, role string")
    rows = {r.column: r for r in roles.enrich_schema(schema, meta, role).collect()}
    assert rows["temperature"].unit == "degC" and rows["temperature"].description == "Air temperature"
    assert rows["lat"].role == "latitude"


def test_table_metadata(spark, synthetic):
    from gridcells.model import GridDataset
    g = GridTable(synthetic.df, synthetic.dims, synthetic.value, attrs={"long_name": "Air temperature"},
                  coord_attrs={"lat": {"long_name": "Latitude"}})
    rows = {r.column: r for r in roles.table_metadata(spark, GridDataset({"temperature": g})).collect()}
    assert rows["temperature"].description == "Air temperature"
    assert rows["lat"].column_description == "Latitude" and rows["lon"].column_description == "lon coordinate"
    assert rows["time"].dims == "time,lat,lon"


def test_table_metadata_lists_input_files(spark):
    from gridcells.model import GridDataset
    from sample_data import SF001
    from gridcells.plans import grids
    li = grids.lineitem_grid(spark, SF001)
    rows = roles.table_metadata(spark, GridDataset({"li": li})).collect()
    assert rows and all(r.source_uris.endswith("lineitem.parquet") for r in rows)
