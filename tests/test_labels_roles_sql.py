import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridcells import session
from gridcells.model import GridTable
from gridcells.operators import profile, reduce, roles, select, sql, windows
from gridcells.operators.charts import spatial_slice
from gridcells.operators.preview import canonical_order, preview
from gridcells.operators.transforms import apply_transform
from gridcells.sources import arrays, readers


@pytest.fixture(scope="module")
def ints(spark):
    return spark.createDataFrame([(k, float(k)) for k in (0, 1, 2, 10)] + [(None, 5.0)], "k bigint, v double")


def keys(df):
    return sorted(r.k for r in df.collect())


def test_labels_on_an_integer_axis(ints):
    assert keys(select.filter_eq(ints, "k", 1.5)) == [] and keys(select.filter_eq(ints, "k", "2")) == [2]
    assert keys(select.filter_range(ints, "k", 0.5, 1.5)) == [1]
    assert keys(select.filter_in(ints, "k", [1.5])) == [] and keys(select.filter_in(ints, "k", [1.0, "10"])) == [1, 10]
    assert keys(select.filter_range(ints, "k", "2", "10")) == keys(select.filter_range(ints, "k", "10", "2")) == [2, 10]
    assert keys(select.filter_range(ints, "k", float("-inf"), 1e300)) == [0, 1, 2, 10]
    assert keys(select.filter_open_range(ints, "k", lo=1e30)) == [] and keys(select.filter_open_range(ints, "k", hi=1.99)) == [0, 1]
    with pytest.raises(KeyError):
        select.filter_in(ints, "k", [1, 1.5], strict=True)
    with pytest.raises(ValueError):
        select.filter_eq(ints, "k", "one")


def test_long_lists_are_typed_like_short_ones(ints):
    long = [x / 2 for x in range(4001)]
    assert len(long) > select.IN_LIST_LIMIT
    out = select.filter_in(ints, "k", long)
    assert keys(out) == keys(select.filter_in(ints, "k", long[:22])) == [0, 1, 2, 10]


def test_long_lists_push_a_range(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "value")
    plan = select.filter_in(df, "user_id", list(range(5, 2000)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_id" in plan and "LessThanOrEqual(user_id" in plan


def test_labels_on_date_and_decimal_axes(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 3)], "d date")
    assert select.filter_range(df, "d", "2024-01-01 12:00", "2024-01-03").count() == 2
    assert select.filter_eq(df, "d", "2024-01-02 06:00").count() == 0 and select.filter_eq(df, "d", dt.datetime(2024, 1, 2)).count() == 1
    dec = spark.range(5).select((F.col("id") / 10).cast("decimal(5,1)").alias("x"))
    assert select.filter_range(dec, "x", 0.05, 0.25).count() == 2 and select.filter_eq(dec, "x", 0.25).count() == 0


def test_rows_without_a_time_stay(spark):
    rows = [(dt.datetime(2024, 1, 1), "a", 2.0), (None, "a", 7.0)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, c string, v double")
    for unique in (True, False):
        out = windows.rolling_mean(GridTable.from_frame(df, ("time", "c"), "v", unique_cells=unique), 2).df.collect()
        assert {r.time: r.v for r in out} == {rows[0][0]: 2.0, None: None}


def test_earlier_part_wins_whole(spark):
    a = spark.createDataFrame([(1, None, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 5.0, 6.0), (2, 7.0, 8.0)], "k int, x double, y double")
    got = {tuple(r) for r in readers.combine_parts([a, b], ["k"], "first").collect()}
    assert got == {(1, None, 1.0), (2, 7.0, 8.0)}


def test_variables_without_a_shared_dim(spark):
    with pytest.raises(ValueError, match="shares no dimension"):
        readers.merge_variables({"p": spark.range(2).toDF("a"), "q": spark.range(2).toDF("b")}, ["a", "b"])


def test_open_multi_is_one_scan(spark, tmp_path):
    for i in range(3):
        spark.range(2).select(F.col("id").alias("a"), *([F.lit(i).alias("b")] if i else [])).write.parquet(str(tmp_path / f"p{i}.parquet"))
    df = readers.open_multi(spark, str(tmp_path / "p*.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    assert sorted(((r.a, r.b) for r in df.collect()), key=str) == sorted([(a, b) for b in (None, 1, 2) for a in (0, 1)], key=str)


def test_aux_coords_given_twice(spark, synthetic):
    aux = spark.createDataFrame([(10.0, "s"), (10.0, "t")], "lat double, name string")
    with pytest.raises(ValueError, match="twice"):
        select.attach_aux_coords(synthetic, aux, ["lat"], ["name"])


@pytest.fixture()
def curved(spark):
    rows = [(dt.datetime(2024, 1, t), y, x, 10.0 + y + x / 10, 70.0 + x + y / 10, float(10 * t + 2 * y + x))
            for t in (1, 2) for y in (0, 1) for x in (0, 1)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, y int, x int, yc double, xc double, v double")
    return GridTable.from_frame(df, ("time", "y", "x"), "v", aux=("yc", "xc"), aux_dims={"yc": ("y", "x"), "xc": ("y", "x")},
                                coord_attrs={"yc": {"units": "degrees_north"}, "xc": {"units": "degrees_east"}})


def test_curvilinear_grid(curved):
    out, did = apply_transform(curved, "spatial mean")
    assert did.parameters["over"] == ("y", "x") and [r.v for r in out.df.orderBy("time").collect()] == [11.5, 21.5]
    with pytest.raises(ValueError, match="one dimension"):
        apply_transform(curved, "zonal mean")
    points = spatial_slice(roles.with_roles(curved)).collect()
    assert {(r.yc, r.xc, r.v) for r in points} == {(10.0, 70.0, 10.0), (10.1, 71.0, 11.0), (11.0, 70.1, 12.0), (11.1, 71.1, 13.0)}


def test_axes_known_by_their_units(curved):
    plain = GridTable.from_frame(curved.df.select("time", "y", "x", "v"), ("time", "y", "x"), "v",
                                 coord_attrs={"y": {"units": "degrees_north"}, "x": {"units": "degrees_east"}})
    out, _ = apply_transform(plain, "zonal mean")
    assert out.dims == ("time", "y") and out.df.count() == 4


def test_empty_bins_of_a_transform(spark):
    rows = [(dt.datetime(2024, 1, 15), 1.0), (dt.datetime(2024, 4, 2), 3.0)]
    g = GridTable.from_frame(spark.createDataFrame(rows, "time timestamp_ntz, v double"), ("time",), "v")
    assert [r.v for r in apply_transform(g, "resample", resample_rule="MS")[0].df.orderBy("time").collect()] == [1.0, None, None, 3.0]


def test_descending_axis(synthetic):
    down = replace(synthetic, descending=("time", "lat"))
    assert {r.time.day for r in select.first_slice(down).df.collect()} == {2}
    assert {(r.time.day, r.lat) for r in preview(down, 2).collect()} == {(2, 20.0)}
    first = canonical_order(down).first()
    assert (first.time.day, first.lat, first.lon) == (2, 20.0, 70.0)
    meta = {r.column: (r.start, r.end) for r in roles.coord_metadata(down).collect()}
    assert meta["lat"] == ("20.0", "10.0") and meta["lon"] == ("70.0", "80.0")
    rolled = {(r.time.day, r.lat, r.lon): r.temperature for r in windows.rolling_mean(down, 2).df.collect()}
    assert rolled[2, 10.0, 70.0] == 5.0 and rolled[1, 10.0, 70.0] == 3.0


def test_labels_of_any_axis(spark):
    df = spark.range(3000).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("c"), F.lit(1.0).alias("v"))
    out = profile.dimension_labels(GridTable.from_frame(df, ("c",), "v"))
    assert out.count() == 3000 and out.where("position = 2999").first().label == "s02999"


def test_densify_has_no_size_limit_or_label_arrays(spark):
    df = spark.range(1500).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"), F.lit(1.0).alias("v"))
    dense = arrays.densify(GridTable.from_frame(df, ("a", "b"), "v"))
    assert dense.df.count() == 4500 and dense.df.where("v is not null").count() == 1500


def test_median_of_a_time_uses_counts(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), float(i % 5)) for i in range(1000)], "time timestamp_ntz, v double")
    assert reduce.series_reduce(GridTable.from_frame(df, ("time",), "v"), "median").collect()[0].v == 2.0


# ---- SQL ------------------------------------------------------------------------------------

def test_no_default_cap(spark):
    assert sql.sql_execute(spark, {"t": spark.range(6000)}, "SELECT * FROM t").count() == 6000


@pytest.mark.parametrize("bad", [
    "DELETE FROM t", " ; ", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT * FROM other",
    "SELECT Reflect ('java.lang.System', 'getProperty', 'user.dir')", "SELECT java_method('java.lang.Math', 'random')",
    "SELECT * FROM (SELECT try_reflect('java.lang.Math', 'random')) x", "SELECT (SELECT max(id) FROM secret) FROM t",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/events.parquet`"])
def test_guard(spark, bad):
    spark.range(3).createOrReplaceTempView("secret")
    with pytest.raises(sql.RejectedQuery):
        sql.sql_execute(spark, {"t": spark.range(3)}, bad)


def test_guard_lets_ordinary_queries_through(spark):
    q = "WITH a AS (SELECT id FROM t) SELECT id, 'reflect(x)' AS s FROM a WHERE id IN (SELECT max(id) FROM T) -- java_method("
    assert [tuple(r) for r in sql.sql_execute(spark, {"t": spark.range(3)}, q).collect()] == [(2, "reflect(x)")]


def test_views_are_as_before(spark):
    spark.range(7).createOrReplaceTempView("mine")
    out = sql.sql_execute(spark, {"mine": spark.range(2), "fleeting": spark.range(1)}, "SELECT count(*) AS n FROM mine")
    assert out.first().n == 2 and spark.table("mine").count() == 7
    assert "fleeting" not in {t.name for t in spark.catalog.listTables()}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_plain_rounding(spark):
    g = GridTable.from_frame(spark.range(8100).select(F.col("id").alias("a"), F.lit(1.0).alias("v")), ("a",), "v")
    part = g.df.where("a < 1000")                      # 12.3456...
    assert profile.coverage(part, g.df, ["a"]).first().selected_pct == 12.3
    assert profile.statistics(spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (1.5,)], "x double")).first().unique == 2


GUARDED = ["SELECT `reflect`('java.lang.System', 'getProperty', 'user.dir')", "SELECT \"reflect\"('java.lang.System', 'getProperty', 'user.dir')",
           "SELECT reflect/**/('java.lang.System', 'getProperty', 'user.dir')", "SELECT java_method /*x*/ ('java.lang.System', 'getProperty', 'user.dir')",
           "WITH other AS (SELECT * FROM other) SELECT * FROM other", "WITH a AS (WITH b AS (SELECT * FROM other) SELECT * FROM b) SELECT * FROM a",
           "SELECT (SELECT max(x) FROM other) FROM mine", "SELECT * FROM mine WHERE EXISTS (SELECT 1 FROM other WHERE other.x = mine.x)",
           "SELECT * FROM mine JOIN LATERAL (SELECT * FROM other WHERE other.x = mine.x)", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM default.mine",
           "SELECT 1) AS a, (SELECT 2", "SELECT 1; SELECT 2", "WITH t AS (SELECT 1) INSERT INTO mine SELECT * FROM t", "EXPLAIN SELECT 1",
           "SELECT max(upper(try_reflect('java.lang.System', 'getProperty', 'user.dir'))) OVER () FROM mine"]
ALLOWED = ["WITH mine2 AS (SELECT x + 1 AS x FROM mine), m AS (SELECT * FROM mine2) SELECT a.x FROM m a JOIN mine b ON a.x = b.x",
           "WITH mine AS (SELECT x FROM mine) SELECT * FROM mine", "SELECT 'reflect(1)' AS x -- java_method(\nFROM mine",
           "SELECT * FROM VALUES (1), (2) AS t(x)", "SELECT x FROM MINE WHERE x IN (SELECT max(x) FROM mine)", "SELECT id FROM range(3)"]


@pytest.mark.parametrize("query", GUARDED)
def test_guard_rejects_by_the_plan(spark, query):
    from gridcells.operators.sql import RejectedQuery, sql_execute
    spark.range(4).selectExpr("id AS x").createOrReplaceTempView("other")
    try:
        with pytest.raises(RejectedQuery):
            sql_execute(spark, {"mine": spark.range(3).selectExpr("id AS x")}, query)
    finally:
        spark.catalog.dropTempView("other")


@pytest.mark.parametrize("query", ALLOWED)
def test_guard_accepts_own_tables(spark, query):
    from gridcells.operators.sql import sql_execute
    assert sql_execute(spark, {"mine": spark.range(3).selectExpr("id AS x")}, query).count() > 0
