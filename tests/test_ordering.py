import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridcells.operators import series
from gridcells.operators.axes import global_index
from gridcells.operators.preview import downsample
from gridcells.operators.windows import halo_window


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_global_index_dense_and_ordered(spark, parts):
    df = spark.range(0, 3000, 3).select((F.col("id") * 7 % 3000).alias("x")).distinct()
    out, n = global_index(df, ["x"], "k", num_partitions=parts)
    assert n == df.count()
    rows = sorted((r.k, r.x) for r in out.collect())
    assert [k for k, _ in rows] == list(range(len(rows)))
    assert [x for _, x in rows] == sorted(x for _, x in rows)


def test_downsample_matches_linspace(spark):
    df = spark.range(1000).select(F.col("id").alias("t"), (F.col("id") * 2).alias("v"))
    out = sorted(r.t for r in downsample(df, ["t"], 37).collect())
    assert out == np.unique(np.linspace(0, 999, 37, dtype=int)).tolist()
    assert downsample(df, ["t"], 5000).count() == 1000


@pytest.mark.parametrize("bucket", [1, 4, 50, 10000])
def test_halo_window_equals_direct(spark, bucket):
    df = spark.range(400).where("id % 7 != 3").select(
        (F.col("id") % 3).alias("cell"), F.col("id").alias("pos"), (F.col("id") * 1.5).alias("v"))
    w = 9
    direct = df.withColumn("r", F.avg("v").over(Window.partitionBy("cell").orderBy("pos").rangeBetween(-(w - 1), 0)))
    halo = halo_window(df, ["cell"], "pos", w, "r", lambda win: F.avg("v").over(win), bucket)
    assert halo.count() == df.count()
    assert direct.exceptAll(halo.select(*direct.columns)).count() == 0


def test_cumulative_equals_direct(spark):
    import datetime as dt
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(i % 5)) for i in range(0, 300, 2)]
    s = spark.createDataFrame(rows, "time timestamp_ntz, v double")
    idx = series.with_time_step(s, "time", "v")
    cum = series.cumulative(idx, "v", bucket=16).orderBy("time").collect()
    assert [r.cumulative for r in cum] == np.cumsum([v for _, v in rows]).tolist()
    roll = series.series_rolling(idx, "v", 4, bucket=5).orderBy("time").collect()
    expect = [np.mean([v for _, v in rows][max(0, i - 3): i + 1]) for i in range(len(rows))]
    assert np.allclose([r.rolling for r in roll], expect)
