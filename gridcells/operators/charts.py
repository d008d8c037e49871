"""Tables behind the charts.

Bin edges follow numpy/pandas: edges are ``lo + i * step`` with the last edge
exactly ``hi``, and a value is put in the bin whose computed edges enclose it
(the division only proposes a bin; comparisons with the edges decide), so a
value sitting on an edge lands where the array libraries put it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcells.functions.scalar import to_numeric
from gridcells.model import GridTable
from gridcells.operators.select import first_slice


# Histogram bins = resolution // 10 clamped to [8, 40];
# spatial binning uses at least 4 bins per axis.
HISTOGRAM_BINS_PER_RESOLUTION = 10
HISTOGRAM_MIN_BINS, HISTOGRAM_MAX_BINS = 8, 40
SPATIAL_MIN_BINS = 4


def histogram_bins(resolution: int) -> int:
    return min(max(int(resolution) // HISTOGRAM_BINS_PER_RESOLUTION, HISTOGRAM_MIN_BINS), HISTOGRAM_MAX_BINS)


def _edge(i: Column, lo: Column, hi: Column, step: Column, n: int) -> Column:
    return F.when(i >= n, hi).otherwise(i.cast("double") * step + lo)


def histogram(df: DataFrame, column: str, resolution: int = 150) -> DataFrame:
    """Equal-width histogram of the numeric values of ``column``: one row per
    bin (empty bins included) with its edges and count.  The last bin is
    closed on both ends; a constant column spans ``value +- 0.5``.  The value
    range is one aggregate (two scalars reach the driver)."""
    n = histogram_bins(resolution)
    vals = df.select(to_numeric(column).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    lo_v, hi_v = vals.agg(F.min("v"), F.max("v")).collect()[0]
    spark = df.sparkSession
    if lo_v is None:
        return spark.createDataFrame([], "bin bigint, left double, right double, count bigint")
    if lo_v == hi_v:
        lo_v, hi_v = lo_v - 0.5, hi_v + 0.5
    lo, hi = F.lit(float(lo_v)), F.lit(float(hi_v))
    step = (hi - lo) / F.lit(float(n))
    guess = F.least(F.greatest(F.floor((F.col("v") - lo) * (F.lit(float(n)) / (hi - lo))), F.lit(0)), F.lit(n - 1))
    b = vals.withColumn("g", guess)
    b = b.withColumn("g", F.when(F.col("v") < _edge(F.col("g"), lo, hi, step, n), F.col("g") - 1).otherwise(F.col("g")))
    b = b.withColumn("g", F.when((F.col("v") >= _edge(F.col("g") + 1, lo, hi, step, n)) & (F.col("g") != n - 1),
                                 F.col("g") + 1).otherwise(F.col("g")))
    counts = b.groupBy(F.col("g").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = spark.range(n).select(F.col("id").alias("bin"))
    spine = spine.withColumn("left", _edge(F.col("bin"), lo, hi, step, n)) \
                 .withColumn("right", _edge(F.col("bin") + 1, lo, hi, step, n))
    return spine.join(counts, "bin", "left").select(
        "bin", "left", "right", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def bar_means(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of y per x (NULL group kept, last), sorted by x in its own type, and then x as text."""
    means = df.groupBy(F.col(x).alias("__gc_x")).agg(F.avg(to_numeric(y)).alias(y)).orderBy(F.asc_nulls_last("__gc_x"))
    return means.select(F.col("__gc_x").cast("string").alias(x), y)


def spatial_bins(df: DataFrame, lat: str, lon: str, value: str, bins: int = 8) -> DataFrame:
    """Mean value on an equal-width lat x lon grid (right-closed bins, bin
    midpoints as coordinates), or the raw points when there are at most
    bins^2 rows or both axes have at most ``bins`` labels."""
    bins = max(int(bins), SPATIAL_MIN_BINS)
    pts = df.select(to_numeric(lat).alias(lat), to_numeric(lon).alias(lon), to_numeric(value).alias(value)) \
        .na.drop(subset=[lat, lon, value])
    stats = pts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(lat).alias("ulat"),
                    F.count_distinct(lon).alias("ulon"), F.min(lat).alias("a"), F.max(lat).alias("b"),
                    F.min(lon).alias("c"), F.max(lon).alias("d")).collect()[0]
    if stats["n"] == 0 or stats["n"] <= bins * bins or (stats["ulat"] <= bins and stats["ulon"] <= bins):
        return pts
    nlat, nlon = min(bins, stats["ulat"]), min(bins, stats["ulon"])
    a, b, c, d = (F.lit(float(stats[k])) for k in "abcd")
    binned = pts.withColumn("__bl", _right_closed_bin(F.col(lat), a, b, nlat)) \
                .withColumn("__bo", _right_closed_bin(F.col(lon), c, d, nlon))
    grouped = binned.groupBy("__bl", "__bo").agg(F.avg(value).alias(value))
    return grouped.select(_midpoint(F.col("__bl"), a, b, nlat).alias(lat),
                          _midpoint(F.col("__bo"), c, d, nlon).alias(lon), F.col(value))


def _right_closed_bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based bin of v among n equal bins (lo, hi], first bin closed at lo."""
    span = hi - lo
    step = span / F.lit(float(n))
    guess = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.greatest(F.ceil((v - lo) * (F.lit(float(n)) / span)) - 1, F.lit(0)), F.lit(n - 1)))
    edge = lambda i: F.when(i >= n, hi).otherwise(i.cast("double") * step + lo)
    down = F.when((guess > 0) & (v <= edge(guess)), guess - 1).otherwise(guess)
    return F.when((down < n - 1) & (v > edge(down + 1)), down + 1).otherwise(down)


def _midpoint(i: Column, lo: Column, hi: Column, n: int) -> Column:
    step = (hi - lo) / F.lit(float(n))
    return lo + (i.cast("double") + F.lit(0.5)) * step


def spatial_slice(grid: GridTable, bins: int = 8) -> DataFrame:
    """First slice of every non-spatial dim, then ``spatial_bins`` of the horizontal coordinates, which
    may be dims or auxiliary coordinates of a curvilinear grid."""
    lat, lon = grid.role_column("latitude", "lat"), grid.role_column("longitude", "lon")
    if lat is None or lon is None:
        raise ValueError(f"no horizontal coordinates among {list(grid.df.columns)}")
    sliced = first_slice(grid, keep=grid.spatial_dims)
    return spatial_bins(sliced.df, lat, lon, grid.value, bins)
