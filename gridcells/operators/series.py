"""Operations on one reduced time series.

A series is a DataFrame ``(time, value)`` with unique times.  The step index
(0-based position of each point in time order, missing points dropped first)
comes from the distributed global index.  Rolling uses halo buckets
over the step index, the running sum adds per-bucket offsets computed from
bucket totals, and the trend is a single regression aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcells.operators.axes import global_index
from gridcells.operators.windows import halo_window

STEP = "time_step"


def with_time_step(series: DataFrame, time: str, value: str) -> DataFrame:
    """Drop missing points, then number the rest in time order (W7)."""
    clean = series.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    return global_index(clean, [time], STEP)[0]


def series_rolling(indexed: DataFrame, value: str, window: int, out: str = "rolling", bucket: int = 4096) -> DataFrame:
    """Trailing mean over the last ``window`` points (W2)."""
    return halo_window(indexed, [], STEP, max(int(window), 1), out, lambda w: F.avg(value).over(w), bucket)


def cumulative(indexed: DataFrame, value: str, out: str = "cumulative", bucket: int = 4096) -> DataFrame:
    """Running sum in step order (W5): totals per bucket of steps, a running sum
    over those few totals, then a window inside each bucket plus its offset."""
    b = F.floor(F.col(STEP) / bucket).cast("long")
    keyed = indexed.withColumn("__gc_b", b)
    totals = keyed.groupBy("__gc_b").agg(F.sum(value).alias("__gc_t"))
    # the same again over groups of buckets: only n / bucket^2 sums are ordered in one place
    groups = totals.withColumn("__gc_g", F.floor(F.col("__gc_b") / bucket).cast("long"))
    sums = groups.groupBy("__gc_g").agg(F.sum("__gc_t").alias("__gc_s"))
    before = sums.select("__gc_g", F.coalesce(F.sum("__gc_s").over(
        Window.orderBy("__gc_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__gc_go"))
    within = Window.partitionBy("__gc_g").orderBy("__gc_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.join(before, "__gc_g").select(
        "__gc_b", (F.col("__gc_go") + F.coalesce(F.sum("__gc_t").over(within), F.lit(0.0))).alias("__gc_off"))
    inner = Window.partitionBy("__gc_b").orderBy(STEP).rowsBetween(Window.unboundedPreceding, 0)
    return (keyed.join(offsets, "__gc_b")
            .withColumn(out, F.col("__gc_off") + F.sum(value).over(inner))
            .drop("__gc_b", "__gc_off"))


def trend_fit(indexed: DataFrame, value: str) -> DataFrame:
    """OLS of value on the step index: one row (points, slope, intercept).
    With one point the slope is NULL and the trend equals the raw value."""
    return indexed.agg(
        F.count(F.lit(1)).alias("points"),
        F.regr_slope(F.col(value), F.col(STEP).cast("double")).alias("slope"),
        F.regr_intercept(F.col(value), F.col(STEP).cast("double")).alias("intercept"),
    )


def trend_line(indexed: DataFrame, value: str, out: str = "trend") -> DataFrame:
    """Fitted value per step (W6).  The fit is one aggregate row; its two
    numbers are used as literals."""
    fit = trend_fit(indexed, value).collect()[0]
    if fit["slope"] is None:
        return indexed.withColumn(out, F.col(value))
    fitted = F.lit(float(fit["intercept"])) + F.lit(float(fit["slope"])) * F.col(STEP).cast("double")
    return indexed.withColumn(out, fitted)


def series_anomaly(indexed: DataFrame, value: str, out: str = "anomaly") -> DataFrame:
    """value minus the overall series mean (W4, series form)."""
    mean = indexed.agg(F.avg(value)).collect()[0][0]
    return indexed.withColumn(out, F.col(value) - F.lit(mean).cast("double"))


def series_summary(series: DataFrame, time: str, value: str) -> DataFrame:
    """points, start, end, mean, std (0.0 with one point) of the raw series (A15)."""
    clean = series.where(F.col(value).isNotNull())
    return clean.agg(
        F.count(F.lit(1)).alias("points"),
        F.min(time).alias("start"),
        F.max(time).alias("end"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
    )


# Time-analysis modes of the reference.
TIME_MODES = ("raw", "rolling mean", "anomaly", "cumulative", "trend")


def time_analysis(grid, how: str = "mean", mode: str = "raw", window: int = 3, resolution: int | None = None):
    """The time-analysis frame: reduce every non-time dim to one series, drop
    missing points, number them in time order, derive ``value`` by ``mode``
    (``trend`` also adds the fitted line), then, if asked, thin to ``resolution``
    evenly spread points.  Returns (frame, summary DataFrame of one row)."""
    from gridcells.operators.preview import downsample
    from gridcells.operators.reduce import series_reduce

    if mode not in TIME_MODES:
        raise ValueError(f"unknown time mode {mode!r}")
    t = grid.require_time("Time analysis")
    raw = series_reduce(grid, how).select(F.col(t).alias("time"), F.col(grid.value).alias("raw"))
    idx = with_time_step(raw, "time", "raw")
    if mode == "rolling mean":
        frame = series_rolling(idx, "raw", window, out="value")
    elif mode == "anomaly":
        frame = series_anomaly(idx, "raw", out="value")
    elif mode == "cumulative":
        frame = cumulative(idx, "raw", out="value")
    elif mode == "trend":
        frame = trend_line(idx, "raw", out="trend").withColumn("value", F.col("raw"))
    else:
        frame = idx.withColumn("value", F.col("raw"))
    frame = frame.withColumn("time_label", F.col("time").cast("string"))
    return downsample(frame, ["time"], resolution) if resolution else frame, series_summary(raw, "time", "raw")
