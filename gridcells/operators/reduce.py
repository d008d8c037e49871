"""Reductions over dimensions and the resample bins.

Every reduction is one ``groupBy(kept dims)``: Spark aggregates partially on
the map side before the shuffle, so a hot group never ships its raw rows.  An
exact median counts equal values first; ``approx=True`` uses a mergeable sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcells.functions.scalar import bin_label, bin_number, bin_step_months, month_of
from gridcells.model import GridTable
from gridcells.operators.selection import median_by_selection

# Reducer names the reference accepts for transforms; unknown
# names fall back to mean.
TRANSFORM_AGGREGATIONS = ("mean", "median", "min", "max", "sum")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """Exact median of ``value`` per ``keys`` group without putting a group in
    one task.

    Equal values are counted first (combined before the shuffle), so a hot group
    costs its distinct values.  The counts are range partitioned on (keys,
    value); a group's total in earlier partitions tells which one or two
    partitions hold its middle ranks, and a running count in only those finds the values.  The counts
    are checkpointed so that recomputation cannot move partition boundaries.
    Groups whose values are all missing get NULL.
    """
    from gridcells.session import checkpoint_dir

    out = out or value
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = (df.select(*keys, F.col(value).alias("__gc_v")).where(F.col("__gc_v").isNotNull())
              .groupBy(*keys, "__gc_v").agg(F.count(F.lit(1)).alias("__gc_c")))
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.col("__gc_v").asc()]
    ranged = (counts.repartitionByRange(n, *order).withColumn("__gc_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    # one row per (partition, group)
    parts = ranged.groupBy("__gc_pid", *keys).agg(F.sum("__gc_c").alias("__gc_cnt"))
    gw = Window.partitionBy(*keys)
    parts = (parts.withColumn("__gc_before", F.coalesce(F.sum("__gc_cnt").over(
                gw.orderBy("__gc_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("__gc_n", F.sum("__gc_cnt").over(gw)))
    # middle ranks (n-1) div 2 and n div 2, counted within the partition that holds them
    middle_ranks = F.array_distinct(F.array(F.floor((F.col("__gc_n") - 1) / 2).cast("long"),
                                            F.floor(F.col("__gc_n") / 2).cast("long")))
    targets = parts.select("__gc_pid", *keys, "__gc_before", "__gc_cnt", F.explode(middle_ranks).alias("__gc_rank")) \
        .where((F.col("__gc_rank") >= F.col("__gc_before"))
               & (F.col("__gc_rank") < F.col("__gc_before") + F.col("__gc_cnt"))) \
        .withColumn("__gc_rank", F.col("__gc_rank") - F.col("__gc_before"))
    a, b = ranged.alias("a"), targets.alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ["__gc_pid", *keys]]).select(
        *[F.col(f"a.{k}") for k in ["__gc_pid", *keys, "__gc_v", "__gc_c"]], "b.__gc_rank")
    upto = F.sum("__gc_c").over(Window.partitionBy("__gc_pid", *keys, "__gc_rank").orderBy("__gc_v"))
    middle = met.withColumn("__gc_upto", upto).where(
        (F.col("__gc_upto") > F.col("__gc_rank")) & (F.col("__gc_upto") - F.col("__gc_c") <= F.col("__gc_rank")))
    med = middle.groupBy(*keys).agg(F.avg("__gc_v").alias(out))
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__gc_rows")).drop("__gc_rows") if keys else None
    if groups is None:
        return med if med.count() else spark.range(1).select(F.lit(None).cast("double").alias(out))
    return groups.join(med, [groups[k].eqNullSafe(med[k]) for k in keys], "left").select(
        *[groups[k] for k in keys], med[out])


def grouped(df: DataFrame, keys: list[str], value: str, how: str, median_strategy: str = "counts") -> DataFrame:
    """``groupBy(keys).agg(reducer)`` with the median strategy applied: ``select`` (exact, by narrowing, for values that hardly
    repeat), ``counts`` (exact, by counts of equal values; both split hot groups), ``collect`` (exact, a group's values
    meet in one task) or ``approx`` (mergeable percentile sketch)."""
    if how == "median" and median_strategy == "select":
        return median_by_selection(df, keys, value)
    if how == "median" and median_strategy == "counts":
        return exact_median(df, keys, value)
    agg = reducer(how, value, median_strategy == "approx").alias(value)
    return df.groupBy(*keys).agg(agg) if keys else df.agg(agg)


def reducer(name: str, value: str, approx: bool = False, accuracy: int = 10_000) -> Column:
    """``accuracy`` bounds the rank error of the approximate median by 1 / accuracy."""
    v = F.col(value)
    if name == "median":
        return F.percentile_approx(v, 0.5, accuracy).cast("double") if approx else F.median(v)
    if name == "min":
        return F.min(v)
    if name == "max":
        return F.max(v)
    if name == "sum":
        return F.coalesce(F.sum(v), F.lit(0).cast("double"))
    return F.avg(v)


def median_strategy_for(grid: GridTable, requested: str | None, approx: bool = False) -> str:
    """``auto`` is an exact median: by narrowing for floating-point values, which hardly repeat, and by value counts for others."""
    if approx:
        return "approx"
    if requested in (None, "auto"):
        return "select" if isinstance(grid.dtype(grid.value), (T.DoubleType, T.FloatType)) else "counts"
    return requested


def reduce_dims(grid: GridTable, dims: list[str], how: str = "mean", approx: bool = False,
                median_strategy: str | None = "auto") -> GridTable:
    """Aggregate away ``dims``; remaining dims keep their order."""
    keep = [d for d in grid.dims if d not in dims]
    df = grouped(grid.df, keep, grid.value, how, median_strategy_for(grid, median_strategy, approx))
    return grid.with_df(df.select(*keep, grid.value), dims=tuple(keep), aux=(), unique_cells=True)


def spatial_mean(grid: GridTable, how: str = "mean") -> GridTable:
    """Over the dims of both horizontal coordinates (both dims of a curvilinear grid)."""
    if not grid.spatial_dims:
        raise ValueError(f"no dimension of {list(grid.dims)} is horizontal, so there is nothing to average over")
    return reduce_dims(grid, list(grid.spatial_dims), how)


def zonal_mean(grid: GridTable, how: str = "mean") -> GridTable:
    lon = grid.lon_dim
    if lon is None:
        dims = grid.role_dims("longitude", "lon")
        raise ValueError(f"longitude varies over {list(dims)}; a zonal mean needs it along one dimension" if dims
                         else f"no dimension of {list(grid.dims)} is longitude")
    return reduce_dims(grid, [lon], how)


def climatology(grid: GridTable, how: str = "mean", month_col: str = "month",
                median_strategy: str = "auto") -> GridTable:
    """Per calendar month across years; only months present appear; the time
    dim is replaced by ``month`` (placed first, other dims kept)."""
    t = grid.require_time("Climatology")
    others = grid.other_dims(t)
    keyed = grid.df.withColumn(month_col, month_of(t))
    df = grouped(keyed, [month_col, *others], grid.value, how, median_strategy_for(grid, median_strategy))
    return grid.with_df(df, dims=(month_col, *others), aux=(), unique_cells=True)


def filled_bins(df: DataFrame, binned: DataFrame, t: str, others: list[str], value: str, rule: str, step: int, how: str) -> DataFrame:
    """The resampled ``df`` with a row for every bin between the first and the last, for every cell of ``binned`` (numbered bins).

    The bins are a sequence built from two scalar subqueries and exploded per cell (no join of unrelated rows)."""
    lo = binned.select(F.to_date(bin_label(F.min(t), rule))).scalar()
    hi = binned.select(F.to_date(bin_label(F.max(t), rule))).scalar()
    bins = F.explode(F.sequence(lo, hi, F.expr(f"INTERVAL {step} MONTH")))
    cells = binned.select(*others).distinct() if others else binned.sparkSession.range(1)
    spine = cells.select(*others, bins.alias("__gc_bin")).select(F.col("__gc_bin").cast("timestamp_ntz").alias(t), *others)
    a, b = spine.alias("a"), df.alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (t, *others)], "left")
    # cells without a time have a bin of their own, outside the span
    df = met.select(*[F.col(f"a.{k}") for k in (t, *others)], F.col(f"b.{value}")).union(
        df.where(F.col(t).isNull()).select(t, *others, value))
    return df.withColumn(value, F.coalesce(value, F.lit(0.0))) if how == "sum" else df


def resample(grid: GridTable, rule: str = "QS-DEC", how: str = "mean", fill_empty: bool = False,
             median_strategy: str = "auto") -> GridTable:
    """Time bins labelled by their start.  ``fill_empty=True`` also emits bins
    inside the overall span that hold no data (value NULL, or 0 for sum), like
    the array model; the span comes from a scalar subquery.  A NULL label of another dim is a label
    like any other; cells without a time keep a NULL bin."""
    t = grid.require_time("Resample")
    others = grid.other_dims(t)
    binned = grid.df.withColumn(t, bin_number(t, rule))
    df = grouped(binned, [t, *others], grid.value, how, median_strategy_for(grid, median_strategy))
    df = df.withColumn(t, bin_label(t, rule))        # once for each group, not for each cell
    if fill_empty:
        df = filled_bins(df, binned, t, others, grid.value, rule, bin_step_months(rule), how)
    return grid.with_df(df.select(t, *others, grid.value), dims=(t, *others), aux=(), unique_cells=True)


def series_reduce(grid: GridTable, how: str = "mean") -> DataFrame:
    """Reduce every non-time dim to one series ``(time, value)``; missing
    values dropped.  (Sorting is left to the consumer; use ``orderBy``.)"""
    t = grid.require_time("Time analysis")
    if how not in ("mean", "median", "min", "max"):
        raise ValueError(f"unknown time aggregation {how!r}")
    df = grouped(grid.df.select(t, grid.value), [t], grid.value, how)
    return df.where(F.col(grid.value).isNotNull())


def focus_profile(grid: GridTable, how: str = "mean") -> GridTable:
    """Reduce a transform result to one focus dim: time, else ``month``, else a
    dim containing "lat", else the first dim."""
    dims = list(grid.dims)
    if not dims:
        return grid
    focus = grid.time_dim
    if focus is None:
        focus = "month" if "month" in dims else next((d for d in dims if "lat" in d.lower()), dims[0])
    return reduce_dims(grid, [d for d in dims if d != focus], how)
