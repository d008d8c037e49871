"""Positional and group-aligned windows over the grid.

Rolling windows count *axis positions*, not rows: each cell's rows get the
position of their time label on the time axis, and the window is a range over
that position, so a missing day inside a cell shortens the window exactly as
a NaN would in a dense array.

Where a table has one row a cell, windows are differences of prefix sums and counts.

To keep a long series of one hot cell out of a single task, positions of an axis longer than a bucket are cut
into buckets of ``bucket`` positions; the last ``w-1`` positions of each bucket
are copied into the next one as a halo, every (cell, bucket) is windowed on
its own, and halo copies are dropped afterwards.  Each window partition holds
at most ``bucket + w - 1`` positions per cell whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcells.functions.scalar import month_of
from gridcells.model import GridTable
from gridcells.operators.axes import axis_table
from gridcells.operators.reduce import grouped, reducer
from gridcells.session import checkpoint_dir

_BUCKET = "__gc_bucket"
_HALO = "__gc_halo"


def halo_window(df: DataFrame, partition: list[str], pos: str, width: int, out, agg, bucket: int = 4096) -> DataFrame:
    """``agg`` (a function Column->Column, or a list of them with a list of
    ``out`` names) over the trailing ``width`` positions ending at each row,
    within ``partition``; rows keep their columns."""
    outs = [out] if isinstance(out, str) else list(out)
    aggs = [agg] if callable(agg) else list(agg)
    width = max(int(width), 1)
    bucket = max(int(bucket), width - 1, 1)

    def apply(frame: DataFrame, w) -> DataFrame:
        return frame.select("*", *[a(w).alias(o) for o, a in zip(outs, aggs)])

    base = df.withColumn(_BUCKET, F.floor(F.col(pos) / bucket).cast("long"))
    if width > 1:
        in_tail = (F.coalesce(F.col(pos), F.lit(0)) - F.col(_BUCKET) * bucket) >= bucket - (width - 1)
        copies = F.when(in_tail, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        base = base.withColumn(_HALO, F.explode(copies)).withColumn(
            _BUCKET, F.col(_BUCKET) + F.col(_HALO).cast("long"))
    else:
        base = base.withColumn(_HALO, F.lit(False))
    # rows without a position have no bucket either; they share one window that nobody reads, so spread them
    base = base.withColumn(_BUCKET, F.coalesce(_BUCKET, -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1024))))
    w = Window.partitionBy(*partition, _BUCKET).orderBy(pos).rangeBetween(-(width - 1), 0)
    return apply(base, w).where(~F.col(_HALO)).drop(_BUCKET, _HALO)


def _prefix_means(cells: DataFrame, columns: list[str], groups: list[str], value: str, width: int) -> DataFrame:
    """Trailing means as differences of prefix sums and counts: a frame that only grows costs one addition a row, whatever the window.
    Infinite values are counted apart, so that they end with the windows that hold them."""
    v, pos = F.col(value).cast("double"), F.col("__gc_pos")
    infinite = F.abs(v) == float("inf")
    parts = {"__gc_s": F.when(~infinite, v).otherwise(0.0), "__gc_c": v.isNotNull().cast("long"),
             "__gc_i": F.when(infinite, F.when(v > 0, F.lit(1)).otherwise(F.lit(1 << 32))).otherwise(F.lit(0)).cast("long")}
    over = Window.partitionBy(*groups).orderBy("__gc_pos")
    upto, before = over.rangeBetween(Window.unboundedPreceding, 0), over.rangeBetween(Window.unboundedPreceding, -width)
    rows = cells.select("*", *[x.alias(c) for c, x in parts.items()])
    rows = rows.select("*", *[(F.sum(c).over(upto) - F.coalesce(F.sum(c).over(before), F.lit(0))).alias(f"{c}_w") for c in parts])
    rises, falls = F.col("__gc_i_w") % (1 << 32), F.shiftright("__gc_i_w", 32)
    mean = (F.when(F.col("__gc_i_w") == 0, F.try_divide(F.col("__gc_s_w"), F.col("__gc_c_w")))
            .when((rises > 0) & (falls > 0), float("nan")).when(rises > 0, float("inf")).otherwise(float("-inf")))
    mean = F.when(pos.isNotNull() & (F.col("__gc_c_w") > 0), mean)
    if "__gc_own" in cells.columns:
        rows = rows.where("__gc_own")
    return rows.select(*[mean.alias(c) if c == value else F.col(c) for c in columns])


def _rolled_by_prefixes(grid: GridTable, cells: DataFrame, width: int, length: int, bucket: int) -> DataFrame:
    """One exchange by (cell, bucket).  Buckets (and copies at their borders) are only made where the axis is longer than one."""
    groups, bucket = grid.place(), max(int(bucket), width - 1, 1)
    if length > bucket and not grid.clustered:
        b = F.floor(F.col("__gc_pos") / bucket).cast("long")
        tail = F.coalesce(F.col("__gc_pos"), F.lit(0)) - b * bucket >= bucket - (width - 1)
        copies = F.when(tail & (F.lit(width) > 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
        cells = cells.withColumn("__gc_own", F.explode(copies)).withColumn(_BUCKET, b + (~F.col("__gc_own")).cast("long"))
        # rows without a position have no bucket either, and no window: spread them
        cells = cells.withColumn(_BUCKET, F.coalesce(_BUCKET, -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1024))))
        groups.append(_BUCKET)
    return _prefix_means(cells, grid.df.columns, groups, grid.value, width)


def rolling_mean(grid: GridTable, window: int = 3, bucket: int = 4096, frame: str = "prefix") -> GridTable:
    """Trailing mean over ``max(int(window),1)`` time-axis positions per cell,
    min_periods=1, missing skipped; same rows out as in.

    With one row a cell, sums are differences of prefix sums within a bucket; a mean is then right to about 2**-52 of the
    bucket's summed magnitudes.  ``frame="exact"`` adds up every window anew.

    On an observation table (several rows per cell and position, so one
    cell can be hot) the rows are first summed and counted per (cell,
    position); the window runs over those partial sums, one row per
    position, and the mean is joined back to the rows -- the same value as
    averaging all rows in the window."""
    t = grid.require_time("Rolling mean")
    w = max(int(window), 1)
    others = grid.other_dims(t)
    if grid.catalog is not None:
        axis, n = grid.catalog.axis(t, "__gc_pos")
    else:
        axis, n = axis_table(grid.df, t, "__gc_pos", t in grid.descending)
    cells = grid.df.join(axis, t, "left")         # a row without a time has no position, and no window
    value = grid.value
    if grid.unique_cells and frame == "prefix" and isinstance(grid.dtype(value), (T.DoubleType, T.FloatType, T.IntegralType)):
        # a clustered table needs no exchange and no buckets: all cells of a place are in one partition of the scan
        return grid.with_df(_rolled_by_prefixes(grid, cells, w, n, bucket), clustered=grid.clustered)
    if grid.unique_cells:
        out = halo_window(cells, others, "__gc_pos", w, "__gc_roll", lambda win: F.avg(value).over(win), bucket)
        return grid.with_df(out.withColumn(value, F.when(F.col("__gc_pos").isNotNull(), F.col("__gc_roll")))
                            .select(*grid.df.columns))
    parts = cells.groupBy(*others, "__gc_pos").agg(F.sum(value).alias("__gc_psum"), F.count(value).alias("__gc_pcnt"))
    rolled = halo_window(parts, others, "__gc_pos", w, ["__gc_wsum", "__gc_wcnt"],
                         [lambda win: F.sum("__gc_psum").over(win), lambda win: F.sum("__gc_pcnt").over(win)],
                         bucket)
    means = rolled.select(*others, "__gc_pos",
                          F.when(F.col("__gc_pos").isNotNull(), F.try_divide(F.col("__gc_wsum"), F.col("__gc_wcnt")))
                          .alias("__gc_roll"))
    a, b = cells.alias("__a"), means.alias("__b")
    joined = a.join(b, [F.col(f"__a.{k}").eqNullSafe(F.col(f"__b.{k}")) for k in [*others, "__gc_pos"]], "inner")
    return grid.with_df(joined.select(*[F.col("__b.__gc_roll").alias(c) if c == value else F.col(f"__a.{c}")
                                        for c in grid.df.columns]))


def monthly_anomaly(grid: GridTable, how: str = "mean", approx: bool = False, strategy: str = "auto",
                    median_strategy: str = "auto") -> GridTable:
    """value minus the per-cell climatology of its calendar month, computed on
    this (already selected) grid.

    The climatology is a grouped aggregate (partial aggregation, so
    a hot cell of a long observation table is combined map-side) joined back
    on (month, cell); AQE broadcasts it when its measured size is small and
    splits skewed join partitions otherwise.  ``strategy="window"`` asks for a
    window aggregate over (month, cell) instead: one shuffle of the cells, for
    callers who know that a cell's history is short."""
    t = grid.require_time("Anomaly")
    others = grid.other_dims(t)
    if strategy == "auto" and grid.clustered and grid.unique_cells and how != "median":
        strategy = "window"                      # no exchange: a place's cells are in one partition of the scan
    if strategy == "window":
        w = Window.partitionBy(month_of(t), *grid.place())
        base = reducer(how, grid.value).over(w)
        return grid.with_df(grid.df.withColumn(grid.value, F.col(grid.value) - base), clustered=grid.clustered)
    keyed = grid.df.withColumn("__gc_month", month_of(t))
    strat = "approx" if approx else ("counts" if median_strategy == "auto" else median_strategy)
    clim = grouped(keyed, ["__gc_month", *others], grid.value, how, strat).withColumnRenamed(grid.value, "__gc_base")
    return grid.with_df(_subtract_baseline(keyed, clim, ["__gc_month", *others], grid))


def month_baseline_anomaly(grid: GridTable, base: DataFrame) -> GridTable:
    """value minus ``__gc_base`` of its calendar month ``__gc_month`` and cell."""
    t = grid.require_time("Anomaly")
    keyed = grid.df.withColumn("__gc_month", month_of(t))
    return grid.with_df(_subtract_baseline(keyed, base, ["__gc_month", *grid.other_dims(t)], grid))


# A baseline is broadcast when its measured size is at most this.
BROADCAST_BYTES = 32 << 20


def _sized(base: DataFrame) -> DataFrame:
    """The table computed once (it has one row per cell and month at most), with a broadcast hint if
    its measured bytes are few; beyond that both sides of its join are shuffled."""
    checkpoint_dir(base.sparkSession)
    base = base.checkpoint(eager=True)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in base.dtypes if t == "string"]
    rows, size = base.agg(F.count(F.lit(1)), F.sum(sum(texts, F.lit(16 * (len(base.columns) + 1))))).first()
    return F.broadcast(base) if (size or 0) <= BROADCAST_BYTES else base


def _subtract_baseline(cells: DataFrame, base: DataFrame, keys: list[str], grid: GridTable) -> DataFrame:
    """cells.value - base.__gc_base, joined NULL-safely on ``keys``: on one hash of them, and then on
    the keys themselves."""
    cells = cells.withColumn("__gc_hash", F.xxhash64(*keys))
    base = _sized(base.withColumn("__gc_hash", F.xxhash64(*keys)))
    a, b = cells.alias("__a"), base.alias("__b")
    cond = F.col("__a.__gc_hash") == F.col("__b.__gc_hash")
    for k in keys:
        cond &= F.col(f"__a.{k}").eqNullSafe(F.col(f"__b.{k}"))
    joined = a.join(b, cond, "inner")
    return joined.select(*[(F.col(f"__a.{c}") - F.col("__b.__gc_base")).alias(c) if c == grid.value
                           else F.col(f"__a.{c}") for c in grid.df.columns])


def mean_anomaly(grid: GridTable) -> GridTable:
    """value minus the cell's mean over time (the baseline when the time dim
    carries no calendar): a grouped mean joined back to the cells."""
    t = grid.require_time("Anomaly")
    others = grid.other_dims(t)
    if not others:
        base = grid.df.select(F.avg(grid.value)).scalar()
        return grid.with_df(grid.df.withColumn(grid.value, F.col(grid.value) - base))
    means = grid.df.groupBy(*others).agg(F.avg(grid.value).alias("__gc_base"))
    return grid.with_df(_subtract_baseline(grid.df, means, others, grid))
