"""Preview, ordering and point thinning.

``preview`` keeps the smallest *leading hyper-rectangle* of the selection that
covers ``limit`` cells: dim i keeps its first ``k_i`` labels in stored order.  Keeping the
first k labels is a value predicate (``dim <= k-th label``, or ``>=`` on a descending axis), so the
trim is a filter that Spark pushes toward the scan, not a row LIMIT.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcells.model import GridTable
from gridcells.operators.axes import global_index, short_axis


def preview_extent(sizes: list[int], limit: int) -> list[int]:
    """Labels kept per dim: ``max(1, min(size, ceil(limit / product of the
    later dims' sizes)))``; 0 everywhere once a later dim is empty."""
    out = []
    for i, size in enumerate(sizes):
        trailing = math.prod(sizes[i + 1:])
        if trailing == 0:
            out.append(0)
            continue
        out.append(max(1, min(size, math.ceil(limit / trailing))))
    return out


def preview(grid: GridTable, limit: int = 250) -> DataFrame:
    df = grid.df
    dims = list(grid.dims)
    if limit <= 0 or not dims:
        return df
    if grid.catalog is not None:
        return grid.catalog.preview(grid, limit)
    labels = {d: df.select(d).where(F.col(d).isNotNull()).distinct() for d in dims}
    # a short axis is numbered by the job that counts it, and needs no further scan for its k-th label
    short = {d: short_axis(labels[d], d, "pos", d in grid.descending) for d in dims}
    sizes = {d: short[d][1] if short[d] else labels[d].count() for d in dims}
    keep = preview_extent([sizes[d] for d in dims], limit)
    for d, k in zip(dims, keep):
        if k >= sizes[d]:
            continue
        if k == 0:
            return df.limit(0)
        # k-th smallest label of the selection's axis (not of the rows left
        # after trimming earlier dims: trimming one dim leaves the other axes
        # whole); top-k of the distinct labels, attached as a scalar subquery
        axis = short[d][0] if short[d] else labels[d]
        if d in grid.descending:
            kth = axis.orderBy(F.col(d).desc()).limit(k).select(F.min(d)).scalar()
            df = df.where(F.col(d) >= kth)
        else:
            kth = axis.orderBy(d).limit(k).select(F.max(d)).scalar()
            df = df.where(F.col(d) <= kth)
    return df


def head(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """First ``n`` rows in key order; the remaining columns break ties, so the
    cut is deterministic even when keys repeat (a fan-out join)."""
    return df.orderBy(*keys, *[c for c in df.columns if c not in keys]).limit(n)


def sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.col(column).asc() if ascending else F.col(column).desc())


def canonical_order(grid: GridTable) -> DataFrame:
    """Row-major order of the dims in stored order (the array's natural order)."""
    return grid.df.orderBy(*(F.col(d).desc() if d in grid.descending else F.col(d) for d in grid.dims))


def linspace_positions(spark, n: int, resolution: int) -> DataFrame:
    """``unique(int(linspace(0, n-1, resolution)))`` generated by Spark from a
    range (same float steps as numpy: ``i * ((n-1)/(res-1))``, last = n-1)."""
    if resolution <= 1:
        return spark.range(1).select(F.lit(0).cast("long").alias("k"))
    step = (n - 1) / (resolution - 1)
    r = spark.range(resolution)
    pos = F.when(F.col("id") == resolution - 1, F.lit(n - 1)).otherwise(
        F.floor(F.col("id").cast("double") * F.lit(step)))
    return r.select(pos.cast("long").alias("k")).distinct()


def downsample(df: DataFrame, order_by: list[str], resolution: int) -> DataFrame:
    """At most ``resolution`` rows at evenly spread positions of the sorted
    rows; ``order_by`` must order the rows totally."""
    resolution = max(int(resolution), 1)
    indexed, n = global_index(df, order_by, "__gc_k")
    if n <= resolution:
        return df
    positions = linspace_positions(df.sparkSession, n, resolution)
    kept = indexed.join(F.broadcast(positions.withColumnRenamed("k", "__gc_k")), "__gc_k", "left_semi")
    return kept.drop("__gc_k")
