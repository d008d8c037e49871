"""Stored axes of a saved dataset: what a table's dimensions hold, without reading its cells.

Written beside each table: for every dim its labels with the number of rows that have each, per data file
(``axes/<dim>``), and per file its size, row count and bounds (``files``).  Sizes, bounds, positions and row counts of a
dim are sums over these small tables.  ``refresh`` reads only files that are new or changed, and forgets those that are gone.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.model import GridTable
from gridcells.operators.axes import axis_table
from gridcells.operators.preview import preview_extent

_FILE = ("file", "bytes", "changed")


def _with_file(cells: DataFrame) -> DataFrame:
    return cells.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
                        F.col("_metadata.file_modification_time").cast("string").alias("changed"))


def _axis_rows(tagged: DataFrame, dim: str) -> DataFrame:
    return tagged.groupBy(*_FILE, F.col(dim).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def write_axes(cells: DataFrame, dims: list[str], path: str, only: list[str] | None = None, mode: str = "overwrite") -> None:
    """One grouped pass a dim over that dim's column (``only``: of these files)."""
    tagged = _with_file(cells)
    if only is not None:
        tagged = tagged.where(F.col("file").isin(only))
    for d in dims:
        _axis_rows(tagged, d).coalesce(1).write.mode(mode).parquet(os.path.join(path, "axes", d))
    bounds = [x for d in dims for x in (F.min(d).cast("string").alias(f"{d}_min"), F.max(d).cast("string").alias(f"{d}_max"))]
    tagged.groupBy(*_FILE).agg(F.count(F.lit(1)).alias("rows"), *bounds).coalesce(1).write.mode(mode).parquet(os.path.join(path, "files"))


@dataclass(frozen=True)
class AxisCatalog:
    """The axes of one table; every method reads only the stored axes."""

    spark: SparkSession
    path: str
    dims: tuple[str, ...]
    descending: tuple[str, ...] = ()
    gone: tuple[str, ...] = field(default=())            # files that are no longer part of the table

    def labels(self, dim: str) -> DataFrame:
        """``<dim>, rows`` of the labels, NULL included."""
        rows = self.spark.read.parquet(os.path.join(self.path, "axes", dim))
        if self.gone:
            rows = rows.where(~F.concat_ws("|", "file", "changed").isin(*self.gone))
        return rows.groupBy(F.col("label").alias(dim)).agg(F.sum("rows").alias("rows"))

    def files(self) -> DataFrame:
        out = self.spark.read.parquet(os.path.join(self.path, "files"))
        return out.where(~F.concat_ws("|", "file", "changed").isin(*self.gone)) if self.gone else out

    def axis(self, dim: str, pos_col: str = "pos") -> tuple[DataFrame, int]:
        return axis_table(self.labels(dim), dim, pos_col, dim in self.descending)

    def sizes(self) -> dict[str, int]:
        return {d: self.labels(d).where(F.col(d).isNotNull()).count() for d in self.dims}

    def selected(self, **query) -> dict[str, DataFrame]:
        """The labels of each dim that a selection keeps."""
        from gridcells.operators.select import select_grid

        out = {}
        for d in self.dims:
            axis = GridTable(self.labels(d), (d,), "rows")
            out[d] = select_grid(axis, **{d: query[d]}).df if d in query else axis.df
        return out

    def dimension_info(self, grid: GridTable) -> DataFrame:
        """As ``profile.dimension_info``."""
        out = None
        for d in self.dims:
            kind = "datetime" if grid.is_time(d) else "numeric" if grid.is_numeric(d) else "categorical"
            row = self.labels(d).agg(F.count(d).alias("size"), F.min(d).cast("string").alias("min"), F.max(d).cast("string").alias("max")).select(
                F.lit(d).alias("dimension"), F.lit(grid.dtype(d).simpleString()).alias("dtype"), "size", F.lit(kind).alias("kind"), "min", "max")
            out = row if out is None else out.union(row)
        return out

    def coverage(self, grid: GridTable, **query) -> DataFrame:
        """As ``profile.coverage``, with the axes that the selection leaves (a dim is not shortened by a selection on
        another one, as with arrays)."""
        from gridcells.functions.scalar import format_scalar

        out = None
        for d, kept in self.selected(**query).items():
            total = self.labels(d).select(F.count(d)).scalar()
            dtype = grid.dtype(d)
            row = kept.agg(F.count(d).alias("s"), format_scalar(F.min(d), dtype).alias("min"), format_scalar(F.max(d), dtype).alias("max"))
            row = row.withColumn("t", total).select(
                F.lit(d).alias("dimension"), F.lit(dtype.simpleString()).alias("dtype"), F.col("s").alias("selected_unique"), F.col("t").alias("total_unique"),
                F.when(F.col("t") > 0, F.round(F.lit(100.0) * F.col("s") / F.col("t"), 1)).otherwise(F.lit(0.0)).alias("selected_pct"), "min", "max")
            out = row if out is None else out.union(row)
        return out

    def query_cost(self, grid: GridTable, **query) -> DataFrame:
        """As ``profile.query_cost``.  ``selected_cells`` follows from the stored row counts if at most one dim is selected on,
        and is NULL otherwise."""
        from gridcells.operators.profile import cost_row

        full = self.sizes()
        kept = self.selected(**query)
        sizes = {d: df.where(F.col(d).isNotNull()).count() for d, df in kept.items()}
        limited = [d for d in self.dims if d in query]
        cells = None
        if len(limited) <= 1:
            cells = kept[limited[0] if limited else self.dims[0]].agg(F.sum("rows")).first()[0] or 0
        row = self.spark.range(1).select(F.lit(cells).cast("bigint").alias("selected_cells"), *[
            F.lit(n).cast("bigint").alias(f"{side}{i}") for side, of in (("f", full), ("s", sizes)) for i, n in enumerate(of[d] for d in self.dims)])
        return cost_row(row, grid)

    def preview(self, grid: GridTable, limit: int = 250) -> DataFrame:
        """As ``preview.preview``: the last labels kept come from the stored axes, so the cells are read once, through a filter."""
        df = grid.df
        if limit <= 0 or not self.dims:
            return df
        sizes = self.sizes()
        for d, k in zip(self.dims, preview_extent([sizes[d] for d in self.dims], limit)):
            if k >= sizes[d]:
                continue
            if k == 0:
                return df.limit(0)
            down = d in self.descending
            labels = self.labels(d).where(F.col(d).isNotNull()).select(d)
            edge = labels.orderBy(F.col(d).desc() if down else F.col(d)).limit(k).agg(F.min(d) if down else F.max(d)).first()[0]
            df = df.where(F.col(d) >= F.lit(edge).cast(df.schema[d].dataType) if down else F.col(d) <= F.lit(edge).cast(df.schema[d].dataType))
        return df


def refresh(spark: SparkSession, cells: DataFrame, path: str, dims: tuple[str, ...], descending: tuple[str, ...] = ()) -> AxisCatalog:
    """The catalog for the files that the table has now: the labels of new and changed ones are read and added.  The lists of
    files are compared by Spark; only the differences, a name each, reach the driver."""
    known = spark.read.parquet(os.path.join(path, "files")).select("file", "changed")
    now = _with_file(cells).select("file", "changed").distinct()
    new = now.join(known, ["file", "changed"], "left_anti").collect()
    gone = known.join(now, ["file", "changed"], "left_anti").collect()
    if new:
        write_axes(cells, list(dims), path, only=[r.file for r in new], mode="append")
    return AxisCatalog(spark, path, dims, descending, tuple(f"{r.file}|{r.changed}" for r in gone))
