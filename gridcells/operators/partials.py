"""Monthly partials: one table of (cell, month) sums, counts, least and greatest values.

Sums, counts, minima and maxima of months add up to those of any bin of whole months and of any set of months.  So
climatologies, monthly baselines and the MS, QS-DEC and YS bins, each as mean, sum, min or max, are all rolled up from
this one aggregation.  (A median has no such parts.)  The table is written once when it is made to be kept, and has at
most one row for each cell and month.

Cases.  Cells without a time are in a month of their own (NULL); a month whose values are all missing keeps its row, with count 0; NULL
labels are labels; an empty grid has no partials.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.functions.scalar import bin_label, bin_number, bin_of_month, bin_step_months
from gridcells.model import GridTable
from gridcells.operators.reduce import filled_bins
from gridcells.session import checkpoint_dir

HOWS = ("mean", "sum", "min", "max")
_PARTS = ("__gc_s", "__gc_c", "__gc_lo", "__gc_hi")


@dataclass(frozen=True)
class MonthlyPartials:
    """``df``: the dims other than time, ``__gc_m`` (months since year 0) and the parts."""

    grid: GridTable
    df: DataFrame

    @property
    def others(self) -> list[str]:
        return self.grid.other_dims(self.grid.time_dim)

    def _rolled(self, keys: list[Column], how: str) -> DataFrame:
        value = self.grid.value
        if how not in HOWS:
            raise ValueError(f"{how!r} is not rolled up from monthly parts; choose one of {HOWS}")
        out = {"mean": F.try_divide(F.sum("__gc_s"), F.sum("__gc_c")), "sum": F.coalesce(F.sum("__gc_s"), F.lit(0).cast("double")),
               "min": F.min("__gc_lo"), "max": F.max("__gc_hi")}[how]
        return self.df.groupBy(*keys).agg(out.alias(value))

    def climatology(self, how: str = "mean", month_col: str = "month") -> GridTable:
        month = (F.pmod(F.col("__gc_m"), F.lit(12)) + 1).cast("int").alias(month_col)
        df = self._rolled([month, *map(F.col, self.others)], how)
        return self.grid.with_df(df.select(month_col, *self.others, self.grid.value), dims=(month_col, *self.others), aux=(), unique_cells=True)

    def resample(self, rule: str = "QS-DEC", how: str = "mean", fill_empty: bool = False) -> GridTable:
        t, value = self.grid.time_dim, self.grid.value
        df = self._rolled([bin_of_month("__gc_m", rule).alias(t), *map(F.col, self.others)], how)
        df = df.withColumn(t, bin_label(t, rule))
        if fill_empty:
            bins = self.df.select(*self.others, bin_of_month("__gc_m", rule).alias(t))
            df = filled_bins(df, bins, t, self.others, value, rule, bin_step_months(rule), how)
        return self.grid.with_df(df.select(t, *self.others, value), dims=(t, *self.others), aux=(), unique_cells=True)

    def anomaly(self, how: str = "mean") -> GridTable:
        """The grid's values minus their month's climatology; the grid's cells are read once and the baseline comes from the parts."""
        from gridcells.operators.windows import month_baseline_anomaly

        base = self.climatology(how, "__gc_month").df.withColumnRenamed(self.grid.value, "__gc_base")
        return month_baseline_anomaly(self.grid, base)

    def save(self, path: str) -> str:
        self.df.write.mode("overwrite").parquet(path)
        return path


def monthly_partials(grid: GridTable, keep: bool = False) -> MonthlyPartials:
    """One grouped pass, combined before its shuffle; ``keep`` writes the result to the checkpoint folder, for several uses."""
    t, v = grid.require_time("Monthly parts"), F.col(grid.value)
    # a sum over no values is NULL, so that rolling up keeps the difference between none and zero
    df = grid.df.groupBy(*grid.other_dims(t), bin_number(t, "MS").alias("__gc_m")).agg(
        F.sum(v).cast("double").alias("__gc_s"), F.count(v).alias("__gc_c"), F.min(v).alias("__gc_lo"), F.max(v).alias("__gc_hi"))
    if keep:
        checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    return MonthlyPartials(grid, df)


def load_partials(spark: SparkSession, grid: GridTable, path: str) -> MonthlyPartials:
    return MonthlyPartials(grid, spark.read.parquet(path))
