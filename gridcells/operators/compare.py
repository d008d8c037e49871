"""Comparing two variables on shared coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcells.functions.scalar import safe_ratio
from gridcells.model import GridTable


def compare_join(a: GridTable, b: GridTable) -> tuple[DataFrame, list[str]]:
    """Inner join on every coordinate column the two share (NULL matches
    NULL, as in the array model).  When one side has an extra dim the other
    side's value repeats along it.  Returns (joined, keys); keys empty means
    nothing shared and an empty result."""
    keys = [c for c in a.df.columns if c in b.df.columns and c not in (a.value, b.value)]
    if not keys:
        empty = a.df.limit(0).select(F.col(a.value), F.lit(None).cast("double").alias(b.value))
        return empty, []
    left, right = a.df.alias("a"), b.df.alias("b")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = left.join(right, cond, "inner").select(
        *[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{a.value}"), F.col(f"b.{b.value}"))
    return joined, keys


def compare_values(joined: DataFrame, primary: str, secondary: str) -> DataFrame:
    p, s = F.col(primary).cast("double"), F.col(secondary).cast("double")
    return joined.withColumn("difference", p - s).withColumn("ratio", safe_ratio(p, s))


def guarded_corr(a: str, b: str):
    """Pearson r over complete pairs; NULL (not an error) for a constant side
    or fewer than two pairs."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x = F.when(both, F.col(a).cast("double"))
    y = F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def compare_summary(compared: DataFrame, primary: str, secondary: str) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("rows_joined"),
        guarded_corr(primary, secondary).alias("correlation"),
        F.avg(primary).alias("primary_mean"),
        F.avg(secondary).alias("compare_mean"),
        F.avg("difference").alias("difference_mean"),
        F.avg("ratio").alias("ratio_mean"),
    )
