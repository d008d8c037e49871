"""Most frequent values by candidates (the modes of A8).

Values are hashed to buckets and each bucket is counted: a summary of constant size that merges by adding, and
in which a bucket's count bounds the count of every value in it.  The values of the fullest buckets are
counted exactly; no value of a bucket with fewer rows than the best of them can be the mode.  Only buckets
that still may hold it are counted in the end, so a column with a frequent value shuffles a few groups, however
many other values it has.  Where values hardly repeat, all buckets may hold the mode, and all values are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcells.functions.scalar import nan_to_null

BUCKETS = 1 << 14
# So many of the fullest buckets are counted to find the least count that a mode can have.
LEADERS = 8


def plain_value(df: DataFrame, column: str) -> Column:
    """The value as it is compared: NaN is missing, zero of either sign is one value; nested values as text."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return nan_to_null(column) + F.lit(0.0).cast(dtype)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.col(column).cast("string")
    return F.col(column)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``x, n``: each value that is not missing and its rows, combined before the shuffle."""
    return df.select(plain_value(df, column).alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))


def top_value(counts: DataFrame) -> DataFrame:
    """One row ``x, n`` with the most frequent value, the smallest on ties (nulls if there is none)."""
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("x").alias("x"))).alias("b"))
    return best.select(F.col("b.x").alias("x"), (-F.col("b.neg")).alias("n"))


def mode_of(df: DataFrame, column: str, buckets: int = BUCKETS, leaders: int = LEADERS) -> DataFrame:
    """One row ``x, n``: the most frequent value of a column and its exact count; the smallest value on ties, nulls for a
    column without values.  At most ``buckets`` pairs of numbers reach the driver."""
    values = df.select(plain_value(df, column).alias("x")).where("x is not null")
    values = values.select("x", F.pmod(F.xxhash64("x"), F.lit(buckets)).cast("int").alias("bucket"))
    rows = values.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = sorted(((r.n, r.bucket) for r in rows), reverse=True)

    def counted(keep: list[int]) -> DataFrame:
        kept = values if len(keep) == len(sizes) else values.where(F.col("bucket").isin(keep))
        return kept.groupBy("x").agg(F.count(F.lit(1)).alias("n"))

    fullest = [b for _, b in sizes[:leaders]]
    if len(sizes) <= leaders:
        return top_value(counted(fullest))
    least = counted(fullest).agg(F.max("n")).first()[0]
    return top_value(counted([b for n, b in sizes if n >= least]))


def column_modes(df: DataFrame, columns: list[str] | None = None, buckets: int = BUCKETS, leaders: int = LEADERS) -> DataFrame:
    """``column, mode`` (as text), ``count`` for each column."""
    out = df.sparkSession.createDataFrame([], "column string, mode string, count bigint")
    for c in columns or df.columns:
        out = out.union(mode_of(df, c, buckets, leaders).select(F.lit(c), F.col("x").cast("string"), "n"))
    return out
