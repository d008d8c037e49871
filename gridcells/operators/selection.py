"""Exact medians by narrowing: no copy of the table, and no task that holds a group.

Values are put into buckets by a function that never falls as the value rises; a pass counts each group's buckets, combined
before the shuffle, and the buckets that hold the one or two middle ranks are followed.  The first pass goes by sign and
logarithm; each later one cuts the followed bucket, between its least and greatest value, into ``CUTS`` equal parts.  A bucket with one
distinct value is the answer.  When few rows are left in followed buckets (``FEW`` in all) they are ranked directly.

What is kept between passes is at most two rows a group.  It is broadcast if its counted rows are at most ``SMALL``, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcells.session import checkpoint_dir

CUTS, FEW, SMALL = 1 << 16, 1 << 18, 1 << 20
_ALL = "__gc_all"


def _magnitude_bucket(v: Column) -> Column:
    """Sixteen buckets for each doubling, of either sign; NaN is the greatest."""
    size = F.abs(v)
    of_size = F.when(size == float("inf"), 60_000).otherwise(F.floor(F.log2(size) * 16) + 20_000)
    return F.when(F.isnan(v), 70_000).when(v == 0, 0).when(v > 0, of_size).otherwise(-of_size).cast("int")


def _followed(buckets: DataFrame, keys: list[str], first: bool) -> DataFrame:
    """Of counted buckets ``keys, __gc_from, __gc_b, __gc_c, __gc_lo, __gc_hi`` those that hold a wanted rank, with the ranks within them."""
    part = Window.partitionBy(*keys, *([] if first else ["__gc_from"]))
    ranked = buckets.withColumn("__gc_before", F.coalesce(F.sum("__gc_c").over(
        part.orderBy("__gc_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if first:
        n = F.sum("__gc_c").over(part)
        ranked = ranked.withColumn("__gc_want", F.array(F.floor((n - 1) / 2).cast("long"), F.floor(n / 2).cast("long")))
    within = F.transform(F.filter("__gc_want", lambda r: (r >= F.col("__gc_before")) & (r < F.col("__gc_before") + F.col("__gc_c"))),
                         lambda r: r - F.col("__gc_before"))
    return ranked.withColumn("__gc_want", within).where(F.size("__gc_want") > 0).select(*keys, "__gc_c", "__gc_lo", "__gc_hi", "__gc_want")


def _meet(rows: DataFrame, buckets: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows in the buckets that are followed."""
    a, b = rows.alias("a"), (F.broadcast(buckets) if n <= SMALL else buckets).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.__gc_v").between(F.col("b.__gc_lo"), F.col("b.__gc_hi"))]
    return a.join(b, on).select(*[F.col(f"a.{k}") for k in keys], "a.__gc_v", "b.__gc_lo", "b.__gc_hi", "b.__gc_want")


def median_by_selection(df: DataFrame, keys: list[str], value: str, out: str | None = None, cuts: int = CUTS, few: int = FEW) -> DataFrame:
    """Exact median of each ``keys`` group (NULL labels alike); NULL for a group whose values are all missing."""
    out, spark = out or value, df.sparkSession
    checkpoint_dir(spark)
    names = list(keys) or [_ALL]
    rows = df.select(*keys, *([] if keys else [F.lit(0).alias(_ALL)]), F.col(value).cast("double").alias("__gc_v"))
    groups, rows = rows.select(*names).distinct(), rows.where("__gc_v is not null")
    measures = (F.count(F.lit(1)).alias("__gc_c"), F.min("__gc_v").alias("__gc_lo"), F.max("__gc_v").alias("__gc_hi"))
    counted = rows.groupBy(*names, _magnitude_bucket(F.col("__gc_v")).alias("__gc_b")).agg(*measures)
    state, found = _followed(counted, names, True).checkpoint(), None
    while True:
        done = state.where("__gc_lo = __gc_hi").select(*names, F.col("__gc_lo").alias("__gc_v"))
        found = done if found is None else found.union(done)
        open_ = state.where("__gc_lo < __gc_hi")
        n, left = open_.agg(F.count(F.lit(1)), F.coalesce(F.sum("__gc_c"), F.lit(0))).first()
        if not n:
            break
        met = _meet(rows, open_.select(*names, "__gc_lo", "__gc_hi", "__gc_want"), names, n)
        if left <= few:
            rank = F.row_number().over(Window.partitionBy(*names, "__gc_lo").orderBy("__gc_v")) - 1
            ranked = met.withColumn("__gc_r", rank.cast("long")).where(F.array_contains("__gc_want", F.col("__gc_r")))
            found = found.union(ranked.select(*names, "__gc_v"))
            break
        share = (F.col("__gc_v") / 2 - F.col("__gc_lo") / 2) / (F.col("__gc_hi") / 2 - F.col("__gc_lo") / 2)
        cut = F.least(F.floor(share * cuts), F.lit(cuts - 1)).cast("int")
        # the greatest value has a part of its own, so that every pass parts the bucket
        cut = F.when(F.col("__gc_v") == F.col("__gc_hi"), F.lit(cuts)).otherwise(cut)
        counted = met.groupBy(*names, F.col("__gc_lo").alias("__gc_from"), cut.alias("__gc_b")).agg(
            *measures, F.first("__gc_want").alias("__gc_want"))
        state = _followed(counted, names, False).checkpoint()
    low, high = F.min("__gc_v"), F.max("__gc_v")             # the two middle values, or one twice
    between = F.when(F.greatest(F.abs(low), F.abs(high)) < 1, (low + high) / 2).otherwise(low / 2 + high / 2)
    medians = found.groupBy(*names).agg(F.when(low == high, low).otherwise(between).alias(out))
    if not keys:
        return spark.range(1).select(medians.select(out).scalar().alias(out))
    a, b = groups.alias("a"), medians.alias("b")
    return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select(*[F.col(f"a.{k}") for k in keys], F.col(f"b.{out}"))
