"""Axis tables and the global 0-based index.

An *axis table* holds the distinct values of one dimension with their 0-based
position in ascending order.  Positions are what the array model calls the
index of a label; operators that count in positions (rolling windows, preview
trimming, first slice, downsampling) join on them instead of relying on row
adjacency, so sparse cell tables behave like dense arrays.

The global index never moves all rows into one task: rows are range
partitioned and sorted inside each partition, each row gets its number within
the partition, and per-partition counts (one number per partition) become
offsets.  The range-partitioned data is checkpointed first so that a lost
executor recomputes nothing that could shift partition boundaries.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcells.session import checkpoint_dir

_PID = "__gc_pid"
_LOCAL = "__gc_local"
# An axis table is broadcast when its labels, measured while they are numbered, take no more.
BROADCAST_BYTES = 8 << 20


def _numbered(df: DataFrame, order_cols: list[str], index_col: str, num_partitions: int | None,
              descending: bool) -> tuple[DataFrame, int, int]:
    """(rows with index, number of rows, bytes of the first ordering column as text)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order_cols]
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_LOCAL, F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33))
    )
    ranged = ranged.checkpoint(eager=True)
    # one small row per partition
    sizes = {r[_PID]: r for r in ranged.groupBy(_PID).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(order_cols[0]).cast("string"))).alias("b")).collect()}
    offsets, running = [], 0
    for pid in range(max(sizes, default=-1) + 1):
        offsets.append(running)
        running += sizes[pid]["n"] if pid in sizes else 0
    total = sum(r["b"] or 0 for r in sizes.values())
    if not offsets:
        return ranged.withColumn(index_col, F.lit(None).cast("long")).drop(_PID, _LOCAL), 0, 0
    offset_col = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col(_PID) + 1)
    return ranged.withColumn(index_col, F.col(_LOCAL) + offset_col).drop(_PID, _LOCAL), running, total


def global_index(df: DataFrame, order_cols: list[str], index_col: str = "k", num_partitions: int | None = None,
                 descending: bool = False) -> tuple[DataFrame, int]:
    """Add a 0-based BIGINT index following ``order_cols``, and count the rows.

    ``order_cols`` must order rows totally (add tiebreak columns otherwise);
    NULLs sort first, as in ``ORDER BY ... ASC`` (last if descending).
    """
    return _numbered(df, order_cols, index_col, num_partitions, descending)[:2]


# An axis of numbers or times with at most so many labels is numbered by the driver, in one job.
SHORT_AXIS = 1 << 14


def short_axis(values: DataFrame, dim: str, pos_col: str, descending: bool) -> tuple[DataFrame, int] | None:
    """The numbered axis, if it has at most ``SHORT_AXIS`` labels of a type of fixed size."""
    if not isinstance(values.schema[dim].dataType, (T.NumericType, T.DatetimeType)):
        return None
    labels = values.orderBy(F.col(dim).desc() if descending else F.col(dim)).limit(SHORT_AXIS + 1).toArrow()
    n = labels.num_rows
    if n > SHORT_AXIS:
        return None
    schema = T.StructType([values.schema[dim], T.StructField(pos_col, T.LongType())])
    numbered = values.sparkSession.createDataFrame(labels.append_column(pos_col, pa.array(range(n), pa.int64())), schema)
    return F.broadcast(numbered), n


def axis_table(df: DataFrame, dim: str, pos_col: str = "pos", descending: bool = False) -> tuple[DataFrame, int]:
    """Distinct non-null values of ``dim`` with their 0-based position in
    stored order, and the axis length.  A short axis is numbered by one job; a longer one by the distributed index, and
    broadcast in joins when its labels are measured to be small (otherwise Spark shuffles them)."""
    values = df.select(dim).where(F.col(dim).isNotNull()).distinct()
    short = short_axis(values, dim, pos_col, descending)
    if short is not None:
        return short
    indexed, n, size = _numbered(values, [dim], pos_col, None, descending)
    return (F.broadcast(indexed) if size + 16 * n <= BROADCAST_BYTES else indexed), n


def axis_sizes(df: DataFrame, dims: list[str]) -> dict[str, int]:
    """Number of distinct labels per dim, one aggregate pass."""
    if not dims:
        return {}
    row = df.agg(*[F.count_distinct(F.col(d)).alias(d) for d in dims]).collect()[0]
    return {d: int(row[d]) for d in dims}
