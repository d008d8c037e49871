"""Packed arrays to cells, and dense grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcells.model import GridTable
from gridcells.operators.axes import axis_table


def flatten_array(df: DataFrame, keys: list[str], array_col: str, pos_col: str = "position",
                  value_col: str | None = None) -> DataFrame:
    """One row per array element: the row keys, the 0-based element position
    and the element value (``posexplode`` inside the scan's stage)."""
    value_col = value_col or array_col
    return df.select(*keys, F.posexplode(array_col).alias(pos_col, value_col))


def array_depth(df: DataFrame, column: str) -> int:
    """How many arrays are nested in a column (0: a plain value)."""
    dtype, depth = df.schema[column].dataType, 0
    while isinstance(dtype, T.ArrayType):
        dtype, depth = dtype.elementType, depth + 1
    return depth


# Rows of an axis table that is broadcast; a longer one is shuffled.
AXIS_ROWS = 1 << 18


def flatten_grid(df: DataFrame, keys: list[str], array_col: str, axes: dict[str, DataFrame | None], value_col: str | None = None) -> GridTable:
    """Cells of packed arrays of any number of dimensions.

    ``axes`` names the dimension of each level of nesting, outermost first, with its axis table ``position, label``
    (None: the positions are the labels).  Every level is one ``posexplode`` in the scan's stage, and each position then meets its
    label in a join; nothing else is moved.  The dims are ``keys`` and then the axes.

    Cases.  A plain value (no axes) is one cell a row; a null array, or a null or empty inner one, has no cells; a null element is a cell
    with a NULL value; arrays of different lengths give the cells that are stored (``densify`` adds the others); a position
    that its axis table lacks has a NULL label; an axis table that has a position twice raises."""
    value_col = value_col or array_col
    depth = array_depth(df, array_col)
    if depth != len(axes):
        raise ValueError(f"{array_col!r} has {depth} dimensions and {len(axes)} axes are given")
    clash = [a for a in axes if a in keys or a == value_col]
    if clash:
        raise ValueError(f"axes {clash} are named like other columns")
    names = list(axes)
    cells = df.select(*keys, F.col(array_col).alias("__gc_v"))
    for i in range(depth):
        cells = cells.select(*keys, *[f"__gc_p{j}" for j in range(i)], F.posexplode("__gc_v").alias(f"__gc_p{i}", "__gc_v"))
    for i, name in enumerate(names):
        axis = axes[name]
        if axis is None:
            cells = cells.withColumnRenamed(f"__gc_p{i}", name)
            continue
        if axis.groupBy("position").count().where("count > 1").limit(1).count():
            raise ValueError(f"the axis table of {name!r} has a position twice")
        side = axis.select(F.col("position").cast("int").alias(f"__gc_p{i}"), F.col("label").alias(name))
        cells = cells.join(F.broadcast(side) if side.count() <= AXIS_ROWS else side, f"__gc_p{i}", "left")
    dims = (*keys, *names)
    return GridTable.from_frame(cells.select(*dims, F.col("__gc_v").alias(value_col)), dims, value_col)


LABELS_PER_CHUNK = 1024


def densify(grid: GridTable) -> GridTable:
    """Make the cell table the complete product of its axes; absent cells get
    a NULL value.

    The result *is* the product of the axis sizes (``row_guard`` before it bounds that).
    The labels of the longest axis stay rows; every other axis is cut into numbered
    chunks of at most ``LABELS_PER_CHUNK`` labels, and each row meets each chunk in an equality join
    on the chunk's number, so no array grows with the data.  The cells are then
    left-joined onto the product.
    """
    dims = list(grid.dims)
    if not dims:
        return grid                      # a single value is complete
    axes = {d: axis_table(grid.df, d, "__gc_pos") for d in dims}
    order = sorted(dims, key=lambda d: -axes[d][1])
    product = axes[order[0]][0].select(order[0])
    for d in order[1:]:
        axis, n = axes[d]
        chunks = axis.groupBy(F.floor(F.col("__gc_pos") / LABELS_PER_CHUNK).cast("long").alias("__gc_chunk")).agg(
            F.collect_list(d).alias("__gc_labels"))
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0) // LABELS_PER_CHUNK).cast("long"))
        product = (product.withColumn("__gc_chunk", F.explode(numbers)).join(chunks, "__gc_chunk")
                   .withColumn(d, F.explode("__gc_labels")).drop("__gc_chunk", "__gc_labels"))
    cells = grid.df.select(*dims, grid.value)
    dense = product.join(cells, dims, "left").select(*dims, grid.value)
    return grid.with_df(dense, aux=())
