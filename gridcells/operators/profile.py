"""Column and dimension profiles.

Each profile is a single aggregate pass producing one wide row, unpivoted
into one row per column with ``explode(array(struct(...)))``: no per-column
job, no driver loop over data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcells.functions.scalar import format_scalar, nan_to_null
from gridcells.model import GridTable
from gridcells.operators.axes import axis_table
from gridcells.operators.modes import mode_of, value_counts

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIME = (T.TimestampNTZType, T.TimestampType, T.DateType)

# Bytes per cell for the cost estimate (8-byte numbers and
# datetimes, 32 for text and other object columns).
ITEMSIZE = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "timestamp_ntz": 8, "timestamp": 8, "date": 8,
}
TEXT_ITEMSIZE = 32

# Risk thresholds of the cost estimate.
HIGH_ROWS, HIGH_MB = 500_000, 128
MEDIUM_ROWS, MEDIUM_MB = 50_000, 16


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, _NUMERIC):
        return "numeric"
    if isinstance(dtype, _TIME):
        return "datetime"
    return "other"


def attach_scalars(wide: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate, as the fields of one scalar subquery (a subquery
    a column would compute the aggregate once for each)."""
    names = one_row.columns
    row = one_row.select(F.struct(*names).alias("__row")).scalar()
    return wide.withColumn("__row", row).select(*wide.columns, *[F.col(f"__row.{c}").alias(c) for c in names])


def _unpivot(wide: DataFrame, structs: list[Column]) -> DataFrame:
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _label_row(df: DataFrame, dims: list[str], approx: bool = False, summary=lambda d, i: []) -> DataFrame:
    """One row with the number of labels ``n<i>`` of each dim, and the ``summary`` aggregates of its labels.  Each dim's labels are
    grouped on their own, in a scan of that column alone; counting all of them in one aggregate would multiply every row by the dims.
    ``approx`` takes HyperLogLog estimates (constant-size state, about 2 % error) for very high cardinality, in one aggregate."""
    if approx:
        return df.agg(*[x for i, d in enumerate(dims) for x in (F.approx_count_distinct(d).alias(f"n{i}"), *summary(d, i))])
    rows = [df.select(d).distinct().agg(F.count(d).alias(f"n{i}"), *summary(d, i)) for i, d in enumerate(dims)]
    out = rows[0]
    for row in rows[1:]:
        out = attach_scalars(out, row)
    return out


def statistics(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column: dtype, non_null, missing, unique; numeric min/mean/max/std
    (std needs two values); datetime min/max as text; other columns put their
    mode (smallest on ties) in ``min_text``.

    Numbers of distinct values and modes come from a grouped count of each column's values, combined before the
    shuffle, in a scan of that column alone.  ``approx=True`` estimates ``unique`` with HyperLogLog instead, and takes the (exact)
    modes from candidates (``modes.mode_of``)."""
    columns = columns or df.columns
    aggs, names = [], []
    for i, c in enumerate(columns):
        dtype = df.schema[c].dataType
        v = nan_to_null(c) if isinstance(dtype, (T.FloatType, T.DoubleType)) else F.col(c)
        kind = _kind(dtype)
        aggs.append(F.count(v).alias(f"nn{i}"))
        if approx:
            aggs.append(F.approx_count_distinct(v).alias(f"u{i}"))
        if kind == "numeric":
            x = v.cast("double")
            aggs += [F.min(x).alias(f"mn{i}"), F.avg(x).alias(f"av{i}"), F.max(x).alias(f"mx{i}"),
                     F.stddev_samp(x).alias(f"sd{i}")]
        elif kind == "datetime":
            aggs += [F.min(v).cast("string").alias(f"mn{i}"), F.max(v).cast("string").alias(f"mx{i}")]
        names.append((c, dtype, kind))
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    for i, (c, _, kind) in enumerate(names):
        mode = F.col("x").cast("string").alias(f"mo{i}")
        if not approx:
            counts = value_counts(df, c)
            one = counts.agg(F.count(F.lit(1)).alias(f"u{i}"), F.min(F.struct(-F.col("n"), "x")).alias("b"))
            wide = attach_scalars(wide, one.select(f"u{i}", "b.x").select(f"u{i}", mode))
        elif kind == "other":
            wide = attach_scalars(wide, mode_of(df, c).select(mode))
    dnull, snull = F.lit(None).cast("double"), F.lit(None).cast("string")
    structs = []
    for i, (c, dtype, kind) in enumerate(names):
        num = kind == "numeric"
        structs.append(F.struct(
            F.lit(c).alias("column"),
            F.lit(dtype.simpleString()).alias("dtype"),
            F.col(f"nn{i}").alias("non_null"),
            (F.col("rows") - F.col(f"nn{i}")).alias("missing"),
            F.coalesce(F.col(f"u{i}"), F.lit(0)).cast("bigint").alias("unique"),
            (F.col(f"mn{i}") if num else dnull).alias("min"),
            (F.col(f"av{i}") if num else dnull).alias("mean"),
            (F.col(f"mx{i}") if num else dnull).alias("max"),
            (F.col(f"sd{i}") if num else dnull).alias("std"),
            (F.col(f"mn{i}") if kind == "datetime" else F.col(f"mo{i}") if kind == "other" else snull).alias("min_text"),
            (F.col(f"mx{i}") if kind == "datetime" else snull).alias("max_text"),
        ))
    return _unpivot(wide, structs)


def coverage(selection: DataFrame, full: DataFrame, dims: list[str], approx: bool = False) -> DataFrame:
    """Per dim: labels present in the selection vs on the whole axis, the
    percentage (1 decimal) and the selection's min/max as report text
    ("n/a" when the selection is empty)."""
    sel = _label_row(selection, dims, approx, lambda d, i: [
        format_scalar(F.min(d), selection.schema[d].dataType).alias(f"lo{i}"),
        format_scalar(F.max(d), selection.schema[d].dataType).alias(f"hi{i}")])
    tot = _label_row(full, dims, approx)
    wide = attach_scalars(sel, tot.select(*[F.col(f"n{i}").alias(f"t{i}") for i in range(len(dims))]))
    structs = []
    for i, d in enumerate(dims):
        s, t = F.col(f"n{i}"), F.col(f"t{i}")
        structs.append(F.struct(
            F.lit(d).alias("dimension"),
            F.lit(full.schema[d].dataType.simpleString()).alias("dtype"),
            s.alias("selected_unique"),
            t.alias("total_unique"),
            F.when(t > 0, F.round(F.lit(100.0) * s / t, 1)).otherwise(F.lit(0.0)).alias("selected_pct"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
        ))
    return _unpivot(wide, structs)


def _schema_type(dtype: T.DataType) -> tuple[str, str | None]:
    if isinstance(dtype, T.BooleanType):
        return "boolean", None
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer", None
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number", None
    if isinstance(dtype, _TIME):
        return "string", "datetime"
    return "string", None


def schema_profile(df: DataFrame) -> DataFrame:
    """Schema rows: type/format, inclusive min/max for numeric (as double) and
    datetime (ISO text) columns, and the table's row count."""
    aggs, meta = [], []
    for i, c in enumerate(df.columns):
        dtype = df.schema[c].dataType
        kind = _kind(dtype)
        if kind == "numeric":
            x = nan_to_null(F.col(c).cast("double"))
            aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
        elif kind == "datetime":
            aggs += [F.date_format(F.min(c), "yyyy-MM-dd'T'HH:mm:ss").alias(f"mn{i}"),
                     F.date_format(F.max(c), "yyyy-MM-dd'T'HH:mm:ss").alias(f"mx{i}")]
        meta.append((c, dtype, kind))
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    dnull, snull = F.lit(None).cast("double"), F.lit(None).cast("string")
    structs = []
    for i, (c, dtype, kind) in enumerate(meta):
        typ, fmt = _schema_type(dtype)
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(typ).alias("type"), F.lit(fmt).cast("string").alias("format"),
            (F.col(f"mn{i}") if kind == "numeric" else dnull).alias("minimum"),
            (F.col(f"mx{i}") if kind == "numeric" else dnull).alias("maximum"),
            (F.col(f"mn{i}") if kind == "datetime" else snull).alias("minimum_text"),
            (F.col(f"mx{i}") if kind == "datetime" else snull).alias("maximum_text"),
            F.col("rows").alias("rows"),
        ))
    return _unpivot(wide, structs)


def dimension_info(grid: GridTable) -> DataFrame:
    """Per dim: dtype, size, kind, min/max as text (a pass over each dim's column); the labels of an axis are
    rows of ``dimension_labels``."""
    if grid.catalog is not None:
        return grid.catalog.dimension_info(grid)
    dims = list(grid.dims)
    kinds = {d: ("datetime" if grid.is_time(d) else "numeric" if grid.is_numeric(d) else "categorical") for d in dims}
    wide = _label_row(grid.df, dims, summary=lambda d, i: [F.min(d).cast("string").alias(f"lo{i}"), F.max(d).cast("string").alias(f"hi{i}")])
    return _unpivot(wide, [F.struct(
        F.lit(d).alias("dimension"), F.lit(grid.dtype(d).simpleString()).alias("dtype"), F.col(f"n{i}").alias("size"),
        F.lit(kinds[d]).alias("kind"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, d in enumerate(dims)])


def dimension_labels(grid: GridTable, dims: list[str] | None = None) -> DataFrame:
    """All labels as rows ``dimension, position, label`` (position in stored order), of the categorical
    dims unless others are named; an axis of any length."""
    dims = [d for d in grid.dims if not grid.is_time(d) and not grid.is_numeric(d)] if dims is None else list(dims)
    out = grid.df.sparkSession.createDataFrame([], "dimension string, position bigint, label string")
    for d in dims:
        axis, _ = axis_table(grid.df, d, "position", d in grid.descending)
        out = out.union(axis.select(F.lit(d).alias("dimension"), "position", F.col(d).cast("string").alias("label")))
    return out


def bytes_per_row(df: DataFrame, columns: list[str]) -> int:
    return sum(ITEMSIZE.get(df.schema[c].dataType.simpleString(), TEXT_ITEMSIZE) for c in columns)


def query_cost(full: GridTable, selected: GridTable, approx: bool = False) -> DataFrame:
    """One row: dense sizes (product of axis sizes) of the full table and the
    selection, the actual selected cell rows, ratio, bytes/row, MB and risk.
    A scalar-selected dim counts as size 1."""
    dims = list(full.dims)
    wide = selected.df.agg(F.count(F.lit(1)).alias("selected_cells"))
    for prefix, df in (("f", full.df), ("s", selected.df)):
        wide = attach_scalars(wide, _label_row(df, dims, approx).select(*[F.col(f"n{i}").alias(f"{prefix}{i}") for i in range(len(dims))]))
    return cost_row(wide, full)


def cost_row(wide: DataFrame, full: GridTable) -> DataFrame:
    """The estimate from one row with ``selected_cells`` and the sizes ``f<i>`` (full) and ``s<i>`` (selected) of the dims."""
    dims = list(full.dims)
    columns = [c for c in (*full.dims, *full.aux, full.value) if c in full.df.columns]
    bpr = bytes_per_row(full.df, columns)
    full_rows = F.lit(1).cast("long")
    sel_rows = F.lit(1).cast("long")
    for i in range(len(dims)):
        full_rows = full_rows * F.col(f"f{i}")
        sel_rows = sel_rows * F.col(f"s{i}")
    mb = F.round(sel_rows * F.lit(float(bpr)) / F.lit(1024.0 * 1024.0), 2)
    rows = F.col("selected_rows")
    risk = (F.when((rows >= HIGH_ROWS) | (F.col("approx_mb") >= HIGH_MB), "high")
            .when((rows >= MEDIUM_ROWS) | (F.col("approx_mb") >= MEDIUM_MB), "medium").otherwise("low"))
    return (wide.select(
        full_rows.alias("full_rows"), sel_rows.alias("selected_rows"), F.col("selected_cells"),
        F.lit(len(columns)).alias("column_count"), F.lit(bpr).alias("bytes_per_row"), mb.alias("approx_mb"))
        .withColumn("selection_ratio", F.when(F.col("full_rows") > 0,
                                              F.round(F.col("selected_rows") / F.col("full_rows"), 6))
                    .otherwise(F.lit(0.0)))
        .withColumn("risk", risk))


def describe(dataset) -> DataFrame:
    """Tables plus dimension info: ``dimension_info`` of every variable,
    stacked with the table name."""
    frames = [dimension_info(grid).select(F.lit(name).alias("table"), "*")
              for name, grid in dataset.variables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def flatten_estimate(source: DataFrame, flat: GridTable, bytes_per_value: int = 8) -> DataFrame:
    """Size arithmetic of flattening: source rows, flattened rows (product of
    the axis sizes), bytes at ``bytes_per_value`` per column, and the row
    explosion factor (flattened / source, 4 decimals, 0.0 without source)."""
    columns = len([c for c in (*flat.dims, *flat.aux, flat.value) if c in flat.df.columns])
    sizes = _label_row(flat.df, list(flat.dims))
    rows = F.lit(1).cast("long")
    for i in range(len(flat.dims)):
        rows = rows * F.col(f"n{i}")
    src = source.agg(F.count(F.lit(1)).alias("source_rows"))
    wide = attach_scalars(sizes.select(rows.alias("flattened_rows")), src)
    nbytes = F.col("flattened_rows") * F.lit(columns * bytes_per_value)
    return wide.select(
        "source_rows", "flattened_rows", F.lit(columns).alias("columns"), nbytes.alias("dataframe_bytes"),
        F.round(nbytes / F.lit(1024.0 * 1024.0), 2).alias("dataframe_mb"),
        F.when(F.col("source_rows") > 0, F.round(F.col("flattened_rows") / F.col("source_rows"), 4))
        .otherwise(F.lit(0.0)).alias("row_explosion"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))
