"""Selection and projection.

Selections are label based: a ``(lo, hi)`` tuple is an inclusive range, a list
is membership, anything else one exact label.  Literals are cast to the
column's type (never the column), so every predicate reaches the Parquet scan
as a pushed filter.
"""

from __future__ import annotations

from typing import Any, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcells.functions.scalar import label_bound, label_range, label_text, to_numeric, typed_literal
from gridcells.model import GridTable

# Label lists longer than this are joined instead of written into the filter.
IN_LIST_LIMIT = 1000


def filter_range(df: DataFrame, column: str, lo: Any, hi: Any) -> DataFrame:
    """Inclusive on both ends, bounds swapped if reversed; value based, so the
    axis direction does not matter.  ``None`` leaves that end open."""
    if lo is not None and hi is not None:
        return df.where(label_range(column, df.schema[column].dataType, lo, hi))
    return filter_open_range(df, column, lo, hi)


def filter_open_range(df: DataFrame, column: str, lo: Any = None, hi: Any = None) -> DataFrame:
    dtype = df.schema[column].dataType
    if lo is not None:
        df = df.where(label_bound(column, dtype, lo, True))
    if hi is not None:
        df = df.where(label_bound(column, dtype, hi, False))
    return df


def filter_in(df: DataFrame, column: str, values: Iterable[Any], strict: bool = False) -> DataFrame:
    """Membership.  ``strict=True`` raises ``KeyError`` for labels absent from
    the axis (array semantics); the check is an anti-join on the label list.
    Short and long lists are typed by the same routine; a long list becomes a
    semi-join, with its least and greatest label as a range for the scan."""
    values = list(values)
    dtype = df.schema[column].dataType
    named = [(v, label_text(v, dtype)) for v in values]
    known = list(dict.fromkeys(text for _, text in named if text is not None))
    kind = dtype.simpleString()
    labels = df.sparkSession.createDataFrame([(x,) for x in known], "__label string").select(
        F.col("__label").cast(kind).alias(column))
    if strict:
        missing = [v for v, text in named if text is None][:5]
        missing = missing or [r[0] for r in labels.join(df.select(column).distinct(), column, "left_anti").limit(5).collect()]
        if missing:
            raise KeyError(f"labels {missing} not found on {column!r}")
    if not known:
        return df.where(F.lit(False))
    if len(known) <= IN_LIST_LIMIT:
        return df.where(F.col(column).isin(*[F.lit(x).cast(kind) for x in known]))
    ends = labels.agg(F.min(column), F.max(column)).first()      # of a local list, not of the data
    return filter_range(df, column, ends[0], ends[1]).join(F.broadcast(labels.distinct()), column, "left_semi")


def filter_eq(df: DataFrame, column: str, value: Any) -> DataFrame:
    dtype = df.schema[column].dataType
    text = label_text(value, dtype)
    return df.where(F.lit(False) if text is None else F.col(column) == F.lit(text).cast(dtype.simpleString()))


def select_grid(grid: GridTable, filterable: Iterable[str] | None = None, strict: bool = False,
                **query: Any) -> GridTable:
    """Apply a query dict: unknown keys and keys starting ``__`` are ignored,
    the rest are ANDed.  A scalar removes its dim from ``dims`` while the
    coordinate stays as a constant column.  ``strict=True`` raises KeyError
    for list or scalar labels that are not on the axis (array semantics)."""
    allowed = set(grid.dims if filterable is None else filterable) & set(grid.dims)
    df, dims = grid.df, list(grid.dims)
    for key, value in query.items():
        if key.startswith("__") or key not in allowed:
            continue
        if isinstance(value, tuple) and len(value) == 2:
            df = filter_range(df, key, value[0], value[1])
            if "year" in df.columns and "year" not in grid.dims and grid.is_time(key):
                df = _year_pruning(df, value)
        elif isinstance(value, list):
            df = filter_in(df, key, value, strict=strict)
        else:
            if strict and filter_eq(grid.df, key, value).limit(1).count() == 0:
                raise KeyError(f"label {value!r} not found on {key!r}")
            df = filter_eq(df, key, value)
            dims.remove(key)
    return grid.with_df(df, dims=tuple(dims), clustered=grid.clustered)


def _year_pruning(df: DataFrame, bounds: tuple) -> DataFrame:
    """Tables saved partitioned by year: the same time range expressed on the
    partition column, so whole year folders are skipped (Spark does not
    derive it from the timestamp predicate)."""
    years = [typed_literal(b, T.TimestampNTZType()) for b in bounds if b is not None]
    if len(years) == 2:
        return df.where(F.col("year").between(F.least(*[F.year(y) for y in years]),
                                              F.greatest(*[F.year(y) for y in years])))
    if bounds[0] is not None:
        return df.where(F.col("year") >= F.year(years[0]))
    return df.where(F.col("year") <= F.year(years[0]))


def project_columns(grid: GridTable, filterable: Iterable[str] | None = None) -> DataFrame:
    """Output order: queryable 1-D coordinates, auxiliary role coordinates,
    the value; each column once.  Unlisted coordinates vanish, rows stay."""
    allowed = None if filterable is None else set(filterable)
    queryable = [c for c in grid.dims if allowed is None or c in allowed]
    ordered: list[str] = []
    for c in [*queryable, *grid.aux, grid.value]:
        if c not in ordered and c in grid.df.columns:
            ordered.append(c)
    return grid.df.select(*ordered)


def attach_aux_coords(grid: GridTable, aux_df: DataFrame, on: list[str], columns: list[str]) -> GridTable:
    """Join auxiliary coordinates keyed by (some of) the grid's dims.

    A key that comes twice would multiply cells, so it raises (one grouped
    count of the aux table).  Whether the aux table is broadcast is decided by
    its measured size at run time; beyond that both sides are shuffled.
    """
    side = aux_df.select(*on, *columns)
    twice = side.groupBy(*on).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"auxiliary coordinates are given twice for {[twice[0][c] for c in on]}")
    df = grid.df.join(side, on, "left")
    return grid.with_df(df.select(*grid.dims, *[a for a in grid.aux if a not in columns], *columns, grid.value),
                        aux=tuple([*grid.aux, *columns]))


def first_slice(grid: GridTable, keep: Iterable[str] | None = None) -> GridTable:
    """Position 0 of every non-spatial dim in stored order; the first label per dim comes from
    a scalar subquery (an end of the axis), so no value travels via the driver."""
    keep = set(keep) if keep is not None else set(grid.spatial_dims)
    df = grid.df
    for d in grid.dims:
        if d not in keep:
            first = grid.df.select(F.max(d) if d in grid.descending else F.min(d)).scalar()
            df = df.where(F.col(d) == first)
    return grid.with_df(df)


def single_label_dims(df: DataFrame, labels: dict[str, Column]) -> list[str]:
    """The dims of ``labels`` that have exactly one (and no NULL): their least and greatest label agree (one aggregate
    without distinct counts, which reads only the columns of the labels)."""
    if not labels:
        return []
    row = df.agg(*[((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))).alias(d) for d, c in labels.items()]).first()
    return [d for d in labels if row[d]]


def without_dims(grid: GridTable, drop: list[str]) -> GridTable:
    return grid.with_df(grid.df.drop(*drop), dims=tuple(d for d in grid.dims if d not in drop)) if drop else grid


def squeeze(grid: GridTable) -> GridTable:
    """Drop dims that hold a single label."""
    if grid.catalog is not None:
        return without_dims(grid, [d for d, n in grid.catalog.sizes().items() if n == 1])
    return without_dims(grid, single_label_dims(grid.df, {d: F.col(d) for d in grid.dims}))


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(subset=subset)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[to_numeric(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def to_timestamp_safe(df: DataFrame, column: str) -> DataFrame:
    """Calendar strings become timestamp_ntz only if every non-null value
    parses; otherwise the whole column stays text.  One aggregate decides."""
    parsed = F.col(column).try_cast("timestamp_ntz")
    row = df.agg(F.count(column).alias("n"), F.count(parsed).alias("ok")).collect()[0]
    if row["n"] == row["ok"]:
        return df.withColumn(column, parsed)
    return df.withColumn(column, F.col(column).cast("string"))
