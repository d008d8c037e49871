"""Data model: a grid variable held as a long cell table.

A ``GridTable`` is a Spark DataFrame with one row per cell: one column per
dimension (the coordinate value), optional auxiliary coordinate columns and one
value column named after the variable.  Dimension order matters for row-major
order and for previews.  Attributes (units, long_name, ...) travel as plain
dictionaries next to the DataFrame and are written as a metadata table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridcells.functions.scalar import nan_to_null

_TIME_TYPES = (T.TimestampNTZType, T.TimestampType, T.DateType)
_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


CLUSTER_KEY = "__gc_cell"


@dataclass(frozen=True)
class GridTable:
    df: DataFrame
    dims: tuple[str, ...]
    value: str
    aux: tuple[str, ...] = ()
    attrs: Mapping[str, str] = field(default_factory=dict)
    coord_attrs: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    roles: Mapping[str, str | None] = field(default_factory=dict)
    # dims each auxiliary (N-d) coordinate depends on, e.g. {"yc": ("y", "x")}
    aux_dims: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    # True when the table holds at most one row per cell (a proper grid, e.g.
    # the output of an aggregation); then any per-cell partition is bounded by
    # the axis lengths, not by the data volume.
    unique_cells: bool = False
    # dims whose labels are stored in descending order (positions count from the greatest label)
    descending: tuple[str, ...] = ()
    # True when all cells of one (other dims) lie in one partition of the scan, as a clustered saved
    # dataset has them by its column ``CLUSTER_KEY``, a hash of the other dims (windows name doubles in a normal form, by
    # which no scan is bucketed); a selection keeps that, any other operation is taken to lose it
    clustered: bool = False
    # the stored axes of a saved dataset (operators/axis_catalog.py); only for the whole, unchanged table
    catalog: Any = None

    def __post_init__(self) -> None:
        missing = [c for c in (*self.dims, self.value, *self.aux) if c not in self.df.columns]
        if missing:
            raise ValueError(f"columns {missing} are not in the cell table {self.df.columns}")

    # -- construction -----------------------------------------------------
    @classmethod
    def from_frame(
        cls,
        df: DataFrame,
        dims: tuple[str, ...] | list[str],
        value: str,
        aux: tuple[str, ...] | list[str] = (),
        *,
        nan_as_missing: bool = True,
        **kw,
    ) -> "GridTable":
        """Wrap a DataFrame; floating values have NaN turned into NULL once."""
        dtype = df.schema[value].dataType
        if nan_as_missing and isinstance(dtype, (T.FloatType, T.DoubleType)):
            df = df.withColumn(value, nan_to_null(value))
        cols = [*dims, *[a for a in aux if a not in dims], value]
        return cls(df.select(*cols), tuple(dims), value, tuple(aux), **kw)

    def with_df(self, df: DataFrame, dims: tuple[str, ...] | None = None, value: str | None = None,
                aux: tuple[str, ...] | None = None, unique_cells: bool | None = None, clustered: bool = False) -> "GridTable":
        return replace(
            self,
            df=df,
            clustered=clustered,
            catalog=None,
            unique_cells=self.unique_cells if unique_cells is None else unique_cells,
            dims=tuple(self.dims if dims is None else dims),
            value=self.value if value is None else value,
            aux=tuple(a for a in (self.aux if aux is None else aux) if a in df.columns),
        )

    # -- dimension resolution ---------------------------------------------
    def dtype(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    def is_time(self, column: str) -> bool:
        return isinstance(self.dtype(column), _TIME_TYPES)

    def is_numeric(self, column: str) -> bool:
        return isinstance(self.dtype(column), _NUMERIC_TYPES)

    @property
    def time_dim(self) -> str | None:
        """Role coordinate if it is a dimension, else the first datetime dim."""
        role = self.roles.get("time")
        if role in self.dims:
            return role
        return next((d for d in self.dims if self.is_time(d)), None)

    def role_column(self, role: str, token: str) -> str | None:
        """The coordinate of a role: the detected one, else the first dim with the token in its name."""
        found = self.roles.get(role)
        if found in self.df.columns:
            return found
        return next((d for d in self.dims if token in d.lower()), None)

    def role_dims(self, role: str, token: str) -> tuple[str, ...]:
        """The dims a role's coordinate varies over: itself, or those of an auxiliary coordinate."""
        column = self.role_column(role, token)
        own = (column,) if column in self.dims else tuple(self.aux_dims.get(column, ())) if column else ()
        return tuple(d for d in own if d in self.dims)

    def place(self) -> list[str]:
        """Keys of a place (all dims but time) for windows over time; with the clustering column where there is one."""
        others = self.other_dims(self.time_dim)
        return [CLUSTER_KEY, *others] if self.clustered else others

    def _only(self, dims: tuple[str, ...]) -> str | None:
        return dims[0] if len(dims) == 1 else None

    @property
    def lat_dim(self) -> str | None:
        return self._only(self.role_dims("latitude", "lat"))

    @property
    def lon_dim(self) -> str | None:
        return self._only(self.role_dims("longitude", "lon"))

    @property
    def spatial_dims(self) -> tuple[str, ...]:
        """Dims of both horizontal coordinates (both dims of a curvilinear grid, once)."""
        both = {*self.role_dims("latitude", "lat"), *self.role_dims("longitude", "lon")}
        return tuple(d for d in self.dims if d in both)

    def other_dims(self, *exclude: str | None) -> list[str]:
        return [d for d in self.dims if d not in exclude]

    def require_time(self, what: str) -> str:
        t = self.time_dim
        if t is None:
            raise ValueError(f"{what} requires a time dimension.")
        return t


@dataclass
class GridDataset:
    """Named variables sharing coordinates (the tables), plus dataset attrs."""

    variables: dict[str, GridTable]
    attrs: Mapping[str, str] = field(default_factory=dict)
    source_mode: str = "spark"
    source_uris: tuple[str, ...] = ()

    @property
    def tables(self) -> list[str]:
        return list(self.variables)

    def table(self, name: str) -> GridTable:
        if name not in self.variables:
            raise KeyError(f"Unknown table {name!r}.")
        return self.variables[name]

    def register_views(self) -> None:
        for name, grid in self.variables.items():
            grid.df.createOrReplaceTempView(name)
