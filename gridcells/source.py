"""``GridSource``: the reference's source API over a ``GridDataset``.

Every method returns a lazy Spark DataFrame (or a ``GridTable``) built by the
operators; nothing here materialises data except the row guard's bounded
count.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any, Iterable

from pyspark.sql import DataFrame, SparkSession

from gridcells.model import GridDataset, GridTable
from gridcells.operators import preview as _preview
from gridcells.operators import profile, roles, select, sql
from gridcells.operators.transforms import apply_transform
from gridcells.sources import guard, readers


class GridSource:
    def __init__(self, dataset: GridDataset | None = None, uri: str | None = None, *,
                 spark: SparkSession | None = None, dims: Iterable[str] | None = None, value: str | None = None,
                 filterable_coords: list[str] | None = None, max_rows: int = 0, **load_kwargs: Any):
        if dataset is None and uri is None:
            raise ValueError("Either a dataset or a uri is required.")
        self.filterable_coords = filterable_coords
        self.max_rows = max_rows
        if dataset is None:
            spark = spark or SparkSession.active()
            if dims is None or value is None:
                raise ValueError("Opening a uri needs the dims and the value column of the cell table.")
            multi = readers.looks_like_multi_input(uri)
            df = readers.open_multi(spark, uri, **load_kwargs) if multi else readers.open_single(spark, uri, **load_kwargs)
            uris = tuple(readers.expand_input_uris(uri, spark))
            dataset = GridDataset({value: GridTable.from_frame(df, tuple(dims), value)},
                                  source_mode="multi" if multi else "single", source_uris=uris)
        self.dataset = dataset
        self._roles: dict[str, dict[str, str | None]] = {}

    # -- tables -----------------------------------------------------------
    def get_tables(self) -> list[str]:
        return self.dataset.tables

    def table(self, name: str) -> GridTable:
        return self.dataset.table(name)

    def select(self, table: str, **query: Any) -> GridTable:
        return select.select_grid(self.table(table), self.filterable_coords, **query)

    def get(self, table: str, **query: Any) -> DataFrame:
        """Selected cells with the output columns of the array model, after
        the row guard (``max_rows``, 0 = off)."""
        df = select.project_columns(self.select(table, **query), self.filterable_coords)
        return guard.row_guard(df, self.max_rows)

    def sample(self, table: str, limit: int = 250, **query: Any) -> DataFrame:
        sel = self.select(table, **query)
        return select.project_columns(sel.with_df(_preview.preview(sel, limit)), self.filterable_coords)

    # -- profiles ---------------------------------------------------------
    def get_schema(self, table: str) -> DataFrame:
        return profile.schema_profile(select.project_columns(self.table(table), self.filterable_coords))

    def get_metadata(self, table: str | None = None) -> DataFrame:
        ds = self.dataset if table is None else GridDataset({table: self.table(table)}, self.dataset.attrs,
                                                             self.dataset.source_mode, self.dataset.source_uris)
        return roles.table_metadata(self.table(self.get_tables()[0]).df.sparkSession, ds)

    def get_dimension_info(self, table: str) -> DataFrame:
        return profile.dimension_info(self.table(table))

    def get_dimension_labels(self, table: str, dims: list[str] | None = None) -> DataFrame:
        return profile.dimension_labels(self.table(table), dims)

    def describe(self) -> DataFrame:
        return profile.describe(self.dataset)

    def estimate_query_cost(self, table: str, **query: Any) -> DataFrame:
        """From the stored axes of a saved dataset, without reading cells; else from the cells."""
        grid = self.table(table)
        if grid.catalog is not None:
            allowed = set(grid.dims if self.filterable_coords is None else self.filterable_coords)
            return grid.catalog.query_cost(grid, **{k: v for k, v in query.items() if k in allowed})
        return profile.query_cost(grid, self.select(table, **query))

    def coordinate_roles(self, table: str) -> DataFrame:
        return roles.column_roles(self.table(table))

    def coordinate_metadata(self, table: str) -> DataFrame:
        return roles.coord_metadata(self.table(table))

    # -- SQL and transforms -------------------------------------------------
    def execute(self, query: str, max_rows: int = 0, preview_rows: int | None = None) -> DataFrame:
        spark = self.table(self.get_tables()[0]).df.sparkSession
        return sql.sql_execute(spark, self.dataset, query, max_rows=max_rows, preview_rows=preview_rows)

    def example_queries(self, table: str | None = None) -> list[str]:
        name = table if table in self.get_tables() else self.get_tables()[0]
        return list(sql.example_queries(name, self.table(name)).values())

    def transform(self, table: str, transform: str = "none", query: dict | None = None, **kw: Any):
        grid = self.select(table, **(query or {}))
        return apply_transform(grid if grid.roles else replace(grid, roles=self.roles(table)), transform, **kw)

    def roles(self, table: str) -> dict[str, str | None]:
        """Detected roles of the table's coordinates, found once."""
        if table not in self._roles:
            self._roles[table] = dict(self.table(table).roles) or roles.detect_roles(self.table(table))
        return self._roles[table]
