"""Sinks.  Writers are distributed: every task writes
its own part file; nothing goes through the driver."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.model import CLUSTER_KEY, GridDataset, GridTable
from gridcells.operators import axis_catalog
from gridcells.operators.profile import ITEMSIZE, TEXT_ITEMSIZE

ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).option("timestampNTZFormat", ISO_TS).csv(path)
    return path


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON Lines records with ISO timestamps."""
    df.write.mode(mode).option("timestampNTZFormat", ISO_TS).json(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("timestampNTZFormat", ISO_TS).csv(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("timestampNTZFormat", ISO_TS).json(path)


def save_dataset(dataset: GridDataset, path: str, partition_by_year: bool = True, mode: str = "overwrite",
                 num_files: int | None = None, clustered: bool = False, file_bytes: int = 128 << 20) -> str:
    """One Parquet table per variable plus a metadata table of attrs and, for each table, its stored axes
    (``operators/axis_catalog.py``).

    By time (the default): cells are range partitioned on time before writing and partitioned by year, so each task writes
    into one or two year folders and each file's min/max time statistics are tight, which lets Parquet skip row groups for
    time filters.  ``clustered``: cells are bucketed by a hash of the other dims and sorted by time within a place, in buckets of about ``file_bytes``; windows over time
    and monthly groups then need no exchange of cells.  It is for tables with one row a cell (a place with many rows would be one
    bucket's), a time dim and another one; other tables are written by time.  ``num_files`` sets the number of files or buckets."""
    rows = []
    spark = next(iter(dataset.variables.values())).df.sparkSession
    for name, grid in dataset.variables.items():
        t, where = grid.time_dim, os.path.join(path, name)
        bucketed = clustered and grid.unique_cells and t is not None and len(grid.dims) > 1
        if bucketed:
            n = num_files or _bucket_count(grid, file_bytes)
            _write_buckets(grid, where, n, mode)
            rows.append((name, "__grid__", "buckets", str(n)))
        else:
            _write_by_time(grid, where, t, partition_by_year, mode, num_files)
        rows += [(name, name, k, str(v)) for k, v in grid.attrs.items()]
        rows += [(name, c, k, str(v)) for c, a in grid.coord_attrs.items() for k, v in a.items()]
        rows.append((name, "__grid__", "dims", ",".join(grid.dims)))
        rows.append((name, "__grid__", "value", grid.value))
        rows.append((name, "__grid__", "unique_cells", "true" if grid.unique_cells else "false"))
        rows.append((name, "__grid__", "descending", ",".join(grid.descending)))
        rows.append((name, "__grid__", "schema", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.df.schema.fields)))
        axis_catalog.write_axes(spark.read.parquet(where), list(grid.dims), _axes_path(path, name))
    spark.createDataFrame(rows, "variable string, owner string, key string, value string") \
        .coalesce(1).write.mode(mode).parquet(os.path.join(path, "_metadata_table"))
    return path


def _axes_path(path: str, name: str) -> str:
    return os.path.join(path, "_axes", name)


def _write_by_time(grid: GridTable, where: str, t: str | None, by_year: bool, mode: str, num_files: int | None) -> None:
    df = grid.df
    if t:
        n = num_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # the other dims split a time label that holds many cells
        df = df.repartitionByRange(n, *[F.col(d) for d in (t, *grid.other_dims(t))]).sortWithinPartitions(t)
    if by_year and t:
        df.withColumn("year", F.year(t)).write.mode(mode).partitionBy("year").parquet(where)
    else:
        df.write.mode(mode).parquet(where)


def _bucket_count(grid: GridTable, file_bytes: int) -> int:
    width = sum(ITEMSIZE.get(t, TEXT_ITEMSIZE) for _, t in grid.df.dtypes)
    return max(1, -(-grid.df.count() * width // file_bytes), grid.df.sparkSession.sparkContext.defaultParallelism)


def _table_name(where: str) -> str:
    return "gridcells_" + hashlib.md5(where.encode()).hexdigest()[:16]


def _write_buckets(grid: GridTable, where: str, n: int, mode: str) -> None:
    others = grid.other_dims(grid.time_dim)
    spark = grid.df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(where)}")
    keyed = grid.df.withColumn(CLUSTER_KEY, F.xxhash64(*others))
    dealt = keyed.repartition(n, CLUSTER_KEY)        # as buckets are dealt, so a bucket is one file
    (dealt.write.mode(mode).format("parquet").bucketBy(n, CLUSTER_KEY).sortBy(CLUSTER_KEY, *others, grid.time_dim)
     .option("path", where).saveAsTable(_table_name(where)))


def _bucketed_table(spark: SparkSession, where: str, spec: dict, time_dim: str) -> DataFrame:
    """The bucketed table; a session that did not write it has it registered first."""
    name = _table_name(where)
    if not spark.catalog.tableExists(name):
        others = ", ".join(f"`{d}`" for d in spec["dims"].split(",") if d != time_dim)
        place = where.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({spec['schema']}, {CLUSTER_KEY} bigint) USING parquet OPTIONS (path '{place}') "
                  f"CLUSTERED BY ({CLUSTER_KEY}) SORTED BY ({CLUSTER_KEY}, {others}, `{time_dim}`) INTO {spec['buckets']} BUCKETS")
    return spark.table(name)


def load_dataset(spark: SparkSession, path: str) -> GridDataset:
    meta = spark.read.parquet(os.path.join(path, "_metadata_table")).collect()  # attrs only: small
    by_var: dict[str, dict] = {}
    for r in meta:
        v = by_var.setdefault(r["variable"], {"attrs": {}, "coord_attrs": {}})
        if r["owner"] == "__grid__":
            v[r["key"]] = r["value"]
        elif r["owner"] == r["variable"]:
            v["attrs"][r["key"]] = r["value"]
        else:
            v["coord_attrs"].setdefault(r["owner"], {})[r["key"]] = r["value"]
    variables = {}
    for name, spec in by_var.items():
        where, dims = os.path.join(path, name), tuple(spec["dims"].split(","))
        down = tuple(d for d in spec.get("descending", "").split(",") if d)
        files = spark.read.parquet(where)
        plain = GridTable(files, dims, spec["value"])
        bucketed = "buckets" in spec
        df = _bucketed_table(spark, where, spec, plain.time_dim) if bucketed else files
        # the year partition column stays (not a dim): time selections add a
        # predicate on it so whole year folders are pruned
        extra = [c for c in ("year", CLUSTER_KEY) if c in df.columns and c not in dims]
        catalog = axis_catalog.refresh(spark, files, _axes_path(path, name), dims, down)
        variables[name] = GridTable(df.select(*dims, spec["value"], *extra), dims, spec["value"],
                                    attrs=spec["attrs"], coord_attrs=spec["coord_attrs"],
                                    unique_cells=spec.get("unique_cells") == "true", descending=down, clustered=bucketed, catalog=catalog)
    return GridDataset(variables, source_mode="parquet", source_uris=(path,))
