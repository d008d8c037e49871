"""Grids built from the supplied tables (FIXTURES §2).

Each builder reads Parquet with only the columns it needs (the scan's
ReadSchema shows the pruning) and returns a ``GridTable``; aggregation to
cells is a grouped aggregate, so the work grows with the input table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.functions.scalar import stable_round
from gridcells.model import GridDataset, GridTable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events_grid(spark: SparkSession, sf_dir: str) -> GridTable:
    """``g``: events on (time = day, lat = hour of day, lon = user_id mod 20),
    value = mean event value per cell (6 decimals).  Sparse: only cells with
    events exist."""
    ev = table(spark, sf_dir, "events")
    cells = ev.groupBy(
        F.to_date("ts").cast("timestamp_ntz").alias("time"),
        F.hour("ts").cast("double").alias("lat"),
        (F.col("user_id") % 20).cast("double").alias("lon"),
    ).agg(stable_round(F.avg("value"), 6).alias("value"))
    return GridTable.from_frame(
        cells, ("time", "lat", "lon"), "value",
        attrs={"long_name": "Mean event value", "units": "1"},
        coord_attrs={"lat": {"units": "degrees_north"}, "lon": {"units": "degrees_east"}},
        unique_cells=True,
    )


def lineitem_grid(spark: SparkSession, sf_dir: str, value: str = "l_quantity") -> GridTable:
    """``li``: lineitem rows as observations on (l_shipdate, l_returnflag,
    l_linestatus); several rows may fall in one cell."""
    li = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_returnflag", "l_linestatus", value)
    return GridTable.from_frame(li, ("l_shipdate", "l_returnflag", "l_linestatus"), value)


def orders_grid(spark: SparkSession, sf_dir: str) -> GridTable:
    """``oo``: orders on (o_orderdate, o_orderpriority, o_orderstatus), value
    o_totalprice, one row per order."""
    oo = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return GridTable.from_frame(oo, ("o_orderdate", "o_orderpriority", "o_orderstatus"), "o_totalprice")


def orders_daily_grid(spark: SparkSession, sf_dir: str) -> GridTable:
    """Orders aggregated per cell: total price per (day, priority, status)."""
    oo = table(spark, sf_dir, "orders")
    cells = oo.groupBy("o_orderdate", "o_orderpriority", "o_orderstatus").agg(
        F.sum("o_totalprice").alias("o_totalprice"))
    return GridTable.from_frame(cells, ("o_orderdate", "o_orderpriority", "o_orderstatus"), "o_totalprice",
                                unique_cells=True)


def orders_compare_dataset(spark: SparkSession, sf_dir: str) -> GridDataset:
    """Two variables over orders: ``price`` = mean total price per (day,
    priority, status) and ``orders`` = order count per (day, priority)."""
    oo = table(spark, sf_dir, "orders")
    price = oo.groupBy("o_orderdate", "o_orderpriority", "o_orderstatus").agg(
        F.avg("o_totalprice").alias("price"))
    count = oo.groupBy("o_orderdate", "o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("orders"))
    return GridDataset({
        "price": GridTable.from_frame(price, ("o_orderdate", "o_orderpriority", "o_orderstatus"), "price",
                                      unique_cells=True),
        "orders": GridTable.from_frame(count, ("o_orderdate", "o_orderpriority"), "orders", unique_cells=True),
    })
