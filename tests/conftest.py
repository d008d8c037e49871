import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridcells.model import GridTable  # noqa: E402
from gridcells.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4, app="gridcells-tests")
    yield s


def D(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture()
def synthetic(spark):
    """temperature(time, lat, lon), values 1..8 row-major."""
    rows, v = [], 1.0
    for t in ("2024-01-01", "2024-01-02"):
        for lat in (10.0, 20.0):
            for lon in (70.0, 80.0):
                rows.append((D(t), lat, lon, v))
                v += 1
    df = spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, temperature double")
    return GridTable.from_frame(df, ("time", "lat", "lon"), "temperature")


@pytest.fixture()
def monthly(spark):
    """6 month starts x lat (10, 20) x lon (70, 80); value 4i + 2j + k."""
    rows = []
    for i in range(6):
        for j, lat in enumerate((10.0, 20.0)):
            for k, lon in enumerate((70.0, 80.0)):
                rows.append((dt.datetime(2024, i + 1, 1), lat, lon, float(4 * i + 2 * j + k)))
    df = spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, temperature double")
    return GridTable.from_frame(df, ("time", "lat", "lon"), "temperature",
                                coord_attrs={"lat": {"units": "degrees_north"}, "lon": {"units": "degrees_east"}})


@pytest.fixture()
def multi_table(spark):
    """temperature and humidity per (time, station)."""
    times = [D("2024-02-01"), D("2024-02-02"), D("2024-02-03")]
    temp = [20, 22, 21.5, 23.5, 19, 24]
    hum = [55, 58, 57, 61, 54, 63]
    rows_t, rows_h = [], []
    for i, t in enumerate(times):
        for j, st in enumerate(("alpha", "beta")):
            rows_t.append((t, st, float(temp[2 * i + j])))
            rows_h.append((t, st, float(hum[2 * i + j])))
    t = spark.createDataFrame(rows_t, "time timestamp_ntz, station string, temperature double")
    h = spark.createDataFrame(rows_h, "time timestamp_ntz, station string, humidity double")
    return (GridTable.from_frame(t, ("time", "station"), "temperature"),
            GridTable.from_frame(h, ("time", "station"), "humidity"))
