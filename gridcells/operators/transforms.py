"""Transforms by name, as one call.

Each transform is an entry of ``TRANSFORMS``: how it builds its grid, and which parameters it reports.
``apply_transform`` looks the entry up, and describes the result in a ``TransformReport``; nothing is computed
over the data unless the caller asks for sizes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from gridcells.functions.scalar import bin_number, month_of
from gridcells.model import GridTable
from gridcells.operators import reduce, windows
from gridcells.operators.axes import axis_sizes
from gridcells.operators.roles import with_roles
from gridcells.operators.select import single_label_dims, without_dims


@dataclass(frozen=True)
class Settings:
    window: int = 3
    aggregation: str = "mean"
    rule: str = "QS-DEC"


@dataclass(frozen=True)
class Transform:
    build: Callable[[GridTable, Settings], GridTable]
    parameters: Callable[[GridTable, Settings], dict[str, Any]] = lambda grid, s: {}
    horizontal: bool = False         # whether it needs the roles of horizontal coordinates


@dataclass
class TransformReport:
    """What a transform did: its parameters, the dims it was given and those left, the value's unit
    and type; ``sizes`` (labels per dim, before and after) only if measured."""

    name: str
    parameters: dict[str, Any]
    dims_before: tuple[str, ...]
    dims_after: tuple[str, ...]
    units: str | None
    dtype: str
    sizes: dict[str, dict[str, int]] = field(default_factory=dict)


def _monthly(grid: GridTable) -> bool:
    return grid.is_time(grid.require_time("anomaly"))


def _anomaly(grid: GridTable, s: Settings) -> GridTable:
    return windows.monthly_anomaly(grid, s.aggregation) if _monthly(grid) else windows.mean_anomaly(grid)


def _climatology(grid: GridTable, s: Settings) -> GridTable:
    if not grid.is_time(grid.require_time("climatology")):
        raise ValueError(f"{grid.time_dim!r} holds no dates, so it has no months to group by")
    return reduce.climatology(grid, s.aggregation)


# The names of the transforms.
TRANSFORMS: dict[str, Transform] = {
    "none": Transform(lambda grid, s: grid),
    "rolling mean": Transform(lambda grid, s: windows.rolling_mean(grid, s.window), lambda grid, s: {"window": max(int(s.window), 1)}),
    "anomaly": Transform(_anomaly, lambda grid, s: {"baseline": f"{s.aggregation} of each month" if _monthly(grid) else "mean over all times"}),
    "resample": Transform(lambda grid, s: reduce.resample(grid, s.rule, s.aggregation, fill_empty=True),
                          lambda grid, s: {"rule": s.rule, "aggregation": s.aggregation}),
    "climatology": Transform(_climatology, lambda grid, s: {"aggregation": s.aggregation}),
    "spatial mean": Transform(lambda grid, s: reduce.spatial_mean(grid, s.aggregation),
                              lambda grid, s: {"over": grid.spatial_dims, "aggregation": s.aggregation}, horizontal=True),
    "zonal mean": Transform(lambda grid, s: reduce.zonal_mean(grid, s.aggregation),
                            lambda grid, s: {"over": (grid.lon_dim,), "aggregation": s.aggregation}, horizontal=True),
}
TRANSFORM_OPTIONS = tuple(TRANSFORMS)


def apply_transform(grid: GridTable, transform: str = "none", *, window: int = 3, aggregation: str = "mean",
                    resample_rule: str = "QS-DEC", squeeze: bool = True,
                    measure: bool = False) -> tuple[GridTable, TransformReport]:
    """Build the transformed grid and its report.

    ``squeeze`` drops dims that are left with one label: a pass over the labels of the grid it is given, whose values and
    result are not computed for it.  ``measure`` adds sizes, by an aggregate pass over the result.
    Roles of horizontal coordinates are detected where a transform needs them and the grid names none."""
    if transform not in TRANSFORMS:
        raise ValueError(f"{transform!r} is none of the transforms {list(TRANSFORMS)}")
    entry, settings = TRANSFORMS[transform], Settings(window, aggregation, resample_rule)
    if entry.horizontal and not grid.spatial_dims:
        grid = with_roles(grid)
    out = entry.build(grid, settings)
    if squeeze:
        t = grid.time_dim
        labels = {d: F.col(d) for d in out.dims if d in grid.dims}
        if transform == "resample":
            labels[t] = bin_number(t, settings.rule)
        if transform == "climatology":
            labels["month"] = month_of(t)
        out = without_dims(out, single_label_dims(grid.df, labels))
    report = TransformReport(transform, entry.parameters(grid, settings), tuple(grid.dims), tuple(out.dims),
                             out.attrs.get("units") or grid.attrs.get("units"), out.dtype(out.value).simpleString())
    if measure:
        report.sizes = {"before": axis_sizes(grid.df, list(grid.dims)), "after": axis_sizes(out.df, list(out.dims))}
    return out, report
