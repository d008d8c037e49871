"""Opening and combining inputs.

Paths are any Hadoop URI (local, HDFS, object stores); globbing and listing
are Hadoop's.  Several inputs are stacked by column name.
"""

from __future__ import annotations

import glob as _glob
import math
import re
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.model import GridDataset

_GLOB_CHARS = re.compile(r"[*?\[\]]")
_FORMATS = {"parquet": "parquet", "pq": "parquet", "orc": "orc", "csv": "csv", "json": "json", "jsonl": "json"}


def looks_like_multi_input(uri: str) -> bool:
    return "\n" in uri or ";" in uri or bool(_GLOB_CHARS.search(uri))


def expand_input_uris(uri: str, spark: SparkSession | None = None) -> list[str]:
    """Newline- or ';'-separated list; glob patterns expanded and sorted, an
    unmatched pattern kept literally (opening it then fails).  With a session
    the Hadoop file system expands the pattern, so any URI scheme works."""
    parts = [p.strip() for p in re.split(r"[\n;]", uri) if p.strip()]
    out: list[str] = []
    for p in parts:
        if not _GLOB_CHARS.search(p):
            out.append(p)
            continue
        matches = _hadoop_glob(spark, p) if spark is not None else sorted(_glob.glob(p))
        out.extend(matches if matches else [p])
    return out


def _hadoop_glob(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    statuses = fs.globStatus(path) or []
    return sorted(str(s.getPath().toString()) for s in statuses)


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return _FORMATS.get(ext, "parquet")


def open_single(spark: SparkSession, uri: str | None, fmt: str | None = None, schema=None, **load_kwargs) -> DataFrame:
    """Open one path.  A known ``schema`` (DDL string or StructType) skips
    schema inference, which otherwise reads file footers (or, for CSV/JSON,
    scans the data) in an extra job."""
    if not uri:
        raise ValueError("Either a dataset or a uri is required.")
    reader = spark.read.format(_format_of(uri, fmt)).options(**load_kwargs)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(uri)


def open_multi(spark: SparkSession, uri: str | Iterable[str], fmt: str | None = None, schema=None,
               **load_kwargs) -> DataFrame:
    """Open every input and stack them by column name (missing columns NULL).

    Inputs of one format are one scan over a list of paths, whose schemas Spark merges
    in parallel; only CSV without a schema, whose columns go by position, is one
    scan a path."""
    paths = expand_input_uris(uri, spark) if isinstance(uri, str) else list(uri)
    if not paths:
        raise ValueError("No input paths.")
    groups: dict[str, list[str]] = {}
    for p in paths:
        kind = _format_of(p, fmt)
        groups.setdefault(p if kind == "csv" and schema is None else kind, []).append(p)
    frames = []
    for members in groups.values():
        reader = spark.read.format(_format_of(members[0], fmt)).options(**{"mergeSchema": "true", **load_kwargs})
        frames.append((reader if schema is None else reader.schema(schema)).load(members))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def part_bounds(parts: list[DataFrame], dims: list[str]) -> list[dict[str, tuple]]:
    """Of each part, its least and greatest label and whether it has a NULL label, per dim; {} for a part without
    rows.  One pass over the dims, of which a row a part is moved."""
    stacked = _stacked([p.select(*dims) for p in parts])
    rows = stacked.groupBy("__part").agg(*[x for i, d in enumerate(dims) for x in (
        F.min(d).alias(f"lo{i}"), F.max(d).alias(f"hi{i}"), F.max(F.col(d).isNull()).alias(f"no{i}"))]).collect()

    def placed(label):
        return math.inf if label != label else label         # NaN is the greatest label

    found = {r["__part"]: {d: (placed(r[f"lo{i}"]), placed(r[f"hi{i}"]), r[f"no{i}"]) for i, d in enumerate(dims)} for r in rows}
    return [found.get(i, {}) for i in range(len(parts))]


def _meet(a: tuple, b: tuple) -> bool:
    """Whether two spans of one dim share a label, as far as bounds can tell."""
    if a[2] and b[2]:
        return True
    return None not in (a[0], b[0]) and a[0] <= b[1] and b[0] <= a[1]


def parts_that_meet(bounds: list[dict[str, tuple]], dims: list[str]) -> set[int]:
    """Numbers of the parts whose box touches another part's: a sweep along each dim, of which the one with the fewest
    pairs is followed."""
    boxes = [i for i, b in enumerate(bounds) if b]

    def sweep(d: str) -> Iterable[tuple[int, int]]:
        spans = [i for i in boxes if bounds[i][d][0] is not None]
        order = sorted(spans, key=lambda i: bounds[i][d][0])
        active: list[int] = []
        for i in order:
            active = [j for j in active if _meet(bounds[j][d], bounds[i][d])]
            yield from ((j, i) for j in active)
            active.append(i)
        nulls = [i for i in boxes if bounds[i][d][2]]
        yield from ((i, j) for k, i in enumerate(nulls) for j in nulls[k + 1:])

    fewest = min(([*sweep(d)] for d in dims), key=len, default=[])
    return {x for i, j in fewest if all(_meet(bounds[i][d], bounds[j][d]) for d in dims) for x in (i, j)}


def _stacked(parts: list[DataFrame]) -> DataFrame:
    numbered = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def combine_parts(parts: list[DataFrame], dims: list[str], on_overlap: str = "error") -> DataFrame:
    """Stack parts holding the same variable along their coordinates.

    Overlapping cells (a cell present in two parts): ``error`` raises.  The bounds of the parts are compared first, and only
    the cells of parts that meet are counted, so parts that lie apart cost no shuffle.  ``first`` keeps
    the values of the earliest part that has the cell, ``keep`` leaves all rows.
    """
    if not parts:
        raise ValueError("Nothing to combine.")
    stacked = _stacked(parts)
    if on_overlap == "keep":
        return stacked.drop("__part")
    if on_overlap == "first":
        rest = [c for c in stacked.columns if c not in dims and c != "__part"]
        # within a part the least values decide, so the result does not depend on the order of rows
        first = F.min(F.struct("__part", *rest)).alias("__first")
        return stacked.groupBy(*dims).agg(first).select(*dims, *[F.col(f"__first.{c}").alias(c) for c in rest])
    meeting = parts_that_meet(part_bounds(parts, dims), dims)
    if meeting:
        some = _stacked([p.select(*dims).withColumn("__from", F.lit(i)) for i, p in enumerate(parts) if i in meeting])
        twice = some.groupBy(*dims).agg(F.min("__from").alias("a"), F.max("__from").alias("b")).where("a < b").limit(1).collect()
        if twice:
            raise ValueError(f"parts overlap at cell {twice[0].asDict()}")
    return stacked.drop("__part")


def combine_datasets(datasets: list[GridDataset], along: str, on_overlap: str = "error") -> GridDataset:
    """Datasets of several files as one: variables on the dim ``along`` are stacked, and a variable without that dim, which
    every file repeats, is kept once, as the first file has it."""
    if not datasets:
        raise ValueError("Nothing to combine.")
    names = list(dict.fromkeys(n for ds in datasets for n in ds.variables))
    out = {}
    for name in names:
        grids = [ds.variables[name] for ds in datasets if name in ds.variables]
        first = grids[0]
        if along in first.dims and len(grids) > 1:
            first = first.with_df(combine_parts([g.df for g in grids], list(first.dims), on_overlap), unique_cells=first.unique_cells and on_overlap != "keep")
        out[name] = first
    return GridDataset(out, attrs={k: v for k, v in datasets[0].attrs.items() if all(ds.attrs.get(k, v) == v for ds in datasets)},
                       source_mode="multi", source_uris=tuple(u for ds in datasets for u in ds.source_uris))


def merge_variables(frames: dict[str, DataFrame], dims: list[str]) -> DataFrame:
    """Parts holding different variables become one table of cells, one value column per variable.

    Variables on the same dims are one tagged union, grouped by cell (NULL labels alike) in one exchange, whatever their number; a cell that a
    variable has twice raises when the result is computed.  A variable on some of the dims only is then joined
    on those it shares."""
    by_dims: dict[tuple[str, ...], list[str]] = {}
    for name, df in frames.items():
        by_dims.setdefault(tuple(d for d in dims if d in df.columns), []).append(name)
    whole = [(own, names[0], _union_merged({n: frames[n] for n in names}, list(own))) for own, names in by_dims.items()]
    (_, first, out), rest = whole[0], whole[1:]
    for _, name, right in rest:
        shared = [d for d in dims if d in out.columns and d in right.columns]
        if not shared:
            raise ValueError(f"{name!r} shares no dimension of {dims} with {first!r}, so their cells cannot be matched")
        l, r = out.alias("l"), right.alias("r")
        cond = [F.col(f"l.{d}").eqNullSafe(F.col(f"r.{d}")) for d in shared]
        joined = l.join(r, cond, "full_outer")
        keep = [F.coalesce(F.col(f"l.{d}"), F.col(f"r.{d}")).alias(d) for d in shared]
        rest_l = [F.col(f"l.{c}") for c in out.columns if c not in shared]
        rest_r = [F.col(f"r.{c}") for c in right.columns if c not in shared]
        out = joined.select(*keep, *rest_l, *rest_r)
    return out


def _union_merged(frames: dict[str, DataFrame], dims: list[str]) -> DataFrame:
    """Variables on the same dims in one grouped pass."""
    if len(frames) == 1:
        return next(iter(frames.values()))
    values = {n: [c for c in df.columns if c not in dims] for n, df in frames.items()}
    columns = [c for n in frames for c in values[n]]
    if len(set(columns)) < len(columns):
        raise ValueError(f"two variables have a column of the same name among {columns}")
    tagged = None
    for name, df in frames.items():
        part = df.select(*dims, *values[name], F.lit(True).alias(f"__has_{name}"))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    cells = tagged.groupBy(*dims).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns],
                                      F.greatest(*[F.count(f"__has_{n}") for n in frames]).alias("__most"))
    twice = F.raise_error(F.concat(F.lit("a variable has a cell twice: "), F.to_json(F.struct(*dims))))
    checked = [F.when(F.col("__most") > 1, twice.cast(cells.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in columns]
    return cells.select(*dims, *checked)


def merge_attrs(meta: DataFrame) -> DataFrame:
    """Attributes ``(part, owner, key, value)`` of several parts: a key whose
    parts disagree is dropped (drop_conflicts); agreeing keys kept once."""
    agreed = meta.groupBy("owner", "key").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    return agreed.where(F.col("n") == 1).select("owner", "key", "value")
