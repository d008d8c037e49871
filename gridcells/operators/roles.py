"""Coordinate roles and metadata tables.

Each coordinate is scored for the roles time, latitude, longitude and
vertical from its name, attributes, type and finite value bounds.  The bounds
come from one aggregate pass over the cells; the scoring is column
expressions over the small profile table (one row per coordinate); each role
is then given to at most one coordinate, roles taken in order.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcells.functions.scalar import is_finite, normalize_text
from gridcells.model import GridDataset, GridTable

# Role order, minimum score, confidence cut-offs.
ROLE_ORDER = ("time", "latitude", "longitude", "vertical")
MIN_ROLE_SCORE = 7
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 14, 10

# Coordinate names recognised per role (normalised text).
TIME_EXACT_NAMES = ["time", "times", "date", "datetime", "valid_time", "forecast_time", "initial_time",
                    "reference_time", "xtime", "ocean_time"]
LATITUDE_EXACT_NAMES = ["lat", "latitude", "yc", "geolat", "clat", "tlat", "nav_lat", "xlat", "ylat", "rlat",
                        "yt_ocean", "yu_ocean", "yh", "yh_center", "south_north"]
LONGITUDE_EXACT_NAMES = ["lon", "longitude", "xc", "geolon", "clon", "tlon", "nav_lon", "xlong", "xlon", "rlon",
                         "xt_ocean", "xu_ocean", "xh", "xh_center", "west_east"]
VERTICAL_EXACT_NAMES = ["lev", "level", "levels", "depth", "height", "altitude", "pressure", "press", "isobaric",
                        "isobaric1", "bottom_top", "sigma", "sigma_level", "st_ocean", "s_rho", "z", "zt", "zw"]

# CF standard names per role.
TIME_STANDARD_NAMES = ["time", "forecast_reference_time", "forecast_period"]
LATITUDE_STANDARD_NAMES = ["latitude", "grid_latitude"]
LONGITUDE_STANDARD_NAMES = ["longitude", "grid_longitude"]
VERTICAL_STANDARD_NAMES = ["air_pressure", "altitude", "atmosphere_sigma_coordinate",
                           "atmosphere_hybrid_sigma_pressure_coordinate", "depth", "geopotential_height", "height",
                           "model_level_number", "ocean_s_coordinate"]

# Unit spellings per role.
LATITUDE_UNITS = ["degrees_north", "degree_north", "degrees_n", "degree_n", "degree_norths", "degreesnorth",
                  "degreenorth"]
LONGITUDE_UNITS = ["degrees_east", "degree_east", "degrees_e", "degree_e", "degree_easts", "degreeseast",
                   "degreeeast"]
PRESSURE_UNITS = ["pa", "hpa", "kpa", "bar", "mbar", "millibar", "millibars", "dbar"]
VERTICAL_LENGTH_UNITS = ["m", "meter", "meters", "metre", "metres", "km", "kilometer", "kilometers", "kilometre",
                         "kilometres", "cm", "centimeter", "centimeters", "centimetre", "centimetres"]

# Name / long_name tokens and bound ranges.
VERTICAL_NAME_TOKENS = ["depth", "height", "level", "lev", "pressure", "sigma", "alt"]
VERTICAL_LONG_NAME_TOKENS = ["depth", "height", "pressure", "altitude", "level"]
VERTICAL_STANDARD_SUFFIXES = ["pressure", "height", "depth"]
LATITUDE_BOUNDS = (-90.5, 90.5)
LONGITUDE_BOUNDS = (-180.5, 360.5)

_PROFILE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("dtype", T.StringType()),
    T.StructField("is_datetime", T.BooleanType()), T.StructField("is_numeric", T.BooleanType()),
    T.StructField("ndim", T.IntegerType()), T.StructField("dims", T.StringType()),
    T.StructField("standard_name", T.StringType()), T.StructField("long_name", T.StringType()),
    T.StructField("units", T.StringType()), T.StructField("axis", T.StringType()),
    T.StructField("positive", T.StringType()),
])


def _coordinates(grid: GridTable) -> list[tuple[str, tuple[str, ...]]]:
    coords = [(d, (d,)) for d in grid.dims]
    coords += [(a, tuple(grid.aux_dims.get(a, grid.dims))) for a in grid.aux if a not in grid.dims]
    return coords


def coordinate_profile(grid: GridTable) -> DataFrame:
    """One row per coordinate: attributes, dtype, dims and finite min/max
    (one aggregate pass over the cells for all numeric coordinates)."""
    spark = grid.df.sparkSession
    coords = _coordinates(grid)
    rows = []
    for name, cdims in coords:
        a = {k.strip().lower(): str(v).strip() for k, v in grid.coord_attrs.get(name, {}).items()}
        dtype = grid.dtype(name)
        rows.append((name, dtype.simpleString(), grid.is_time(name), grid.is_numeric(name), len(cdims),
                     ",".join(cdims), a.get("standard_name", ""), a.get("long_name", a.get("description", "")),
                     a.get("units", ""), a.get("axis", ""), a.get("positive", "")))
    numeric = [n for n, _ in coords if grid.is_numeric(n)]
    bounds: dict[str, tuple] = {}
    if numeric:
        # one aggregate pass over the cells; the result is one row of
        # 2 x (number of coordinates) values
        finite = {n: F.when(is_finite(F.col(n)), F.col(n).cast("double")) for n in numeric}
        row = grid.df.agg(*[x for i, n in enumerate(numeric) for x in (
            F.min(finite[n]).alias(f"lo{i}"), F.max(finite[n]).alias(f"hi{i}"))]).collect()[0]
        bounds = {n: (row[f"lo{i}"], row[f"hi{i}"]) for i, n in enumerate(numeric)}
    rows = [r + bounds.get(r[0], (None, None)) for r in rows]
    schema = T.StructType([*_PROFILE_SCHEMA.fields, T.StructField("lo", T.DoubleType()),
                           T.StructField("hi", T.DoubleType())])
    # the profile has one row per coordinate (schema-sized, not data-sized)
    return spark.createDataFrame(rows, schema)


# Points and reason text of each scoring rule, per role, in
# rule order (the conditions are paired with them in ``_conditions``).
TIME_RULES = [
    (8, "time-like coordinate name"),
    (10, "CF standard_name indicates time"),
    (7, "axis=T attribute"),
    (10, "datetime dtype"),
    (7, "CF time units"),
    (4, "long_name suggests time"),
]
LATITUDE_RULES = [
    (8, "latitude-style coordinate name"),
    (5, "latitude token in name"),
    (10, "CF standard_name=latitude"),
    (10, "latitude units"),
    (3, "axis=Y attribute"),
    (5, "long_name suggests latitude"),
    (4, "numeric bounds fit latitude range"),
]
LONGITUDE_RULES = [
    (8, "longitude-style coordinate name"),
    (5, "longitude token in name"),
    (10, "CF standard_name=longitude"),
    (10, "longitude units"),
    (3, "axis=X attribute"),
    (5, "long_name suggests longitude"),
    (4, "numeric bounds fit longitude range"),
]
VERTICAL_RULES = [
    (8, "vertical-style coordinate name"),
    (5, "vertical token in name"),
    (10, "CF standard_name indicates vertical axis"),
    (7, "axis=Z attribute"),
    (6, "positive attribute indicates vertical axis"),
    (7, "pressure units"),
    (4, "length units"),
    (4, "long_name suggests vertical axis"),
]
RULES = {"time": TIME_RULES, "latitude": LATITUDE_RULES, "longitude": LONGITUDE_RULES, "vertical": VERTICAL_RULES}


def _in(col: str, values: list[str]) -> str:
    return f"{col} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def _any(fn: str, col: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"{fn}({col}, '{t}')" for t in tokens) + ")"


def _within(bounds: tuple[float, float]) -> str:
    a, b = bounds
    return f"(lo IS NOT NULL AND hi IS NOT NULL AND lo BETWEEN {a} AND {b} AND hi BETWEEN {a} AND {b})"


def _conditions(role: str) -> list[str]:
    """SQL test of each rule of ``role``, in the order of its RULES, over the
    normalised profile columns computed in ``score_roles`` (one expression
    string per rule: parsed once by Spark)."""
    if role == "time":
        return [
            _in("n_name", TIME_EXACT_NAMES),
            f"({_in('n_std', TIME_STANDARD_NAMES)} OR endswith(n_std, '_time'))",
            "n_axis = 't'",
            "is_datetime",
            "contains(lower(units), ' since ')",
            "(contains(n_long, 'time') OR contains(n_long, 'date'))",
        ]
    if role == "latitude":
        return [
            _in("n_name", LATITUDE_EXACT_NAMES),
            "(contains(n_name, 'lat') AND NOT contains(n_name, 'lon'))",
            _in("n_std", LATITUDE_STANDARD_NAMES),
            _in("n_units", LATITUDE_UNITS),
            "n_axis = 'y'",
            "contains(n_long, 'latitude')",
            _within(LATITUDE_BOUNDS),
        ]
    if role == "longitude":
        return [
            _in("n_name", LONGITUDE_EXACT_NAMES),
            "contains(n_name, 'lon')",
            _in("n_std", LONGITUDE_STANDARD_NAMES),
            _in("n_units", LONGITUDE_UNITS),
            "n_axis = 'x'",
            "contains(n_long, 'longitude')",
            _within(LONGITUDE_BOUNDS),
        ]
    return [
        _in("n_name", VERTICAL_EXACT_NAMES),
        _any("contains", "n_name", VERTICAL_NAME_TOKENS),
        f"({_in('n_std', VERTICAL_STANDARD_NAMES)} OR {_any('endswith', 'n_std', VERTICAL_STANDARD_SUFFIXES)})",
        "n_axis = 'z'",
        _in("n_positive", ["up", "down"]),
        _in("n_units", PRESSURE_UNITS),
        _in("n_units", VERTICAL_LENGTH_UNITS),
        _any("contains", "n_long", VERTICAL_LONG_NAME_TOKENS),
    ]


def _role_terms(role: str) -> list[tuple[Column, Column]]:
    """(points, reason-or-NULL) per rule of ``role``."""
    out = []
    for cond, (points, reason) in zip(_conditions(role), RULES[role]):
        ok = f"coalesce({cond}, false)"
        text = reason.replace("'", "''")
        out.append((F.expr(f"CASE WHEN {ok} THEN {points} ELSE 0 END"), F.expr(f"CASE WHEN {ok} THEN '{text}' END")))
    return out


def _confidence(score: Column) -> Column:
    return (F.when(score >= HIGH_CONFIDENCE, "high").when(score >= MEDIUM_CONFIDENCE, "medium")
            .when(score >= MIN_ROLE_SCORE, "low").otherwise("none"))


def score_roles(profile: DataFrame) -> DataFrame:
    norm = profile.select(
        "*", normalize_text(F.col("column")).alias("n_name"), normalize_text(F.col("standard_name")).alias("n_std"),
        normalize_text(F.col("long_name")).alias("n_long"), normalize_text(F.col("units")).alias("n_units"),
        normalize_text(F.col("axis")).alias("n_axis"), normalize_text(F.col("positive")).alias("n_positive"))
    cols = []
    for role in ROLE_ORDER:
        terms = _role_terms(role)
        total = terms[0][0]
        for p, _ in terms[1:]:
            total = total + p
        cols += [total.alias(f"{role}_score"), F.array_compact(F.array(*[r for _, r in terms])).alias(f"{role}_reasons")]
    scored = norm.select(*profile.columns, *cols)
    # best role: highest score, ties to the earlier role in ROLE_ORDER
    scores = F.array(*[F.struct(F.col(f"{r}_score").alias("s"), F.lit(-i).alias("o"), F.lit(r).alias("role"))
                       for i, r in enumerate(ROLE_ORDER)])
    top = F.array_max(scores)
    best = scored.select("*", top.alias("__top"))
    reasons = F.col("time_reasons")
    for r in ROLE_ORDER[1:]:
        reasons = F.when(F.col("__top.role") == r, F.col(f"{r}_reasons")).otherwise(reasons)
    return best.select(
        *scored.columns,
        F.col("__top.s").alias("best_score"),
        F.when(F.col("__top.s") >= MIN_ROLE_SCORE, F.col("__top.role")).alias("best_role"),
        reasons.alias("best_reasons"),
        _confidence(F.col("__top.s")).alias("confidence"))


def assign_roles(scored: DataFrame) -> DataFrame:
    """(role, column): each role to at most one coordinate, in ROLE_ORDER,
    ranked by score, 1-D first, fewer dims, then name descending.

    The scored profile has one row per coordinate column, so the sequential
    choice runs over its rows on the driver."""
    rows = scored.select("column", "ndim", *[f"{r}_score" for r in ROLE_ORDER]).collect()
    taken: set[str] = set()
    picks = []
    for role in ROLE_ORDER:
        cands = [r for r in rows if r[f"{role}_score"] >= MIN_ROLE_SCORE and r["column"] not in taken]
        if not cands:
            continue
        best = max(cands, key=lambda r: (r[f"{role}_score"], r["ndim"] == 1, -r["ndim"], r["column"]))
        taken.add(best["column"])
        picks.append((role, best["column"]))
    return scored.sparkSession.createDataFrame(picks, "role string, column string")


def scored_profile(grid: GridTable) -> DataFrame:
    """Scores per coordinate, materialised once: the table has one row per
    coordinate column (schema-sized), so it is rebuilt as a local relation
    instead of re-deriving the expressions in every assignment step."""
    scored = score_roles(coordinate_profile(grid))
    return grid.df.sparkSession.createDataFrame(scored.collect(), scored.schema)


def column_roles(grid: GridTable) -> DataFrame:
    """Per coordinate: the four role scores, best role/score/confidence and
    the role it was selected for (NULL if none)."""
    scored = scored_profile(grid)
    picks = assign_roles(scored).withColumnRenamed("role", "selected_role")
    return scored.join(picks, "column", "left").select(
        "column", "time_score", "latitude_score", "longitude_score", "vertical_score",
        "best_role", "best_score", "confidence", "selected_role",
        F.array_join("best_reasons", "; ").alias("reasons"))


def detect_roles(grid: GridTable) -> dict[str, str | None]:
    """Role map ``{role: column}`` (four rows at most reach the driver)."""
    found = {r["role"]: r["column"] for r in assign_roles(scored_profile(grid)).collect()}
    return {role: found.get(role) for role in ROLE_ORDER}


def with_roles(grid: GridTable) -> GridTable:
    """The grid with detected roles, unless it has roles already."""
    return grid if grid.roles else replace(grid, roles=detect_roles(grid))


def coord_metadata(grid: GridTable) -> DataFrame:
    """Role details plus axis facts for every coordinate: size, first/last
    label in stored order, queryable, curvilinear, map candidate."""
    scored = scored_profile(grid)
    picks = assign_roles(scored).withColumnRenamed("role", "selected_role")
    coords = _coordinates(grid)
    wide = grid.df.agg(*[x for i, (n, _) in enumerate(coords) for x in (
        F.count_distinct(n).alias(f"n{i}"), F.min(n).cast("string").alias(f"{'e' if n in grid.descending else 's'}{i}"),
        F.max(n).cast("string").alias(f"{'s' if n in grid.descending else 'e'}{i}"))])
    facts = wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("size"), F.col(f"s{i}").alias("start"),
                 F.col(f"e{i}").alias("end")) for i, (n, _) in enumerate(coords)])).alias("f")).select("f.*")
    role = F.coalesce(F.col("best_role"), F.lit("dimension"))
    spatial = role.isin("latitude", "longitude")
    return (scored.join(picks, "column", "left").join(facts, "column", "left").select(
        "column", role.alias("role"), F.col("selected_role").isNotNull().alias("selected"), "selected_role",
        "confidence", F.col("best_score").alias("score"), F.array_join("best_reasons", "; ").alias("reasons"),
        "dtype", "size", "ndim", "dims", (F.col("ndim") == 1).alias("queryable"),
        (spatial & (F.col("ndim") > 1)).alias("curvilinear"),
        (spatial & F.col("ndim").isin(1, 2)).alias("map_candidate"),
        F.nullif(F.col("units"), F.lit("")).alias("units"),
        F.nullif(F.col("standard_name"), F.lit("")).alias("standard_name"),
        F.nullif(F.col("axis"), F.lit("")).alias("axis"), "start", "end"))


def enrich_schema(schema: DataFrame, metadata: DataFrame | None = None, roles: DataFrame | None = None) -> DataFrame:
    """Schema rows (``column`` + anything) with description, unit (``unit`` or
    ``units`` key) and role added.  ``metadata`` is ``(column, key, value)``;
    ``roles`` is ``(column, role)``."""
    out = schema
    if metadata is not None:
        m = metadata.groupBy("column").agg(
            F.max(F.when(F.col("key") == "description", F.col("value"))).alias("description"),
            F.coalesce(F.max(F.when(F.col("key") == "unit", F.col("value"))),
                       F.max(F.when(F.col("key") == "units", F.col("value")))).alias("unit"))
        out = out.join(m, "column", "left")
    if roles is not None:
        out = out.join(roles.select("column", "role"), "column", "left")
    return out


def table_metadata(spark: SparkSession, dataset: GridDataset) -> DataFrame:
    """Per (table, column): table description (long_name or name), dims,
    queryable coordinates, auxiliary coordinates, source mode/uris, column
    description and dtype.  Built from schemas and attrs only."""
    rows = []
    for name, grid in dataset.variables.items():
        desc = grid.attrs.get("long_name") or name
        # files behind the table: the opened URIs, else the scan's file list
        uris = ";".join(dataset.source_uris) or ";".join(sorted(grid.df.inputFiles()))
        for c in (*grid.dims, grid.value):
            cdesc = (grid.coord_attrs.get(c, {}).get("long_name") or f"{c} coordinate") if c != grid.value else desc
            rows.append((name, desc, ",".join(grid.dims), ",".join(grid.dims), ",".join(grid.aux),
                         dataset.source_mode, uris, c, cdesc, grid.dtype(c).simpleString()))
    return spark.createDataFrame(rows, "table string, description string, dims string, queryable string, "
                                       "auxiliary string, source_mode string, source_uris string, column string, "
                                       "column_description string, data_type string")
