"""SELECT-only SQL over the grid variables.

While a query is analysed every variable is a temp view; the query is checked (SELECT/WITH prefix, it must parse as a
subquery, which a ``WITH ... INSERT`` cannot, and its analysed plan holds no other relations and no JVM calls), then the
user's own query runs on Spark SQL over the full data.  Reading files by path inside SQL is switched off while it runs.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession

from gridcells.model import GridDataset, GridTable

# Expressions that call arbitrary JVM methods (whatever the function is called in the text); no query over grids needs them.
_JVM_CALLS = {"CallMethodViaReflection", "TryReflect"}
# Leaves of an analysed plan that hold no stored data: literal rows, ranges and references to the query's own WITH tables.
_OWN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "ResolvedInlineTable"}


class RejectedQuery(ValueError):
    """The query is not a plain SELECT over the given tables."""


@contextmanager
def _session_conf(spark: SparkSession, **conf: str):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def _views(spark: SparkSession, frames: dict[str, DataFrame]):
    """The frames as temp views; afterwards they are gone and views of the same names are back."""
    before = {}
    for name in frames:
        if any(t.name == name.lower() and t.isTemporary for t in spark.catalog.listTables(pattern=name)):
            before[name] = spark.table(f"`{name}`")
    try:
        for name, df in frames.items():
            df.createOrReplaceTempView(f"`{name}`" if not name.isidentifier() else name)
        yield
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(plan, tables: set[str] | None) -> Iterable[str]:
    """What the analysed plan may not hold: JVM calls, and relations that are not among ``tables`` (None: any).

    WITH tables, subqueries and functions are resolved by then, so names and spelling do not matter.  The walk ends at the given
    tables' views, whose plans are the caller's own."""
    stack = [plan]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View":
            name = node.desc().identifier()
            if tables is not None and not (node.isTempView() and name.database().isEmpty() and name.table().lower() in tables):
                yield f"relation {name.unquotedString()}"
            continue
        expressions = _items(node.expressions())
        while expressions:
            e = expressions.pop()
            if e.getClass().getSimpleName() in _JVM_CALLS:
                yield f"JVM call {e.prettyName()}"
            expressions += _items(e.children())
        children = _items(node.children()) + _items(node.subqueries())
        if not children and tables is not None and kind not in _OWN_LEAVES:
            yield f"relation {node.simpleString(3)}"
        stack += children


def sql_guard(spark: SparkSession, query: str, tables: Iterable[str] | None = None) -> str:
    """The query's text, if it is one SELECT (or WITH) that reads only ``tables`` (None: any) and calls no
    JVM methods; else ``RejectedQuery``.  It is analysed, not run."""
    text = (query or "").strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    if not text:
        raise RejectedQuery("the query is empty")
    if not text.lower().startswith(("select", "with")):
        raise RejectedQuery(f"a query begins with SELECT or WITH, not {text.split()[0]!r}")
    state = spark._jsparkSession.sessionState()
    try:
        state.sqlParser().parsePlan(text)
        plan = state.sqlParser().parsePlan(f"SELECT * FROM ({text}\n) AS __checked")
    except Exception as e:
        raise RejectedQuery(f"the query is not one SELECT: {e}") from None
    found = list(dict.fromkeys(_walk(state.analyzer().execute(plan), None if tables is None else {t.lower() for t in tables})))
    if found:
        raise RejectedQuery(f"the query holds what it may not: {found}")
    return text


def sql_execute(spark: SparkSession, tables: GridDataset | dict[str, DataFrame], query: str,
                max_rows: int = 0, double_quoted_identifiers: bool = True,
                preview_rows: int | None = None) -> DataFrame:
    """Run a checked SELECT over the variables.  ``max_rows`` caps the result with
    ``limit`` (which keeps the query's own ORDER BY); 0 returns all.  ``preview_rows=n``
    lets the query read each grid's leading-rectangle preview, in stored order, instead of the full
    table.  The session's own views are as before afterwards."""
    from gridcells.operators.preview import canonical_order, preview

    views = tables.variables if isinstance(tables, GridDataset) else tables
    frames = {}
    for name, obj in views.items():
        if isinstance(obj, GridTable):
            frames[name] = canonical_order(obj.with_df(preview(obj, preview_rows))) if preview_rows else obj.df
        else:
            frames[name] = obj
    conf = {"spark.sql.runSQLOnFiles": "false",
            "spark.sql.ansi.doubleQuotedIdentifiers": "true" if double_quoted_identifiers else "false"}
    if double_quoted_identifiers:
        # "x" as an identifier is only honoured in ANSI mode (Spark's default)
        conf["spark.sql.ansi.enabled"] = "true"
    with _views(spark, frames), _session_conf(spark, **conf):
        text = sql_guard(spark, query, frames)
        df = spark.sql(text)
        # the plan is analysed now; later execution does not reread the conf or the views
        df.schema  # noqa: B018
    return df.limit(max_rows) if max_rows and max_rows > 0 else df


def example_queries(name: str, grid: GridTable) -> dict[str, str]:
    """The four canned queries: head, count/min/max, mean per first dim,
    two-dim listing."""
    # The texts of the canned queries.
    v = grid.value
    dims = list(grid.dims)
    out = {
        "sql_head": f'SELECT * FROM "{name}" LIMIT 12',
        "sql_minmax": f'SELECT COUNT(*) AS row_count, MIN("{v}") AS min_value, MAX("{v}") AS max_value FROM "{name}"',
    }
    if dims:
        out["sql_dim_mean"] = (f'SELECT "{dims[0]}", AVG("{v}") AS mean_value FROM "{name}" '
                               f'GROUP BY "{dims[0]}" ORDER BY "{dims[0]}" LIMIT 24')
    if len(dims) >= 2:
        out["sql_two_dim"] = (f'SELECT "{dims[0]}", "{dims[1]}", "{v}" FROM "{name}" '
                              f'ORDER BY "{dims[0]}", "{dims[1]}" LIMIT 24')
    return out
