"""Row guard: fail before anything is materialised."""

from __future__ import annotations

from pyspark.sql import DataFrame


class RowLimitExceeded(ValueError):
    pass


def row_guard(df: DataFrame, max_rows: int) -> DataFrame:
    """Raise if ``df`` has more than ``max_rows`` rows (0 = no guard): one
    distributed count, of which a number a task reaches the driver."""
    if max_rows and max_rows > 0:
        n = df.count()
        if n > max_rows:
            raise RowLimitExceeded(f"the selection has {n} rows and the limit is {max_rows}")
    return df
