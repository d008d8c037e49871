"""Scalar expressions."""

from __future__ import annotations

import datetime as _dt
import decimal as _dec
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The resampling rules the reference accepts, month start,
# quarters starting in December (Dec-Feb, Mar-May, Jun-Aug, Sep-Nov), year start.
RESAMPLE_RULES = ("MS", "QS-DEC", "YS")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """Missing floats are NaN in the array model; Spark aggregates treat NaN as
    a value, so it becomes NULL once at ingest."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def stable_round(c: Column | str, digits: int = 4) -> Column:
    """Round half-up with the tie point moved off exact decimal halves.

    Values computed in a different summation order differ in the last binary
    digit; a plain ``round`` then splits exact ties differently.  Shifting the
    tie point by 1.3e-4 of a unit makes the result identical across engines.
    """
    scale = float(10 ** digits)
    return (F.floor(_c(c) * F.lit(scale) + F.lit(0.50013)) / F.lit(scale)).cast("double")


def month_of(t: Column | str) -> Column:
    return F.month(_c(t))


# Months per bin and months by which its start precedes a multiple of them.
_BIN_MONTHS = {"MS": (1, 0), "QS-DEC": (3, 1), "YS": (12, 0)}


def _bin(rule: str) -> tuple[int, int]:
    if rule not in _BIN_MONTHS:
        raise ValueError(f"Unknown resample rule {rule!r}; expected one of {RESAMPLE_RULES}")
    return _BIN_MONTHS[rule]


def bin_number(t: Column | str, rule: str) -> Column:
    """The bin containing ``t`` as the number of its first month (since year 0): integer arithmetic on
    the calendar fields, so it is cheap to group by and does not depend on the session zone."""
    d = F.to_date(_c(t))
    return bin_of_month(F.year(d) * 12 + F.month(d) - 1, rule)


def bin_of_month(number: Column | str, rule: str) -> Column:
    """The bin of a month, both as numbers of months since year 0."""
    step, early = _bin(rule)
    month = _c(number) + early
    return month - F.pmod(month, F.lit(step)) - early


def bin_label(number: Column | str, rule: str) -> Column:
    """Label of a numbered bin (bin start), as timestamp_ntz."""
    n = _c(number)
    month = F.pmod(n, F.lit(12))
    return F.make_date(((n - month) / 12).cast("int"), month + 1, F.lit(1)).cast("timestamp_ntz")


def bin_start(t: Column | str, rule: str) -> Column:
    """Label of the resample bin containing ``t``."""
    return bin_label(bin_number(t, rule), rule)


def bin_step_months(rule: str) -> int:
    return _bin(rule)[0]


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b with a zero denominator giving NULL (ANSI division would raise)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def normalize_text(c: Column | str) -> Column:
    """lower + trim, separators to '_', collapse runs, strip '_'."""
    return F.trim(F.regexp_replace(F.lower(F.trim(_c(c))), r"[ \-/.(),_]+", "_"), F.lit("_"))


def is_finite(c: Column | str) -> Column:
    c = _c(c).cast("double")
    return (~F.isnan(c)) & (F.abs(c) < F.lit(float("inf")))


def to_numeric(c: Column | str) -> Column:
    """Coerce to double; unparseable text becomes NULL."""
    return _c(c).try_cast("double")


def _instant_text(value: Any) -> str:
    text = str(value).strip().replace("T", " ")
    return text + {4: "-01-01", 7: "-01"}.get(len(text), "")


def typed_literal(value: Any, dtype: T.DataType) -> Column:
    """Literal cast to the column's type, so the column itself is never wrapped
    and the predicate still reaches the Parquet scan.  Date strings are
    instants: "2013-01" means 2013-01-01T00:00.

    Datetime literals are passed as ISO text and cast by Spark: a Python
    ``datetime`` would be converted with the Python process's zone, which
    need not be the session's, and shift a ``timestamp_ntz`` bound."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        if isinstance(value, (_dt.datetime, _dt.date)):
            text = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
        else:
            text = _instant_text(value)
        return F.lit(text).cast(dtype.simpleString())
    return F.lit(value).cast(dtype.simpleString())


_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_EXACT = _dec.Context(prec=400)


def _limits(dtype: T.DataType) -> tuple[int, _dec.Decimal, _dec.Decimal] | None:
    """(scale, least, greatest) of the types that hold exact numbers."""
    bits = _BITS.get(type(dtype))
    if bits:
        return 0, _dec.Decimal(-(1 << bits - 1)), _dec.Decimal((1 << bits - 1) - 1)
    if isinstance(dtype, T.DecimalType):
        top = _dec.Decimal(10 ** dtype.precision - 1).scaleb(-dtype.scale, _EXACT)
        return dtype.scale, -top, top
    return None


def label_number(value: Any) -> _dec.Decimal:
    try:
        return _dec.Decimal(int(value)) if isinstance(value, bool) else _dec.Decimal(str(value).strip())
    except _dec.InvalidOperation:
        raise ValueError(f"label {value!r} is not a number") from None


def _day(value: Any) -> tuple[str, bool]:
    """(day, whether the label is the day's first instant)."""
    if isinstance(value, _dt.datetime) or not isinstance(value, _dt.date):
        text = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else _instant_text(value)
        day, _, rest = text.partition(" ")
        return day, not rest.strip("0:.")
    return value.isoformat(), True


def label_text(value: Any, dtype: T.DataType) -> str | None:
    """Text that casts to exactly this label in ``dtype``; None if the type cannot hold it (1.5 on
    an integer axis), so that no label equals it."""
    limits = _limits(dtype)
    if limits:
        x = label_number(value)
        if not x.is_finite() or not limits[1] <= x <= limits[2]:
            return None
        q = x.quantize(_dec.Decimal(1).scaleb(-limits[0]), _dec.ROUND_FLOOR, _EXACT)
        return f"{q:f}" if q == x else None
    if isinstance(dtype, T.DateType):
        day, whole = _day(value)
        return day if whole else None
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        if isinstance(value, _dt.date):
            return value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
        return _instant_text(value)
    return str(value).lower() if isinstance(value, bool) else str(value)


def label_bound(column: str, dtype: T.DataType, value: Any, lower: bool) -> Column:
    """``column >= value`` (``lower``) or ``column <= value`` with a literal of the column's own type:
    a bound between two values of an exact type moves to the next one inside."""
    c, limits = F.col(column), _limits(dtype)
    if limits:
        x = label_number(value)
        scale, least, greatest = limits
        if x.is_nan():
            return F.lit(False)
        if x > greatest or x < least:
            return c.isNotNull() if (x < least) == lower else F.lit(False)
        q = x.quantize(_dec.Decimal(1).scaleb(-scale), _dec.ROUND_CEILING if lower else _dec.ROUND_FLOOR, _EXACT)
    literal = F.lit(f"{q:f}").cast(dtype.simpleString()) if limits else _bound_literal(value, dtype, lower)
    return c >= literal if lower else c <= literal


def _bound_literal(value: Any, dtype: T.DataType, lower: bool) -> Column:
    if isinstance(dtype, T.DateType):
        day, whole = _day(value)
        literal = F.lit(day).cast("date")
        return literal if whole or not lower else F.date_add(literal, 1)
    return typed_literal(value, dtype)


def label_range(column: str, dtype: T.DataType, a: Any, b: Any) -> Column:
    """Between two labels in either order; which is the lower one is decided in the column's type."""
    if _limits(dtype):
        lo, hi = sorted((a, b), key=label_number)
        return label_bound(column, dtype, lo, True) & label_bound(column, dtype, hi, False)
    low, high = ([_bound_literal(x, dtype, side) for x in (a, b)] for side in (True, False))
    return F.col(column).between(F.least(*low), F.greatest(*high))


def format_scalar(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Report text of a value: NULL -> "n/a", floating numbers with 4
    decimals, datetimes in ISO form (fraction only when non-zero), anything
    else as its text."""
    c = _c(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        text = F.format_string("%.4f", c.cast("double"))
    elif isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        text = F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(
            F.concat(whole, F.lit("."), F.date_format(c, "SSSSSS")))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("n/a")).otherwise(text)


def format_number(c: Column | str) -> Column:
    c = _c(c).cast("double")
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.format_string("%.4f", c))
