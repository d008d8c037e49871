"""Scalar column expressions shared by the operators (all built-in Spark
functions, so they stay inside whole-stage codegen)."""

from gridcells.functions.scalar import (  # noqa: F401
    RESAMPLE_RULES,
    bin_start,
    is_finite,
    month_of,
    nan_to_null,
    normalize_text,
    safe_ratio,
    stable_round,
    to_numeric,
    typed_literal,
)
