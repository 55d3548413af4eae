"""Column-expression helpers (JVM-side, codegen friendly)."""

from tsengine.functions.columns import (
    FLOAT64_EPS,
    ZERO_ATOL,
    as_col,
    floor_ts,
    micros_between,
    nan_to_null,
    numeric_or_null,
    safe_scale,
)

__all__ = [
    "FLOAT64_EPS",
    "ZERO_ATOL",
    "as_col",
    "floor_ts",
    "micros_between",
    "nan_to_null",
    "numeric_or_null",
    "safe_scale",
]
