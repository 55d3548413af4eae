"""Small expression builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# float64 machine epsilon, the absolute tolerance used when a target counts as
# zero, and the multiple of epsilon below which a fitted scale counts as zero.
FLOAT64_EPS = 2.220446049250313e-16
ZERO_ATOL = 1e-8
ZERO_SCALE_FACTOR = 10.0

# Plain decimal / scientific numbers, plus the words the numeric parser accepts for infinities
# and not-a-number. Spark's cast would also accept suffixes such as "1.0d"; this guard rejects them.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL = r"^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN is a missing value for the series semantics; SQL treats it as a number, so map it."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def numeric_or_null(c: str | Column) -> Column:
    """Parse a string column into DOUBLE; anything unparseable (or NaN) becomes NULL."""
    c = as_col(c)
    s = c.cast("string")
    ok = s.rlike(_NUMBER) | s.rlike(_SPECIAL)
    parsed = F.when(ok, F.trim(s).try_cast("double"))
    return nan_to_null(parsed)


def micros_between(start: str | Column, end: str | Column) -> Column:
    """Elapsed microseconds from ``start`` to ``end`` (TIMESTAMP_NTZ-safe, zone independent)."""
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end))


def ntz_from_micros(micros: str | Column) -> Column:
    """TIMESTAMP_NTZ that lies so many microseconds after 1970, whatever the session zone."""
    seconds = (as_col(micros) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def floor_ts(c: str | Column, duration: str) -> Column:
    """Tumbling bucket start, e.g. ``floor_ts("ts", "30 minutes")``; keeps TIMESTAMP_NTZ."""
    return F.window(as_col(c), duration).start


def safe_scale(c: str | Column) -> Column:
    """A zero (or numerically zero) scale is replaced by 1 so constant columns stay finite."""
    c = as_col(c)
    return F.when(c.isNull(), F.lit(None)).when(c < F.lit(ZERO_SCALE_FACTOR * FLOAT64_EPS), F.lit(1.0)).otherwise(c)
