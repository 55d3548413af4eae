"""Chronological splits as a flag column on one DataFrame (never two copies of the data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.operators.clean import _keys


def split_index(n: Column, ratio: float, lo: Column | int = 1, hi: Column | None = None) -> Column:
    """``clamp(int(n * (1 - ratio)), lo, hi)`` with ``hi`` defaulting to ``n - 1`` (DOUBLE math)."""
    if not 0.0 < ratio < 1.0:
        raise ValueError("split ratio must be in the (0, 1) interval")
    keep = 1.0 - float(ratio)
    k = F.floor(n.cast("double") * F.lit(keep)).cast("bigint")
    lo_c = F.lit(lo) if isinstance(lo, int) else lo
    hi_c = (n - 1) if hi is None else hi
    return F.least(F.greatest(k, lo_c), hi_c)


def split_chrono(
    df: DataFrame,
    test_size: float = 0.2,
    validation_ratio: float | None = None,
    by="series_id",
    time_col: str = "ts",
    out: str = "split",
    cfg=None,
) -> DataFrame:
    """Add ``split``: first ``k`` rows of each series are train, the rest test.

    With ``validation_ratio`` the train rows are split again by the same rule into ``fit`` and
    ``val``. Position and series length come from one window spec (one Exchange + Sort); with a
    ``cfg`` whose layout is not "series", a series too large for one task gets range-partitioned
    positions instead (see :mod:`tsengine.plans.layout`).
    """
    by = _keys(by)
    if cfg is not None and len(by) == 1 and cfg.layout != "series":
        # layout-aware positions: range-partitioned for series too large for one task
        from tsengine.plans.layout import positions_and_counts

        staged = positions_and_counts(df, cfg.with_(series_col=by[0], time_col=time_col), pos="__pos", n="__n")
    else:
        w = Window.partitionBy(*by).orderBy(F.col(time_col))
        n = F.count(F.lit(1)).over(Window.partitionBy(*by))
        staged = df.withColumn("__pos", F.row_number().over(w) - 1).withColumn("__n", n)
    k = split_index(F.col("__n"), test_size)
    staged = staged.withColumn("__k", k)
    if validation_ratio is None:
        flag = F.when(F.col("__pos") < F.col("__k"), "train").otherwise("test")
    else:
        kf = split_index(F.col("__k"), validation_ratio)
        flag = F.when(F.col("__pos") >= F.col("__k"), "test").when(F.col("__pos") < kf, "fit").otherwise("val")
    return staged.withColumn(out, flag).drop("__pos", "__n", "__k")
