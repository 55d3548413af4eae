"""Aligning two frames whose stamps differ: each row meets the nearest earlier row of the other side.

Both sides are put into one frame and the other side's last row is carried along in time order: one
Exchange and one Sort instead of a range join. A series too large for one task is cut into contiguous
(series, time) blocks; the last row before each block comes from one aggregate per block.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.functions.columns import micros_between
from tsengine.plans.layout import BLOCK, range_checkpoint, resolve_layout
from tsengine.sources.files import require_columns


def align_asof(
    a: DataFrame,
    b: DataFrame,
    tolerance: timedelta | None = None,
    series_col: str = "series_id",
    time_col: str = "ts",
    matched: str = "ts_b",
    how: str = "left",
    cfg: ForecastConfig | None = None,
) -> DataFrame:
    """Every row of ``a`` with the last row of ``b`` of its series at or before its stamp.

    A match older than ``tolerance`` doesn't count. Output: the columns of ``a``, the other columns of
    ``b``, and ``matched``, the stamp of the row of ``b``; without a match they are NULL (``how="left"``)
    or the row is left out (``"inner"``). Rows of ``a`` may repeat; of several rows of ``b`` with one
    stamp the greatest counts. Rows without a series or a stamp match nothing. With a ``cfg`` the layout
    is as in the other ordered operators ("blocks" for a series too large for one task).
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    s, t = series_col, time_col
    require_columns(a, [s, t])
    require_columns(b, [s, t])
    values = [c for c in b.columns if c not in (s, t)]
    if clash := {c.lower() for c in [*values, matched]} & {c.lower() for c in a.columns}:
        raise ValueError(f"Columns on both sides: {sorted(clash)}")
    mine = [c for c in a.columns if c not in (s, t)]
    row_a = F.struct(F.lit(True).alias("__is"), *mine)
    row_b = F.struct(F.col(t).alias(matched), *values)
    left = a.select(s, t, F.lit(1).alias("__side"), row_a.alias("__a"))
    right = b.filter(F.col(s).isNotNull() & F.col(t).isNotNull()).select(s, t, F.lit(0).alias("__side"), row_b.alias("__b"))
    both = left.unionByName(right, allowMissingColumns=True)
    blocks = cfg is not None and resolve_layout(both, cfg.with_(series_col=s, time_col=t)).layout == "blocks"
    keys, seen = [s], F.lit(None)
    if blocks:
        both = range_checkpoint(both, s, t, sort=False)
        last = both.filter("__side = 0").groupBy(F.col(s).alias("__s"), F.col(BLOCK).alias("__k")).agg(F.max(F.struct(t, "__b")).alias("__last"))
        # one row per series and block: those of blocks without b are needed too
        spans = both.groupBy(F.col(s).alias("__s"), F.col(BLOCK).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).drop("__n").join(last, ["__s", "__k"], "left")
        before = Window.partitionBy("__s").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
        carried = spans.select("__s", "__k", F.last("__last", ignorenulls=True).over(before)["__b"].alias("__carried"))
        both = both.join(carried, F.col(s).eqNullSafe(F.col("__s")) & (F.col(BLOCK) == F.col("__k")), "left")
        keys, seen = [s, BLOCK], F.col("__carried")
    running = Window.partitionBy(*keys).orderBy(t, "__side", "__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.coalesce(F.last("__b", ignorenulls=True).over(running), seen)
    out = both.select(s, t, "__a", found.alias("__m")).filter(F.col("__a").isNotNull())
    near = F.col("__m").isNotNull() & F.col(s).isNotNull() & F.col(t).isNotNull()
    if tolerance is not None:
        limit = int(tolerance / timedelta(microseconds=1))
        near = near & (micros_between(F.col(f"__m.{matched}"), F.col(t)) <= F.lit(limit))
    if how == "inner":
        out = out.filter(near)
    kept = [F.col(c) if c in (s, t) else F.col(f"__a.{c}").alias(c) for c in a.columns]
    return out.select(*kept, *[F.when(near, F.col(f"__m.{c}")).alias(c) for c in [*values, matched]])
