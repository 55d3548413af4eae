"""Aligning two forecasts, truth-gap audit, blend-weight tuning and blending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.operators.clean import _keys


def align_forecasts(
    a: DataFrame,
    b: DataFrame,
    series_col: str = "series_id",
    time_col: str = "ts",
    fallback: str | None = "tail",
    cfg=None,
) -> DataFrame:
    """Inner equi-join of two prediction frames on (series, ts).

    ``a`` and ``b`` carry disjoint value columns (e.g. ``y_true_a, pred_a`` / ``y_true_b,
    pred_b, low, high``). For a series with no common timestamp and ``fallback="tail"``, the
    last ``m = min(len_a, len_b)`` rows of both sides are paired by rank from the end, with the
    timestamps of ``a``. Rows of other series are never paired by rank.
    """
    keys = [series_col, time_col]
    matched = a.join(b, on=keys, how="inner")
    if fallback is None:
        return matched
    if fallback != "tail":
        raise ValueError("fallback must be None or 'tail'")
    # one row per series that has any common stamp: AQE broadcasts it at run time when small, so
    # the anti-joins below do not shuffle the inputs, and the inputs' own exchanges are reused
    hit = matched.select(series_col).distinct()
    a_rest = _rank_from_end(a.join(hit, series_col, "left_anti"), series_col, time_col, cfg)
    b_rest = _rank_from_end(b.join(hit, series_col, "left_anti"), series_col, time_col, cfg).drop(time_col)
    paired = a_rest.join(b_rest, on=[series_col, "__rk"], how="inner").drop("__rk")
    return matched.unionByName(paired.select(*matched.columns))


def _rank_from_end(df: DataFrame, series_col: str, time_col: str, cfg) -> DataFrame:
    """1 for the last row of each series, 2 for the one before, ...; with a blocks-layout ``cfg``
    the rank comes from range-partitioned positions (``n - pos``), so a huge series is never one
    window partition, and the following join on (series, rank) spreads evenly."""
    if cfg is not None and cfg.layout != "series":
        from tsengine.plans.layout import positions_and_counts

        staged = positions_and_counts(df, cfg.with_(series_col=series_col, time_col=time_col), pos="__pos", n="__n")
        return staged.withColumn("__rk", F.col("__n") - F.col("__pos")).drop("__pos", "__n")
    w = Window.partitionBy(series_col).orderBy(F.col(time_col).desc())
    return df.withColumn("__rk", F.row_number().over(w).cast("bigint"))


def truth_gap(df: DataFrame, a: str = "y_true_a", b: str = "y_true_b", by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute difference between two ground-truth columns (``> 1e-6`` deserves a look)."""
    gap = F.avg(F.abs(F.col(a) - F.col(b))).alias("truth_gap")
    n = F.count(F.lit(1)).alias("n")
    return df.groupBy(*by).agg(gap, n) if by else df.agg(gap, n)


def blend(df: DataFrame, w: float | str | Column, a: str = "pred_a", b: str = "pred_b", out: str = "hybrid_pred") -> DataFrame:
    """``w * a + (1 - w) * b``. A float weight is clipped to [0, 1]; a column weight is used as is."""
    if isinstance(w, (int, float)):
        wc = F.lit(min(max(float(w), 0.0), 1.0))
    else:
        wc = F.col(w) if isinstance(w, str) else w
    return df.withColumn(out, wc * F.col(a) + (F.lit(1.0) - wc) * F.col(b))


def weight_grid(points: int = 101) -> list[float]:
    """``points`` evenly spaced weights from 0 to 1 (at least 3); the last one is exactly 1."""
    points = max(3, int(points))
    step = 1.0 / (points - 1)
    return [i * step for i in range(points - 1)] + [1.0]


def tune_blend(
    df: DataFrame,
    y: str = "y_true",
    a: str = "pred_a",
    b: str = "pred_b",
    points: int = 101,
    by: Sequence[str] = (),
) -> DataFrame:
    """Weight on ``a`` minimising the blend RMSE over a grid; ties go to the smallest weight.

    One aggregate pass collects three sufficient statistics (with ``e = y - b`` and
    ``d = a - b``: mean e^2, mean e*d, mean d^2); the RMSE at a grid weight is then
    ``sqrt(E[e^2] - 2 w E[e d] + w^2 E[d^2])``. Being convex in ``w``, its grid minimum is one of
    the grid points around ``E[e d] / E[d^2]``, so a handful of candidates per group are scored
    instead of the whole grid: the same weight as a full scan, at any number of groups.
    Output: ``(*by, weight, rmse)``; with no rows the weight is 0.5 and rmse NULL.
    """
    by = list(by)
    df = df.filter(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())  # one set of rows for all three means
    e = F.col(y) - F.col(b)
    d = F.col(a) - F.col(b)
    stats = [F.avg(e * e).alias("__ee"), F.avg(e * d).alias("__ed"), F.avg(d * d).alias("__dd")]
    agg = df.groupBy(*by).agg(*stats) if by else df.agg(*stats)
    n_points = max(3, int(points))
    step = 1.0 / (n_points - 1)
    last = n_points - 1
    # mse(w) is a convex quadratic, so the grid minimum sits next to the continuous minimiser
    # w* = E[e d] / E[d^2] (clipped to [0, 1]); only its grid neighbours and both ends are scored
    w_star = F.when(F.col("__dd") > 0, F.least(F.greatest(F.col("__ed") / F.col("__dd"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    i_mid = F.floor(w_star * F.lit(float(last))).cast("int")
    cands = F.array_distinct(
        F.array(*[F.least(F.greatest(i_mid + k, F.lit(0)), F.lit(last)) for k in (-1, 0, 1, 2)], F.lit(0), F.lit(last))
    )
    rows = agg.select(*by, "__ee", "__ed", "__dd", F.explode(cands).alias("__i"))
    weight = F.when(F.col("__i") == last, F.lit(1.0)).otherwise(F.col("__i").cast("double") * F.lit(step))
    rows = rows.withColumn("weight", weight)
    mse = F.col("__ee") - F.lit(2.0) * F.col("weight") * F.col("__ed") + F.col("weight") * F.col("weight") * F.col("__dd")
    # greatest() skips NULLs, so keep "no rows" (NULL statistics) NULL explicitly
    rows = rows.withColumn("rmse", F.when(F.col("__ee").isNotNull(), F.sqrt(F.greatest(mse, F.lit(0.0)))))
    best = F.min(F.struct(F.col("rmse"), F.col("weight"))).alias("__best")
    scored = rows.filter(F.col("rmse").isNotNull())
    picked = scored.groupBy(*by).agg(best) if by else scored.agg(best)
    return picked.select(*by, F.coalesce(F.col("__best.weight"), F.lit(0.5)).alias("weight"), F.col("__best.rmse").alias("rmse"))


def blend_tuned(df: DataFrame, weights: DataFrame, a: str = "pred_a", b: str = "pred_b", out: str = "hybrid_pred", by: Sequence[str] = ()) -> DataFrame:
    """Blend with weights from :func:`tune_blend` (``tune_on`` and the scored frame may differ)."""
    by = list(by)
    if not by:
        # one pooled weight: a single scalar is read on the driver and inlined as a literal
        row = weights.select("weight").limit(2).collect()
        if len(row) != 1:
            raise ValueError("blend_tuned: expected exactly one pooled weight")
        return blend(df, F.lit(float(row[0]["weight"])), a, b, out)
    w = weights.select(*by, F.col("weight").alias("__w"))
    return blend(df.join(w, on=by, how="left"), "__w", a, b, out).drop("__w")
