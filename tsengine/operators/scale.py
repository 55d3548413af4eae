"""Scalers fitted on train rows only, stored as a small parameter DataFrame.

Parameters are one aggregate pass over all columns, kept long as ``(series_id, column, center,
scale)``. Applying them is a join on the series key; AQE turns it into a broadcast join when
the measured parameter table is small and otherwise keeps a sort-merge join whose skewed
partitions it splits (each series has one parameter row, so a hot series never multiplies).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.functions.columns import safe_scale
from tsengine.operators.clean import _keys


def _finite(x, column: str):
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, F.raise_error(F.lit(f"Column {column!r} holds NaN or infinite values; no scaler fits")).cast("double")).otherwise(x)


def fit_scaler(
    df: DataFrame,
    cols: Sequence[str],
    kind: str = "standard",
    by="series_id",
    where: str | None = "split = 'train'",
) -> DataFrame:
    """``standard``: center = mean, scale = population std; anything else: center = min, scale = range.

    A zero scale becomes 1 (constant columns stay finite). NaN and infinite values are refused when
    the parameters are computed. Pass ``by=[]`` for one global scaler.
    """
    by = _keys(by)
    src = df.filter(where) if where else df
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        if kind == "standard":
            aggs += [F.avg(x).alias(f"c{i}"), F.stddev_pop(x).alias(f"s{i}")]
        else:
            aggs += [F.min(x).alias(f"c{i}"), (F.max(x) - F.min(x)).alias(f"s{i}")]
    wide = src.groupBy(*by).agg(*aggs)
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), _finite(F.col(f"c{i}"), c).alias("center"), _finite(safe_scale(F.col(f"s{i}")), c).alias("scale")) for i, c in enumerate(cols)]
    )
    return wide.select(*by, F.inline(entries))


def _wide_params(params: DataFrame, cols: Sequence[str], by: list[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        hit = F.col("column") == F.lit(c)
        aggs += [F.max(F.when(hit, F.col("center"))).alias(f"__c{i}"), F.max(F.when(hit, F.col("scale"))).alias(f"__s{i}")]
    if by:
        return params.groupBy(*by).agg(*aggs)
    return params.agg(*aggs)


def _apply(df: DataFrame, params: DataFrame, cols: Sequence[str], by, inverse: bool, suffix: str, param_cols=None) -> DataFrame:
    by = _keys(by)
    param_of = dict(zip(cols, param_cols)) if param_cols is not None else {c: c for c in cols}
    fitted = list(dict.fromkeys(param_of.values()))
    wide = _wide_params(params, fitted, by)
    if by:
        joined = df.join(wide, on=by, how="left")
    else:
        # one global parameter row (2 values per column): inline it as literals
        rows = wide.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("global scaler parameters must be exactly one row")
        joined = df.select("*", *[F.lit(v).cast("double").alias(k) for k, v in rows[0].asDict().items()])
    idx = {c: fitted.index(p) for c, p in param_of.items()}
    exprs = []
    for c in df.columns:
        if c in idx and not suffix:
            exprs.append(_formula(c, idx[c], inverse).alias(c))
        else:
            exprs.append(F.col(c))
    if suffix:
        exprs += [_formula(c, i, inverse).alias(f"{c}{suffix}") for c, i in idx.items()]
    return joined.select(*exprs)


def _formula(c: str, i: int, inverse: bool):
    x, center, scale = F.col(c).cast("double"), F.col(f"__c{i}"), F.col(f"__s{i}")
    return x * scale + center if inverse else (x - center) / scale


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str], by="series_id", suffix: str = "", param_cols: Sequence[str] | None = None) -> DataFrame:
    """(x - center) / scale for every listed column (in place, or into ``{col}{suffix}``)."""
    return _apply(df, params, cols, by, inverse=False, suffix=suffix, param_cols=param_cols)


def invert_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str], by="series_id", suffix: str = "", param_cols: Sequence[str] | None = None) -> DataFrame:
    """x * scale + center; ``param_cols`` names the fitted column whose parameters each column uses."""
    return _apply(df, params, cols, by, inverse=True, suffix=suffix, param_cols=param_cols)
