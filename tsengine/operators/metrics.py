"""Accuracy metrics for any number of models in one aggregate pass, and model comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tsengine.functions.columns import FLOAT64_EPS, ZERO_ATOL, as_col
from tsengine.operators.clean import _keys

PREFERRED = ("mse", "rmse", "mae", "mape", "r2")


def _safe_truth(y: Column) -> Column:
    """Targets within 1e-8 of zero are replaced by float64 epsilon (for MAPE only)."""
    return F.when(F.abs(y) <= F.lit(ZERO_ATOL), F.lit(FLOAT64_EPS)).otherwise(y)


def _partials(name: str, y: Column, p: Column) -> list[Column]:
    err = y - p
    ys = _safe_truth(y)
    ape = F.abs(ys - p) / F.greatest(F.abs(ys), F.lit(FLOAT64_EPS))
    return [
        F.count(F.when(y.isNotNull() & p.isNotNull(), 1)).alias(f"{name}__n"),
        F.avg(err * err).alias(f"{name}__mse"),
        F.avg(F.abs(err)).alias(f"{name}__mae"),
        F.avg(ape).alias(f"{name}__ape"),
        F.sum(err * err).alias(f"{name}__ssr"),
        (F.var_pop(F.when(p.isNotNull(), y)) * F.count(F.when(p.isNotNull(), y))).alias(f"{name}__sst"),
    ]


def _r2(ssr: Column, sst: Column, n: Column) -> Column:
    return (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(sst == 0, F.when(ssr == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - ssr / sst)
    )


def forecast_metrics(
    df: DataFrame,
    preds: Mapping[str, str | Column] | Sequence[str],
    y: str | Column = "y_true",
    by: str | Sequence[str] = (),
    metrics: Sequence[str] = PREFERRED,
) -> DataFrame:
    """Long metric records ``(*by, model, metric, value)`` for every prediction column.

    All models are scored on the same rows: those where the truth and every prediction are there.
    The metric ``n`` is their number. One grouped aggregate computes all partial sums for all models
    (map-side combine), so the cost is one pass whatever the number of models. ``by=[]`` pools everything (a global
    aggregate), ``by=["series_id"]`` gives per-series metrics.
    """
    by = _keys(by)
    pmap = dict(preds) if isinstance(preds, Mapping) else {p: p for p in preds}
    yc = as_col(y).cast("double")
    df, aggs = _scored(df, pmap, yc)
    grouped = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return grouped.select(*by, F.inline(_records(pmap, metrics)))


def metrics_hierarchy(
    df: DataFrame,
    preds: Mapping[str, str | Column] | Sequence[str],
    levels: Sequence[Sequence[str]],
    y: str | Column = "y_true",
    metrics: Sequence[str] = PREFERRED,
) -> DataFrame:
    """:func:`forecast_metrics` at several levels of a hierarchy in one aggregate.

    ``levels`` are lists of grouping columns, such as ``[["region", "series_id"], ["region"], []]``;
    ``[]`` is the total. Output: all grouping columns (NULL where a level doesn't group by one),
    ``level`` (the place in ``levels``), ``model, metric, value``. Levels are GROUPING SETS: one scan and
    one shuffle of partial sums, also where a column itself holds NULLs (``level`` tells them apart).
    Repeated levels and an empty list of them are refused. No rows give no records but the total's.
    """
    levels = [_keys(level) for level in levels]
    if not levels or len({frozenset(level) for level in levels}) < len(levels):
        raise ValueError("levels must be a non-empty list of different groupings")
    by = list(dict.fromkeys(c for level in levels for c in level))
    pmap = dict(preds) if isinstance(preds, Mapping) else {p: p for p in preds}
    df, aggs = _scored(df, pmap, as_col(y).cast("double"))
    if not by:
        return df.agg(*aggs).select(F.lit(0).alias("level"), F.inline(_records(pmap, metrics)))
    # grouping_id has one bit per column, the first column's the highest; 1 = not grouped by
    bits = [sum((c not in level) << (len(by) - 1 - i) for i, c in enumerate(by)) for level in levels]
    number = F.element_at(F.create_map(*[F.lit(x) for i, b in enumerate(bits) for x in (b, i)]), F.col("__gid").cast("int"))
    grouped = df.groupingSets([[F.col(c) for c in level] for level in levels], *by).agg(F.grouping_id().alias("__gid"), *aggs)
    return grouped.select(*by, number.alias("level"), F.inline(_records(pmap, metrics)))


def _scored(df: DataFrame, pmap: Mapping[str, str | Column], yc: Column) -> tuple[DataFrame, list[Column]]:
    """The rows that all models share, and the partial sums of all models."""
    aggs, common = [], yc.isNotNull()
    for name, col in pmap.items():
        aggs += _partials(name, yc, as_col(col).cast("double"))
        common = common & as_col(col).isNotNull()
    return df.filter(common), aggs


def _records(pmap: Mapping[str, str | Column], metrics: Sequence[str]) -> Column:
    recs = []
    for name in pmap:
        c = lambda k: F.col(f"{name}__{k}")
        values = {
            "mse": c("mse"),
            "rmse": F.sqrt(c("mse")),
            "mae": c("mae"),
            "mape": c("ape") * F.lit(100.0),
            "r2": _r2(c("ssr"), c("sst"), c("n")),
            "n": c("n"),
        }
        for m in metrics:
            recs.append(F.struct(F.lit(name).alias("model"), F.lit(m).alias("metric"), values[m].cast("double").alias("value")))
    return F.array(*recs)


def compare_models(metrics: DataFrame, order: Sequence[str] = PREFERRED, extra: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Model x metric table with the preferred column order, then ``extra`` metrics."""
    cols = list(order) + [m for m in extra if m not in order]
    if not cols:
        raise ValueError("compare_models: no metrics requested")
    return metrics.groupBy(*by, "model").pivot("metric", cols).agg(F.first("value"))


def _odd_counts(cols: Sequence[str]) -> list[Column]:
    """Number of rows, and of NULL, NaN or infinite values in each column."""
    x = lambda c: F.col(c).cast("double")
    odd = lambda c: F.col(c).isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf"))
    return [F.count(F.lit(1)).alias("__n"), *[F.count(F.when(odd(c), 1)).alias(c) for c in cols]]


def _refuse_odd(seen: Mapping[str, int], cols: Sequence[str]) -> None:
    if not seen["__n"]:
        raise ValueError("No rows to score: the forecasts have nothing in common")
    if bad := {c: seen[c] for c in cols if seen[c]}:
        raise ValueError(f"Columns have missing or non-finite values after alignment: {bad}")


def completeness(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``*by, n`` and, for each column, how many of its values are NULL, NaN or infinite."""
    out = df.groupBy(*by).agg(*_odd_counts(cols)) if by else df.agg(*_odd_counts(cols))
    return out.withColumnRenamed("__n", "n")


def assert_complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raise when there are no rows, or a listed column has NULLs (which SQL aggregates would skip),
    NaN or infinite values (which would take over every average)."""
    _refuse_odd(df.agg(*_odd_counts(cols)).first().asDict(), cols)
    return df


def write_complete(df: DataFrame, cols: Sequence[str], write: Callable[[DataFrame], DataFrame], extra: Sequence[Column] = ()) -> tuple[DataFrame, dict]:
    """:func:`assert_complete` without a job of its own: the counts (and ``extra`` aggregates) are taken
    while ``write`` stores the frame. Returns what ``write`` returned, and the observed values."""
    seen = Observation()
    out = write(df.observe(seen, *_odd_counts(cols), *extra))
    _refuse_odd(seen.get, cols)
    return out, {k: v for k, v in seen.get.items() if k != "__n"} | {"n": seen.get["__n"]}
