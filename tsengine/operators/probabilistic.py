"""Sampled forecast paths per window and median / interval bands.

A pretrained sequence model is not part of this engine; paths come from samplers expressed as
array expressions on the window rows (no shuffle, no Python):

* ``analog``: path j repeats the season that ended j seasons before the forecast origin:
  ``y[j, h] = ctx[L - j*S + (h mod S)]`` for ``j = 1..min(num_samples, L div S)``.
* ``bootstrap``: the seasonal-naive path plus seasonal residuals ``ctx[t] - ctx[t - S]`` drawn
  by integer arithmetic on (series, window, sample, step, seed): deterministic, independent of how
  the rows are partitioned, and repeatable in any SQL.
* ``model``: a scorer that has to be loaded, such as a network with its weights. ``factory()`` loads it,
  once per Python worker and not per batch or task, and returns ``fn(contexts, lengths)``: contexts are a
  batch x context_length array, padded with NaN on the left, and the result is a batch x samples x
  horizon array; samples that are all NaN are left out.
* ``plugin``: any user scorer ``fn(contexts, horizon, num_samples, seed)`` run with ``mapInPandas``
  on Arrow batches, ``batch_size`` contexts per call. It returns one array (samples x horizon) for
  each context; the numbers of samples may differ, and 0 rows mean none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.config import ForecastConfig
from tsengine.functions.columns import nan_to_null
from tsengine.operators.windows import truncate_context, window_keys

SAMPLES = T.ArrayType(T.ArrayType(T.DoubleType()))


DRAW_MODULUS = 2_147_483_647


def draw_number(key, window, sample, step, seed: int):
    """A number below DRAW_MODULUS for each draw; all products stay below 2**63."""
    m = F.lit(DRAW_MODULUS).cast("long")
    mixed = F.pmod(key + window.cast("long") * 7919 + sample * 104_729 + step * 1_299_709 + F.lit(seed).cast("long") * 15_485_863, m)
    squared = F.pmod(mixed * mixed + 12_345, m)
    turned = F.pmod(squared * 48_271, m)
    return F.pmod(turned * turned + mixed, m)


def _check(num_samples: int, confidence: float | None = None) -> None:
    if num_samples <= 0:
        raise ValueError("num_samples must be > 0")
    if confidence is not None and not 0.0 < confidence < 1.0:
        raise ValueError("confidence must be in the (0, 1) interval")


def sample_paths(
    windows: DataFrame,
    cfg: ForecastConfig = ForecastConfig(),
    method: str | None = None,
    num_samples: int | None = None,
    season_length: int | None = None,
    seed: int | None = None,
    fn: Callable | None = None,
    batch_size: int = 16,
    factory: Callable | None = None,
) -> DataFrame:
    """Add ``samples ARRAY<ARRAY<DOUBLE>>`` (sample x step) to every window row."""
    method = method or cfg.sampler
    J = int(cfg.num_samples if num_samples is None else num_samples)
    S = int(cfg.season_length if season_length is None else season_length)
    seed = cfg.seed if seed is None else int(seed)
    H = cfg.prediction_length
    _check(J)
    if S < 1:
        raise ValueError("season_length must be >= 1")
    if method in ("analog", "bootstrap") and cfg.context_length < S + (method == "bootstrap"):
        raise ValueError(f"context_length {cfg.context_length} holds no season of {S} rows to sample from")
    df = truncate_context(windows, cfg.context_length)
    if "horizon" in df.columns:
        steps = F.size("horizon")
    else:
        steps = F.lit(H)
    ctx = F.col("ctx")
    L = F.size(ctx)
    if method == "analog":
        n_paths = F.least(F.lit(J), F.floor(L / F.lit(S)).cast("int"))
        paths = F.transform(
            F.sequence(F.lit(1), n_paths),
            lambda j: F.transform(F.sequence(F.lit(0), steps - 1), lambda h: F.get(ctx, L - j * S + h % S)),
        )
        return df.withColumn("samples", F.when(n_paths >= 1, paths).otherwise(F.array().cast(SAMPLES)))
    if method == "bootstrap":
        n_res = L - F.lit(S)
        key = F.conv(F.substring(F.md5(F.col(cfg.series_col).cast("string")), 1, 7), 16, 10).cast("long")

        def draw(j, h):
            t = F.lit(S) + F.pmod(draw_number(key, F.col("window_id"), j, h, seed), n_res.cast("long")).cast("int")
            return F.get(ctx, L - S + h % S) + (F.get(ctx, t) - F.get(ctx, t - S))

        paths = F.transform(F.sequence(F.lit(1), F.lit(J)), lambda j: F.transform(F.sequence(F.lit(0), steps - 1), lambda h: draw(j, h)))
        return df.withColumn("samples", F.when(n_res >= 1, paths).otherwise(F.array().cast(SAMPLES)))
    if method == "plugin":
        if fn is None:
            raise ValueError("method='plugin' needs fn")
        return _plugin(df, fn, H, J, seed, batch_size)
    if method == "model":
        if factory is None:
            raise ValueError("method='model' needs factory")
        return _loaded(df, factory, cfg.context_length, H, J, batch_size)
    raise ValueError(f"unknown sampler {method!r}")


def _loaded(df: DataFrame, factory: Callable, C: int, H: int, J: int, batch_size: int) -> DataFrame:
    """Windows scored by a model that each worker loads once and keeps between batches and tasks."""

    def make():
        import numpy as np

        score = factory()

        def predict(contexts, lengths):
            paths = np.asarray(score(contexts, lengths.astype(np.int64)), dtype=np.float64)
            if paths.shape != (len(contexts), J, H):
                raise ValueError(f"the model must return {len(contexts)} x {J} x {H} values, not {paths.shape}")
            return paths.reshape(len(contexts), J * H)

        return predict

    udf = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[C], []])
    known = F.coalesce("ctx", F.array().cast("array<double>"))
    context = F.transform(known, lambda v: F.coalesce(v, F.lit(float("nan"))))
    padded = F.concat(F.array_repeat(F.lit(float("nan")), F.lit(C) - F.size(context)), context)
    flat = df.withColumn("__flat", udf(padded, F.size(context).cast("double")))
    paths = F.transform(F.sequence(F.lit(0), F.lit(J - 1)), lambda j: F.slice("__flat", j * H + 1, H))
    there = F.filter(paths, lambda p: F.exists(p, lambda v: v.isNotNull() & ~F.isnan(v)))
    return flat.withColumn("samples", F.transform(there, lambda p: F.transform(p, nan_to_null))).drop("__flat")


def _plugin(df: DataFrame, fn: Callable, H: int, J: int, seed: int, batch_size: int) -> DataFrame:
    schema = T.StructType(df.schema.fields + [T.StructField("samples", SAMPLES, True)])

    def score(batches):
        import numpy as np

        for pdf in batches:
            out = []
            ctxs = [np.asarray(c, dtype=np.float64) for c in pdf["ctx"]]
            for start in range(0, len(ctxs), batch_size):
                chunk = ctxs[start : start + batch_size]
                got = list(fn(chunk, H, J, seed))
                if len(chunk) == 1 and got and np.ndim(got[0]) == 1:
                    got = [got]  # the samples of the one context
                if len(got) != len(chunk):
                    raise ValueError(f"plugin returned {len(got)} results for {len(chunk)} contexts")
                for paths in got:
                    paths = np.asarray(paths, dtype=np.float64)
                    if paths.size and (paths.ndim != 2 or paths.shape[1] != H):
                        raise ValueError(f"plugin must return samples x {H} for each context, not {paths.shape}")
                    out.append([list(map(float, path)) for path in paths])
            yield pdf.assign(samples=out)

    return df.mapInPandas(score, schema)


def seasonal_analog_plugin(season_length: int = 48):
    """A numpy scorer with the ``analog`` rule, for plugging tests and examples."""

    def fn(contexts, horizon, num_samples, seed):
        import numpy as np

        out = []
        for c in contexts:
            L = len(c)
            h = np.arange(horizon)
            paths = [c[L - j * season_length + h % season_length] for j in range(1, min(num_samples, L // season_length) + 1)]
            out.append(np.stack(paths) if paths else np.empty((0, horizon)))
        return out

    return fn


def seasonal_analog_model(num_samples: int, horizon: int, season_length: int = 48):
    """A factory with the ``analog`` rule, for tests and examples of ``method="model"``."""

    def factory():
        import numpy as np

        h = np.arange(horizon) % season_length

        def fn(contexts, lengths):
            out = np.full((len(contexts), num_samples, horizon), np.nan)
            for j in range(1, num_samples + 1):
                enough = lengths >= j * season_length
                out[enough, j - 1] = contexts[enough][:, contexts.shape[1] - j * season_length + h] if enough.any() else 0
            return out

        return fn

    return factory


def _quantile(vals, n, q: float):
    """Linear-interpolated quantile of a sorted array (the usual ``linear`` method)."""
    rank = F.lit(q) * (n - 1).cast("double")
    lo = F.floor(rank).cast("int")
    hi = F.least(lo + 1, n - 1)
    frac = rank - lo.cast("double")
    a, b = F.get(vals, lo), F.get(vals, hi)
    return a + (b - a) * frac


def prediction_bands(paths: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Per window and step: lower median and the (1-c)/2, (1+c)/2 linear quantiles of the samples.

    Output: the window's keys, ``step, ts, y, median, low, high`` (one row per step).
    The lower median is the ``(n-1) div 2``-th order statistic (even sample counts do not
    average the two middle values).
    """
    _check(1, confidence)
    alpha = 1.0 - confidence
    lo_q, hi_q = alpha / 2.0, 1.0 - alpha / 2.0
    keep = window_keys(paths)
    rows = paths.select(*keep, "samples", F.posexplode("horizon").alias("step", "h"))
    vals = F.array_sort(F.transform(F.col("samples"), lambda s: F.get(s, F.col("step"))))
    rows = rows.select(*keep, "step", F.col("h.ts").alias("ts"), F.col("h.y").alias("y"), vals.alias("v"))
    n = F.size("v")
    return rows.select(
        *keep,
        F.col("step").cast("int").alias("step"),
        "ts",
        "y",
        F.when(n > 0, F.get(F.col("v"), ((n - 1) / 2).cast("int"))).alias("median"),
        F.when(n > 0, _quantile(F.col("v"), n, lo_q)).alias("low"),
        F.when(n > 0, _quantile(F.col("v"), n, hi_q)).alias("high"),
    )


def sample_rows(paths: DataFrame) -> DataFrame:
    """The long form: the window's keys, ``step, ts, y, sample, value``, one row per window, step and
    sample (a window without samples keeps one row per step, with neither)."""
    keep = window_keys(paths)
    steps = paths.select(*keep, "samples", F.posexplode("horizon").alias("step", "h"))
    values = F.transform("samples", lambda s: F.get(s, F.col("step")))
    return steps.select(*keep, "step", F.col("h.ts").alias("ts"), F.col("h.y").alias("y"), F.posexplode_outer(values).alias("sample", "value"))


def _band_keys(rows: DataFrame, by: Sequence[str] | None) -> list[str]:
    return list(by) if by else [c for c in rows.columns if c not in ("ts", "y", "sample", "value", "sketch", "n")]


def prediction_bands_long(rows: DataFrame, confidence: float = 0.9, by: Sequence[str] | None = None) -> DataFrame:
    """Bands from sample rows, in whatever order and partitions they lie: exact order statistics of each
    group (``by``; default the window's keys and ``step``).

    Same columns and values as :func:`prediction_bands`. Missing samples don't count; a group without
    samples has NULL bands. Partial aggregates hold a group's distinct values, so this is for groups of
    samples (``num_samples``); for groups of any size see :func:`band_sketches`.
    """
    _check(1, confidence)
    alpha = 1.0 - confidence
    by = _band_keys(rows, by)
    shown = [F.min(c).alias(c) for c in ("ts", "y") if c in rows.columns and c not in by]
    bands = F.percentile("value", F.array(F.lit(alpha / 2.0), F.lit(1.0 - alpha / 2.0)))
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)")
    out = rows.groupBy(*by).agg(*shown, middle.alias("median"), bands.alias("__bands"))
    return out.select(*[c for c in out.columns if c != "__bands"], F.get("__bands", 0).alias("low"), F.get("__bands", 1).alias("high"))


def sketch_error(k: int) -> float:
    """Share of a group's rows by which the rank of a sketched quantile may be off (99 % of quantiles;
    the published bound of KLL sketches with parameter ``k``)."""
    return 2.296 / k**0.9723


def band_sketches(rows: DataFrame, by: Sequence[str] | None = None, k: int = 800) -> DataFrame:
    """One quantile sketch per group: ``*by, n, sketch``, of a few kilobytes whatever the group's size.

    Sketches of parts (batches, days, finer groups) can be stored and merged later, so that bands over
    all samples need no second look at them. Aggregation combines within tasks; no group is held whole.
    """
    by = _band_keys(rows, by)
    value = F.col("value").cast("double")
    return rows.groupBy(*by).agg(F.count("value").alias("n"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of parts as sketches of their groups ``by``."""
    parts = F.collect_list(F.when(F.col("n") > 0, F.col("sketch")))  # one per part
    merged = F.when(F.size("__parts") > 0, F.reduce(F.expr("slice(__parts, 2, greatest(size(__parts) - 1, 0))"), F.get("__parts", 0), F.kll_sketch_merge_double))
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), parts.alias("__parts")).select(*by, "n", merged.alias("sketch"))


def bands_from_sketches(sketches: DataFrame, confidence: float = 0.9) -> DataFrame:
    """``median, low, high`` of each sketch: values whose ranks are off by :func:`sketch_error` at most."""
    _check(1, confidence)
    alpha = 1.0 - confidence
    at = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, at(0.5).alias("median"), at(alpha / 2.0).alias("low"), at(1.0 - alpha / 2.0).alias("high"))
