"""Registered checks: one Spark query per operator group, each with an equivalent DuckDB SQL.

Every query reads the driver tables at ``sf_dir`` (through :mod:`tsengine.sources.fixtures`), so
its work grows with the data. DOUBLE outputs are rounded to 6 digits on both sides; integer
outputs are BIGINT/SMALLINT/TINYINT on both sides.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.operators import align, asof, charts, clean, features, metrics, probabilistic, scale, split, tabular, windows
from tsengine.plans import flagship as flagship_plan
from tsengine.plans.end_to_end import run_end_to_end
from tsengine.session import scratch_path
from tsengine.sources import artefacts, files, sinks
from tsengine.sources import fixtures as fx
from tsengine.streaming import land_stream, stream_clean_lags

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, alias: str | None = None, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits}) AS {alias or expr}"


# ----------------------------------------------------------------------------- SQL fixtures
SQL_FIXTURES = {
    "events_30min": "SELECT 'all' AS series_id, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, sum(value) AS y FROM events GROUP BY 2",
    "events_hourly_by_type": "SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS y FROM events GROUP BY 1, 2",
    "orders_daily": "SELECT 'all' AS series_id, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 2",
    "lineitem_daily": (
        "SELECT l_returnflag AS series_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, sum(l_extendedprice) AS y, "
        "sum(l_quantity) AS x_qty, avg(l_discount) AS x_disc FROM lineitem GROUP BY 1, 2"
    ),
    "user_events": "SELECT user_id AS series_id, ts, event_id, value AS y FROM events",
    "events_dirty": (
        "SELECT event_id, CASE WHEN event_id % 29 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_raw, "
        "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value_raw, "
        "event_type AS series_id FROM events "
        "UNION ALL SELECT event_id + 10000000, CASE WHEN event_id % 29 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, "
        "CAST(value + 1 AS VARCHAR), event_type FROM events WHERE event_id % 31 = 0"
    ),
}


def with_fixtures(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    ctes = [f"{n} AS ({SQL_FIXTURES[n]})" for n in names] + [f"{n} AS ({q})" for n, q in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ----------------------------------------------------------------------------- cleaning
PARSED_SQL = "SELECT event_id, series_id, try_strptime(ts_raw, '%Y-%m-%d %H:%M:%S') AS ts, value_raw FROM events_dirty"
DEDUP_SQL = (
    "SELECT series_id, ts, arg_max(event_id, event_id) AS event_id, arg_max(value_raw, event_id) AS value_raw "
    "FROM parsed WHERE ts IS NOT NULL GROUP BY series_id, ts"
)
COERCED_SQL = "SELECT series_id, ts, CASE WHEN isnan(TRY_CAST(value_raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(value_raw AS DOUBLE) END AS y FROM dedup"
INTERP_SQL = """SELECT series_id, ts, CASE
    WHEN y IS NOT NULL THEN y
    WHEN pt IS NOT NULL AND nt IS NOT NULL AND epoch_us(nt) - epoch_us(pt) > 0
      THEN pv + (nv - pv) * (CAST(epoch_us(ts) - epoch_us(pt) AS DOUBLE) / CAST(epoch_us(nt) - epoch_us(pt) AS DOUBLE))
    WHEN pt IS NOT NULL THEN pv ELSE nv END AS y
  FROM (SELECT series_id, ts, y,
    last_value(CASE WHEN y IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
    last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    first_value(CASE WHEN y IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
    first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM coerced)"""
FILL_SQL = """SELECT series_id, ts, coalesce(y1, first_value(y1 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y
  FROM (SELECT series_id, ts, coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS y1 FROM {src})"""
CLEAN_CHAIN = [("parsed", PARSED_SQL), ("dedup", DEDUP_SQL), ("coerced", COERCED_SQL)]


def _parsed(spark, d):
    return clean.parse_ts(fx.events_dirty(spark, d), "ts_raw", "yyyy-MM-dd HH:mm:ss", out="ts")


def q_parse_ts(spark, d):
    return _parsed(spark, d).select("event_id", "series_id", "ts")


def _dedup(spark, d):
    return clean.dedup_last(_parsed(spark, d), ["series_id", "ts"], ["event_id"])


def q_dedup_last(spark, d):
    return _dedup(spark, d).select("series_id", "ts", "event_id", "value_raw")


def _coerced(spark, d):
    return clean.coerce_numeric(_dedup(spark, d).select("series_id", "ts", F.col("value_raw").alias("y")), ["y"])


def q_coerce_numeric(spark, d):
    return rounded(_coerced(spark, d))


def q_interpolate_time(spark, d):
    return rounded(clean.interpolate_time(_coerced(spark, d), ["y"]))


def q_fill_edges(spark, d):
    return rounded(clean.fill_edges(_coerced(spark, d), ["y"]))


def q_clean_series(spark, d):
    raw = fx.events_dirty(spark, d)
    out = clean.clean_series(raw, ForecastConfig(), value_cols=["value_raw"], time_raw="ts_raw", tie_break=["event_id"])
    return rounded(out.withColumnRenamed("value_raw", "y"))


SQL_CLEAN = {
    "parse_ts": with_fixtures("SELECT event_id, series_id, ts FROM parsed WHERE ts IS NOT NULL", "events_dirty", extra=[("parsed", PARSED_SQL)]),
    "dedup_last": with_fixtures("SELECT * FROM dedup", "events_dirty", extra=CLEAN_CHAIN[:2]),
    "coerce_numeric": with_fixtures("SELECT series_id, ts, round(y, 6) AS y FROM coerced", "events_dirty", extra=CLEAN_CHAIN),
    "interpolate_time": with_fixtures("SELECT series_id, ts, round(y, 6) AS y FROM interp", "events_dirty", extra=CLEAN_CHAIN + [("interp", INTERP_SQL)]),
    "fill_edges": with_fixtures(
        "SELECT series_id, ts, round(y, 6) AS y FROM filled", "events_dirty", extra=CLEAN_CHAIN + [("filled", FILL_SQL.format(src="coerced"))]
    ),
    "clean_series": with_fixtures(
        "SELECT series_id, ts, round(y, 6) AS y FROM filled WHERE y IS NOT NULL",
        "events_dirty",
        extra=CLEAN_CHAIN + [("interp", INTERP_SQL), ("filled", FILL_SQL.format(src="interp"))],
    ),
}


# ----------------------------------------------------------------------------- features
CAL_SQL = (
    "CAST(hour(ts) AS SMALLINT) AS hour, CAST(isodow(ts) - 1 AS SMALLINT) AS day_of_week, CAST(month(ts) AS SMALLINT) AS month, "
    "CAST(quarter(ts) AS SMALLINT) AS quarter, CAST(dayofyear(ts) AS SMALLINT) AS day_of_year, "
    "CAST(CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS TINYINT) AS is_weekend"
)
W_SQL = "OVER (PARTITION BY series_id ORDER BY ts{frame})"


def lag_sql(target: str, steps, rnd: bool = True) -> list[str]:
    out = []
    for k in steps:
        e = f"lag({target}, {k}) " + W_SQL.format(frame="")
        out.append(r(e, f"{target}_lag_{k}") if rnd else f"{e} AS {target}_lag_{k}")
    return out


def rolling_sql(target: str, widths, kinds=("mean", "std"), rnd: bool = True) -> list[str]:
    out = []
    for w in widths:
        frame = W_SQL.format(frame=f" ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING")
        full = f"count({target}) {frame} = {w}"
        for kind in kinds:
            fn = "avg" if kind == "mean" else "stddev_samp"
            e = f"CASE WHEN {full} THEN {fn}({target}) {frame} END"
            name = f"{target}_roll_{kind}_{w}"
            out.append(r(e, name) if rnd else f"{e} AS {name}")
    return out


def q_calendar(spark, d):
    return features.add_calendar(fx.events_hourly_by_type(spark, d)).drop("y")


def q_lags(spark, d):
    return rounded(features.add_lags(fx.events_hourly_by_type(spark, d), [1, 2, 24]))


def q_rolling_mean(spark, d):
    out = features.add_rolling(fx.events_hourly_by_type(spark, d), [3, 6, 12, 24, 48])
    return rounded(out.select("series_id", "ts", "y", *[c for c in out.columns if "_roll_mean_" in c]))


def q_rolling_std(spark, d):
    out = features.add_rolling(fx.events_hourly_by_type(spark, d), [3, 6, 12, 24, 48])
    return rounded(out.select("series_id", "ts", "y", *[c for c in out.columns if "_roll_std_" in c]))


def q_build_features(spark, d):
    return rounded(features.build_features(fx.events_hourly_by_type(spark, d), ForecastConfig()))


def q_build_features_blocks(spark, d):
    cfg = ForecastConfig(layout="blocks", block_rows=400)
    return rounded(features.build_features(fx.events_hourly_by_type(spark, d), cfg))


def q_position(spark, d):
    return features.with_position(fx.user_events(spark, d)).drop("y")


def q_tail_n(spark, d):
    return rounded(features.tail_n(fx.user_events(spark, d), 5))


def _features_sql(cfg: ForecastConfig) -> str:
    steps = features.lag_steps(cfg.max_lag, cfg.seasonal_anchors)
    widths = features.rolling_windows(cfg.max_lag, cfg.rolling_candidates)
    cols = ", ".join(["series_id", "ts", "round(y, 6) AS y", CAL_SQL] + lag_sql("y", steps) + rolling_sql("y", widths))
    return cols


def _build_features_sql() -> str:
    cfg = ForecastConfig()
    steps = features.lag_steps(cfg.max_lag, cfg.seasonal_anchors)
    need = " AND ".join([f"y_lag_{k} IS NOT NULL" for k in steps[-1:]] + ["y_roll_std_48 IS NOT NULL"])
    return with_fixtures(f"SELECT * FROM (SELECT {_features_sql(cfg)} FROM events_hourly_by_type) WHERE {need}", "events_hourly_by_type")


SQL_FEATURES = {
    "calendar": with_fixtures(f"SELECT series_id, ts, {CAL_SQL} FROM events_hourly_by_type", "events_hourly_by_type"),
    "lags": with_fixtures(f"SELECT series_id, ts, round(y, 6) AS y, {', '.join(lag_sql('y', [1, 2, 24]))} FROM events_hourly_by_type", "events_hourly_by_type"),
    "rolling_mean": with_fixtures(
        f"SELECT series_id, ts, round(y, 6) AS y, {', '.join(rolling_sql('y', [3, 6, 12, 24, 48], ('mean',)))} FROM events_hourly_by_type",
        "events_hourly_by_type",
    ),
    "rolling_std": with_fixtures(
        f"SELECT series_id, ts, round(y, 6) AS y, {', '.join(rolling_sql('y', [3, 6, 12, 24, 48], ('std',)))} FROM events_hourly_by_type",
        "events_hourly_by_type",
    ),
    "build_features": _build_features_sql(),
    "build_features_blocks": _build_features_sql(),
    "position": with_fixtures(
        "SELECT series_id, ts, event_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS BIGINT) AS pos FROM user_events",
        "user_events",
    ),
    "tail_n": with_fixtures(
        "SELECT series_id, ts, event_id, round(y, 6) AS y FROM user_events QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 5",
        "user_events",
    ),
}

QUERIES = {
    "parse_ts": q_parse_ts,
    "dedup_last": q_dedup_last,
    "coerce_numeric": q_coerce_numeric,
    "interpolate_time": q_interpolate_time,
    "fill_edges": q_fill_edges,
    "clean_series": q_clean_series,
    "calendar": q_calendar,
    "lags": q_lags,
    "rolling_mean": q_rolling_mean,
    "rolling_std": q_rolling_std,
    "build_features": q_build_features,
    "build_features_blocks": q_build_features_blocks,
    "position": q_position,
    "tail_n": q_tail_n,
}
ORACLE_SQL = {**SQL_CLEAN, **SQL_FEATURES}


# ----------------------------------------------------------------------------- windows

SPLIT_EXPR = "CAST(floor({n} * (CAST(1.0 AS DOUBLE) - CAST({t} AS DOUBLE))) AS BIGINT)"


def _windows_ctes(fixture: str, C: int, H: int, S: int, t: float = 0.2) -> list[tuple[str, str]]:
    k = SPLIT_EXPR.format(n="n", t=repr(t))
    return [
        ("s", f"SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM {fixture}"),
        ("c", f"SELECT series_id, n, least(greatest({k}, {C + H}), n - 1) AS cut FROM (SELECT series_id, any_value(n) AS n FROM s GROUP BY series_id)"),
        ("ok", f"SELECT * FROM c WHERE cut >= {C + H} AND n - cut >= {H}"),
        (
            "win",
            f"SELECT series_id, 'train' AS split, unnest(range({C}, cut - {H} + 1, {S})) AS e FROM ok "
            f"UNION ALL SELECT series_id, 'test' AS split, unnest(range(cut, n - {H} + 1, {S})) AS e FROM ok",
        ),
        ("pts", f"SELECT w.series_id, w.e, w.split, s.pos, s.ts, s.y FROM win w JOIN s ON s.series_id = w.series_id AND s.pos >= w.e - {C} AND s.pos < w.e + {H}"),
    ]


def _windows_summary_sql(fixture: str, C: int, H: int, S: int) -> str:
    body = """SELECT series_id, CAST(e AS BIGINT) AS window_id, split,
  CAST(count(*) FILTER (WHERE pos < e) AS BIGINT) AS ctx_len,
  round(arg_min(y, pos) FILTER (WHERE pos < e), 6) AS ctx_first,
  round(arg_max(y, pos) FILTER (WHERE pos < e), 6) AS ctx_last,
  round(sum(y) FILTER (WHERE pos < e), 2) AS ctx_sum,
  CAST(count(*) FILTER (WHERE pos >= e) AS BIGINT) AS h_len,
  min(ts) FILTER (WHERE pos >= e) AS h_first_ts,
  max(ts) FILTER (WHERE pos >= e) AS h_last_ts,
  round(sum(y) FILTER (WHERE pos >= e), 2) AS h_sum
FROM pts GROUP BY series_id, e, split"""
    return with_fixtures(body, fixture, extra=_windows_ctes(fixture, C, H, S))


def summarize_windows(w: DataFrame) -> DataFrame:
    n_c, n_h = F.size("ctx"), F.size("horizon")
    out = w.select(
        "series_id",
        "window_id",
        "split",
        n_c.cast("bigint").alias("ctx_len"),
        F.get(F.col("ctx"), 0).alias("ctx_first"),
        F.get(F.col("ctx"), n_c - 1).alias("ctx_last"),
        F.round(F.aggregate("ctx", F.lit(0.0), lambda a, x: a + x), 2).alias("ctx_sum"),
        n_h.cast("bigint").alias("h_len"),
        F.get(F.col("horizon"), 0)["ts"].alias("h_first_ts"),
        F.get(F.col("horizon"), n_h - 1)["ts"].alias("h_last_ts"),
        F.round(F.aggregate("horizon", F.lit(0.0), lambda a, x: a + x["y"]), 2).alias("h_sum"),
    )
    return rounded(out)


WIN30 = ForecastConfig(on_short="skip")  # C=1024, H=24, stride H
STRIDE_CFG = ForecastConfig(context_length=60, prediction_length=14, stride=7, on_short="skip")
ORDERS_CFG = ForecastConfig(context_length=364, prediction_length=28, on_short="skip")


def _win30(spark, d):
    return windows.context_windows(fx.events_30min(spark, d), WIN30)


def q_context_windows(spark, d):
    return summarize_windows(_win30(spark, d))


def q_context_windows_stride(spark, d):
    return summarize_windows(windows.context_windows(fx.orders_daily(spark, d), STRIDE_CFG))


def q_window_dataset(spark, d):
    return summarize_windows(windows.window_dataset(fx.orders_daily(spark, d), ORDERS_CFG))


def q_context_windows_dense(spark, d):
    w = _win30(spark, d)
    keys = ["series_id", "window_id", "split"]
    ctx = w.select(*keys, F.posexplode("ctx").alias("idx", "y")).select(
        *keys, F.lit("ctx").alias("part"), F.col("idx").cast("bigint").alias("idx"), F.lit(None).cast("timestamp_ntz").alias("ts"), "y"
    )
    hor = windows.explode_horizon(w).select(*keys, F.lit("h").alias("part"), F.col("step").cast("bigint").alias("idx"), "ts", "y")
    return rounded(ctx.unionByName(hor))


def q_explode_horizon(spark, d):
    return rounded(windows.explode_horizon(_win30(spark, d)).withColumn("step", F.col("step").cast("bigint")))


def q_first_step(spark, d):
    return rounded(windows.first_step(_win30(spark, d)))


def _paths(spark, d, method="analog"):
    return probabilistic.sample_paths(_win30(spark, d), WIN30, method=method)


def q_sample_paths_analog(spark, d):
    p = _paths(spark, d)
    keys = ["series_id", "window_id", "split"]
    out = p.select(*keys, F.posexplode("samples").alias("sample", "path")).select(*keys, "sample", F.posexplode("path").alias("step", "value"))
    return rounded(out.select(*keys, F.col("sample").cast("bigint").alias("sample"), F.col("step").cast("bigint").alias("step"), "value"))


def q_prediction_bands(spark, d):
    return rounded(probabilistic.prediction_bands(_paths(spark, d), 0.9))


def q_sample_paths_bootstrap(spark, d):
    p = _paths(spark, d, "bootstrap")
    return rounded(probabilistic.prediction_bands(p, 0.9))


def q_sample_paths_plugin(spark, d):
    p = probabilistic.sample_paths(_win30(spark, d), WIN30, method="plugin", fn=probabilistic.seasonal_analog_plugin(48))
    return rounded(probabilistic.prediction_bands(p, 0.9))


J30 = min(WIN30.num_samples, WIN30.context_length // WIN30.season_length)
_LOQ, _HIQ = (1.0 - 0.9) / 2.0, 1.0 - (1.0 - 0.9) / 2.0
SAMPLES_SQL = (
    f"SELECT w.series_id, w.e, w.split, CAST(j.j - 1 AS BIGINT) AS sample, CAST(h.h AS BIGINT) AS step, s.y AS value "
    f"FROM win w, range(1, {J30 + 1}) j(j), range(0, {WIN30.prediction_length}) h(h), s "
    f"WHERE s.series_id = w.series_id AND s.pos = w.e - j.j * {WIN30.season_length} + (h.h % {WIN30.season_length})"
)
BANDS_SQL = f"""SELECT b.series_id, CAST(b.e AS BIGINT) AS window_id, b.split, CAST(b.step AS INTEGER) AS step, s.ts, round(s.y, 6) AS y,
  round(b.med, 6) AS median, round(b.lo, 6) AS low, round(b.hi, 6) AS high
FROM (SELECT series_id, e, split, step, list_sort(list(value))[CAST((count(*) - 1) // 2 AS BIGINT) + 1] AS med,
        quantile_cont(value, {_LOQ!r}) AS lo, quantile_cont(value, {_HIQ!r}) AS hi
      FROM samples GROUP BY series_id, e, split, step) b
JOIN s ON s.series_id = b.series_id AND s.pos = b.e + b.step"""

SQL_WINDOWS = {
    "context_windows": _windows_summary_sql("events_30min", 1024, 24, 24),
    "context_windows_stride": _windows_summary_sql("orders_daily", 60, 14, 7),
    "window_dataset": _windows_summary_sql("orders_daily", 364, 28, 28),
    "context_windows_dense": with_fixtures(
        "SELECT series_id, CAST(e AS BIGINT) AS window_id, split, CASE WHEN pos < e THEN 'ctx' ELSE 'h' END AS part, "
        "CAST(CASE WHEN pos < e THEN pos - (e - 1024) ELSE pos - e END AS BIGINT) AS idx, "
        "CASE WHEN pos < e THEN NULL ELSE ts END AS ts, round(y, 6) AS y FROM pts",
        "events_30min",
        extra=_windows_ctes("events_30min", 1024, 24, 24),
    ),
    "explode_horizon": with_fixtures(
        "SELECT series_id, CAST(e AS BIGINT) AS window_id, split, CAST(pos - e AS BIGINT) AS step, ts, round(y, 6) AS y FROM pts WHERE pos >= e",
        "events_30min",
        extra=_windows_ctes("events_30min", 1024, 24, 24),
    ),
    "first_step": with_fixtures(
        "SELECT series_id, CAST(e AS BIGINT) AS window_id, split, ts, round(y, 6) AS y FROM pts WHERE pos = e",
        "events_30min",
        extra=_windows_ctes("events_30min", 1024, 24, 24),
    ),
    "sample_paths_analog": with_fixtures(
        "SELECT series_id, CAST(e AS BIGINT) AS window_id, split, sample, step, round(value, 6) AS value FROM samples",
        "events_30min",
        extra=_windows_ctes("events_30min", 1024, 24, 24) + [("samples", SAMPLES_SQL)],
    ),
    "prediction_bands": with_fixtures(
        BANDS_SQL, "events_30min", extra=_windows_ctes("events_30min", 1024, 24, 24) + [("samples", SAMPLES_SQL)]
    ),
}
SQL_WINDOWS["sample_paths_plugin"] = SQL_WINDOWS["prediction_bands"]


# ----------------------------------------------------------------------------- evaluation
def _nvs(spark, d, test_size=0.2):
    """naive (lag 1) and seasonal-naive (lag 24) hourly forecasts with a lag-24/48 band."""
    base = fx.events_hourly_by_type(spark, d)
    base = features.add_lags(base, [1, 24, 48])
    base = split.split_chrono(base, test_size)
    return base.select(
        "series_id",
        "ts",
        "y",
        "split",
        F.col("y_lag_1").alias("pred_a"),
        F.col("y_lag_24").alias("pred_b"),
        F.least("y_lag_24", "y_lag_48").alias("low"),
        F.greatest("y_lag_24", "y_lag_48").alias("high"),
    )


def _side_a(spark, d):
    return _nvs(spark, d, 0.2).filter("split = 'test' AND pred_a IS NOT NULL").select("series_id", "ts", F.col("y").alias("y_true_a"), "pred_a")


def _side_b(spark, d, shift_minutes: int = 0):
    b = _nvs(spark, d, 0.3).filter("split = 'test' AND pred_b IS NOT NULL AND low IS NOT NULL")
    ts = F.col("ts") + F.expr(f"INTERVAL {shift_minutes} MINUTES") if shift_minutes else F.col("ts")
    return b.select("series_id", ts.alias("ts"), F.col("y").alias("y_true_b"), "pred_b", "low", "high")


def _aligned(spark, d):
    return align.align_forecasts(_side_a(spark, d), _side_b(spark, d)).withColumn("y_true", F.col("y_true_b"))


def _tail_aligned(spark, d):
    return align.align_forecasts(_side_a(spark, d), _side_b(spark, d, 30)).withColumn("y_true", F.col("y_true_b"))


def q_align_inner(spark, d):
    return rounded(_aligned(spark, d))


def q_align_tail_fallback(spark, d):
    return rounded(_tail_aligned(spark, d))


def q_truth_gap(spark, d):
    return rounded(align.truth_gap(_tail_aligned(spark, d), by=["series_id"]))


def q_tune_blend(spark, d):
    return rounded(align.tune_blend(_aligned(spark, d), points=101))


def q_tune_blend_by_series(spark, d):
    return rounded(align.tune_blend(_aligned(spark, d), points=101, by=["series_id"]))


def _blended(spark, d):
    return align.blend(_aligned(spark, d), 0.37)


def q_blend(spark, d):
    return rounded(_blended(spark, d).select("series_id", "ts", "y_true", "pred_a", "pred_b", "hybrid_pred"))


PREDS = {"naive": "pred_a", "seasonal": "pred_b", "hybrid": "hybrid_pred"}


def q_metrics_mse_rmse_mae(spark, d):
    return rounded(metrics.forecast_metrics(_blended(spark, d), PREDS, metrics=["mse", "rmse", "mae"]))


def q_metrics_mape(spark, d):
    return rounded(metrics.forecast_metrics(_blended(spark, d), PREDS, metrics=["mape"]))


def q_metrics_r2(spark, d):
    return rounded(metrics.forecast_metrics(_blended(spark, d), PREDS, metrics=["r2"]))


def q_forecast_metrics(spark, d):
    return rounded(metrics.forecast_metrics(_blended(spark, d), PREDS, by=["series_id"]))


def q_compare_models(spark, d):
    return rounded(metrics.compare_models(metrics.forecast_metrics(_blended(spark, d), PREDS)))


NVS_SQL = (
    "SELECT series_id, ts, y, lag(y, 1) OVER w AS pred_a, lag(y, 24) OVER w AS pred_b, "
    "least(lag(y, 24) OVER w, lag(y, 48) OVER w) AS low, greatest(lag(y, 24) OVER w, lag(y, 48) OVER w) AS high, "
    "row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM events_hourly_by_type "
    "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"
)


def _k(t: float) -> str:
    return f"least(greatest({SPLIT_EXPR.format(n='n', t=repr(t))}, 1), n - 1)"


EVAL_CTES = [
    ("nvs", NVS_SQL),
    ("a", f"SELECT series_id, ts, y AS y_true_a, pred_a FROM nvs WHERE pos >= {_k(0.2)} AND pred_a IS NOT NULL"),
    ("b", f"SELECT series_id, ts, y AS y_true_b, pred_b, low, high FROM nvs WHERE pos >= {_k(0.3)} AND pred_b IS NOT NULL AND low IS NOT NULL"),
    ("al", "SELECT a.series_id, a.ts, y_true_a, pred_a, y_true_b, pred_b, low, high, y_true_b AS y_true FROM a JOIN b USING (series_id, ts)"),
    ("bl", "SELECT *, CAST(0.37 AS DOUBLE) * pred_a + (CAST(1.0 AS DOUBLE) - CAST(0.37 AS DOUBLE)) * pred_b AS hybrid_pred FROM al"),
]
TAIL_CTES = EVAL_CTES[:3] + [
    ("bs", "SELECT series_id, ts + INTERVAL 30 MINUTE AS ts, y_true_b, pred_b, low, high FROM b"),
    ("ar", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rk FROM a"),
    ("br", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rk FROM bs"),
    ("tl", "SELECT ar.series_id, ar.ts, y_true_a, pred_a, y_true_b, pred_b, low, high, y_true_b AS y_true FROM ar JOIN br USING (series_id, rk)"),
]
ALIGN_COLS = "series_id, ts, round(y_true_a, 6) AS y_true_a, round(pred_a, 6) AS pred_a, round(y_true_b, 6) AS y_true_b, round(pred_b, 6) AS pred_b, round(low, 6) AS low, round(high, 6) AS high, round(y_true, 6) AS y_true"
EPS = "CAST(2.220446049250313e-16 AS DOUBLE)"


def _metric_sql(pred: str, metric: str) -> str:
    ys = f"CASE WHEN abs(y_true) <= 1e-8 THEN {EPS} ELSE y_true END"
    return {
        "mse": f"avg(power(y_true - {pred}, 2))",
        "rmse": f"sqrt(avg(power(y_true - {pred}, 2)))",
        "mae": f"avg(abs(y_true - {pred}))",
        "mape": f"avg(abs({ys} - {pred}) / greatest(abs({ys}), {EPS})) * 100",
        "r2": (
            f"CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y_true) * count(*) = 0 THEN (CASE WHEN sum(power(y_true - {pred}, 2)) = 0 THEN 1.0 ELSE 0.0 END) "
            f"ELSE 1 - sum(power(y_true - {pred}, 2)) / (var_pop(y_true) * count(*)) END"
        ),
    }[metric]


def _metrics_sql(ms, by: str = "") -> str:
    parts = []
    for model, col in PREDS.items():
        for m in ms:
            sel = f"{by + ', ' if by else ''}'{model}' AS model, '{m}' AS metric, round(CAST({_metric_sql(col, m)} AS DOUBLE), 6) AS value"
            parts.append(f"SELECT {sel} FROM bl" + (f" GROUP BY {by}" if by else ""))
    return with_fixtures(" UNION ALL ".join(parts), "events_hourly_by_type", extra=EVAL_CTES)


def _tune_sql(by: str = "") -> str:
    grid = "(SELECT CASE WHEN i = 100 THEN CAST(1.0 AS DOUBLE) ELSE i * (CAST(1.0 AS DOUBLE) / 100) END AS w FROM range(0, 101) t(i))"
    key = f"{by}, " if by else ""
    body = (
        f"SELECT {key}round(w, 6) AS weight, round(rmse, 6) AS rmse FROM ("
        f"SELECT {key}g.w, sqrt(avg(power(y_true - (g.w * pred_a + (1 - g.w) * pred_b), 2))) AS rmse FROM al, {grid} g GROUP BY {key}g.w) "
        f"QUALIFY row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY rmse, w) = 1"
    )
    return with_fixtures(body, "events_hourly_by_type", extra=EVAL_CTES)


def _compare_sql() -> str:
    parts = []
    for model, col in PREDS.items():
        cols = ", ".join(f"round(CAST({_metric_sql(col, m)} AS DOUBLE), 6) AS {m}" for m in metrics.PREFERRED)
        parts.append(f"SELECT '{model}' AS model, {cols} FROM bl")
    return with_fixtures(" UNION ALL ".join(parts), "events_hourly_by_type", extra=EVAL_CTES)


SQL_EVAL = {
    "align_inner": with_fixtures(f"SELECT {ALIGN_COLS} FROM al", "events_hourly_by_type", extra=EVAL_CTES[:4]),
    "align_tail_fallback": with_fixtures(f"SELECT {ALIGN_COLS} FROM tl", "events_hourly_by_type", extra=TAIL_CTES),
    "truth_gap": with_fixtures(
        "SELECT series_id, round(avg(abs(y_true_a - y_true_b)), 6) AS truth_gap, count(*) AS n FROM tl GROUP BY series_id",
        "events_hourly_by_type",
        extra=TAIL_CTES,
    ),
    "tune_blend": _tune_sql(),
    "tune_blend_by_series": _tune_sql("series_id"),
    "blend": with_fixtures(
        "SELECT series_id, ts, round(y_true, 6) AS y_true, round(pred_a, 6) AS pred_a, round(pred_b, 6) AS pred_b, round(hybrid_pred, 6) AS hybrid_pred FROM bl",
        "events_hourly_by_type",
        extra=EVAL_CTES,
    ),
    "metrics_mse_rmse_mae": _metrics_sql(["mse", "rmse", "mae"]),
    "metrics_mape": _metrics_sql(["mape"]),
    "metrics_r2": _metrics_sql(["r2"]),
    "forecast_metrics": _metrics_sql(list(metrics.PREFERRED), by="series_id"),
    "compare_models": _compare_sql(),
}

QUERIES.update(
    {
        "context_windows": q_context_windows,
        "context_windows_stride": q_context_windows_stride,
        "window_dataset": q_window_dataset,
        "context_windows_dense": q_context_windows_dense,
        "explode_horizon": q_explode_horizon,
        "first_step": q_first_step,
        "sample_paths_analog": q_sample_paths_analog,
        "prediction_bands": q_prediction_bands,
        "sample_paths_bootstrap": q_sample_paths_bootstrap,
        "sample_paths_plugin": q_sample_paths_plugin,
        "align_inner": q_align_inner,
        "align_tail_fallback": q_align_tail_fallback,
        "truth_gap": q_truth_gap,
        "tune_blend": q_tune_blend,
        "tune_blend_by_series": q_tune_blend_by_series,
        "blend": q_blend,
        "metrics_mse_rmse_mae": q_metrics_mse_rmse_mae,
        "metrics_mape": q_metrics_mape,
        "metrics_r2": q_metrics_r2,
        "forecast_metrics": q_forecast_metrics,
        "compare_models": q_compare_models,
    }
)
ORACLE_SQL.update(SQL_WINDOWS)
ORACLE_SQL.update(SQL_EVAL)


# ----------------------------------------------------------------------------- splits and scaling

SCALE_COLS = ["y", "x_qty", "x_disc", "y_lag_1", "y_lag_7", "day_of_week", "month"]


def _li_split(spark, d, validation=None):
    return split.split_chrono(fx.lineitem_daily(spark, d), 0.2, validation)


def q_split_train_test(spark, d):
    return _li_split(spark, d).select("series_id", "ts", "split")


def q_split_fit_val_test(spark, d):
    return _li_split(spark, d, 0.2).select("series_id", "ts", "split")


def _li_feat(spark, d):
    base = features.add_lags(features.add_calendar(fx.lineitem_daily(spark, d)), [1, 7])
    return split.split_chrono(clean.drop_incomplete(base), 0.2)


def q_scaler_standard_params(spark, d):
    return rounded(scale.fit_scaler(_li_feat(spark, d), SCALE_COLS, "standard"), 4)


def q_scaler_standard_apply(spark, d):
    f = _li_feat(spark, d)
    out = scale.apply_scaler(f, scale.fit_scaler(f, SCALE_COLS, "standard"), SCALE_COLS)
    return rounded(out.select("series_id", "ts", "split", *SCALE_COLS))


def q_scaler_minmax_apply(spark, d):
    f = _li_feat(spark, d)
    out = scale.apply_scaler(f, scale.fit_scaler(f, SCALE_COLS, "minmax"), SCALE_COLS)
    return rounded(out.select("series_id", "ts", "split", *SCALE_COLS))


def q_scaler_inverse(spark, d):
    f = _li_feat(spark, d)
    params = scale.fit_scaler(f, SCALE_COLS, "standard")
    back = scale.invert_scaler(scale.apply_scaler(f, params, SCALE_COLS), params, SCALE_COLS)
    return rounded(back.select("series_id", "ts", *[F.col(c).cast("double").alias(c) for c in SCALE_COLS]))


TAB_CFG = ForecastConfig(max_lag=14, seasonal_anchors=(1, 7, 28), rolling_candidates=(3, 7, 14), max_iter=12, patience=3, max_depth=4, step_size=0.1, min_info_gain=0.0)


def _tab(spark, d):
    ds, params, cols = tabular.tabular_dataset(fx.lineitem_daily(spark, d), TAB_CFG)
    return ds, params, cols


def q_gbt_predict(spark, d):
    ds, params, cols = _tab(spark, d)
    model = tabular.GbtForecaster(TAB_CFG).fit(ds, cols)
    test = ds.filter("split = 'test'")
    return model.predict(test, params, keep=["y_raw"]).withColumnRenamed("y_raw", "y_true")


def q_gbt_importance(spark, d):
    ds, params, cols = _tab(spark, d)
    return tabular.feature_importance(tabular.GbtForecaster(TAB_CFG).fit(ds, cols))


# two features of two values, and trees of one split: SQL can boost the four cells' sums
CURVE_CFG = ForecastConfig(max_iter=12, patience=2, max_depth=1, step_size=0.1, subsample=1.0, feature_subset="all", min_instances_per_node=1, min_info_gain=0.0, boost_chunk=2)


def _curve_model(spark, d):
    rows = features.add_calendar(_li_split(spark, d, 0.2)).select(
        "series_id", "ts", "split", (F.col("y") / 1e6).alias("y"), F.col("is_weekend").cast("double").alias("is_weekend"), (F.col("month") > 6).cast("double").alias("second_half")
    )
    return tabular.GbtForecaster(CURVE_CFG).fit(rows, ["is_weekend", "second_half"])


def q_gbt_curve(spark, d):
    """Validation error of every round that training took until patience stopped it."""
    return rounded(_curve_model(spark, d).curve())


CELLS = ("00", "01", "10", "11")  # is_weekend, second_half


def _boost_step(labels: dict[str, str], table: str = "fit") -> tuple[str, str, dict[str, str]]:
    """Which feature one split of the cells' mean labels takes, its gain, and each cell's leaf mean."""
    n = {c: f"{table}.n{c}" for c in CELLS}
    side = {}
    for j in (0, 1):
        for v in "01":
            cells = [c for c in CELLS if c[j] == v]
            side[j, v] = (f"({' + '.join(n[c] for c in cells)})", f"(({' + '.join(f'{n[c]} * {labels[c]}' for c in cells)}) / ({' + '.join(n[c] for c in cells)}))")
    gain = {j: f"({side[j, '0'][0]} * {side[j, '1'][0]} * power({side[j, '0'][1]} - {side[j, '1'][1]}, 2))" for j in (0, 1)}
    first = f"({gain[0]} >= {gain[1]})"
    rows = " + ".join(n.values())
    won = f"((CASE WHEN {first} THEN {gain[0]} ELSE {gain[1]} END) / power({rows}, 2))"
    return first, won, {c: f"(CASE WHEN {first} THEN {side[0, c[0]][1]} ELSE {side[1, c[1]][1]} END)" for c in CELLS}


def _gbt_curve_sql(importance: bool = False) -> str:
    c = CURVE_CFG
    err = lambda f: f"sqrt(({' + '.join(f'(v.q{x} - 2 * {f[x]} * v.s{x} + v.n{x} * {f[x]} * {f[x]})' for x in CELLS)}) / ({' + '.join(f'v.n{x}' for x in CELLS)}))"
    sums = ", ".join(f"CAST(count(*) FILTER (WHERE cell = '{x}') AS DOUBLE) AS n{x}, coalesce(sum(y) FILTER (WHERE cell = '{x}'), 0) AS s{x}, coalesce(sum(y * y) FILTER (WHERE cell = '{x}'), 0) AS q{x}" for x in CELLS)
    mean = {x: f"coalesce(fit.s{x} / nullif(fit.n{x}, 0), 0)" for x in CELLS}
    split0, gain0, start = _boost_step(mean)
    split, gain, leaf = _boost_step({x: f"(2 * ({mean[x]} - b.f{x}))" for x in CELLS})
    extra = LI_SPLIT + [
        ("lm", f"SELECT series_id, ts, pos, k, least(greatest({SPLIT_EXPR.format(n='k', t='0.2')}, 1), k - 1) AS kv FROM lk"),
        ("cells", "SELECT CASE WHEN pos < kv THEN 'fit' ELSE 'val' END AS part, y / 1e6 AS y, "
                  "concat(CASE WHEN isodow(ts) >= 6 THEN '1' ELSE '0' END, CASE WHEN month(ts) > 6 THEN '1' ELSE '0' END) AS cell "
                  "FROM lm JOIN lineitem_daily USING (series_id, ts) WHERE pos < k"),
        ("fit", f"SELECT {sums} FROM cells WHERE part = 'fit'"),
        ("v", f"SELECT {sums} FROM cells WHERE part = 'val'"),
    ]
    first = f"SELECT 0 AS m, {split0} AS weekend, {gain0} AS gain, {', '.join(f'{start[x]} AS f{x}' for x in CELLS)} FROM fit"
    step = f"SELECT b.m + 1 AS m, {split}, {gain}, {', '.join(f'b.f{x} + {c.step_size} * {leaf[x]} AS f{x}' for x in CELLS)} FROM b, fit WHERE b.m + 1 < {c.max_iter}"
    body = f"""SELECT m AS round, round(e, 6) AS val_rmse, m = (SELECT min(m) FROM kept WHERE e = (SELECT min(e) FROM kept)) AS is_best FROM kept"""
    ctes = [f"{n} AS ({q})" for n, q in [("lineitem_daily", SQL_FIXTURES["lineitem_daily"]), *extra]]
    ctes.append(f"b AS ({first} UNION ALL {step})")
    ctes.append(f"curve AS (SELECT m, {err({x: f'b.f{x}' for x in CELLS})} AS e FROM b, v)")
    # a round is trained while the best one before it is less than `patience` rounds back
    ctes.append("past AS (SELECT a.m, a.e, (SELECT arg_min(z.m, z.e) FROM curve z WHERE z.m < a.m) AS best FROM curve a)")
    ctes.append(f"kept AS (SELECT m, e FROM past WHERE m < coalesce((SELECT min(m) FROM past WHERE m - 1 - best >= {c.patience}), {c.max_iter}))")
    if importance:  # splits of the kept trees
        body = """SELECT feature, CAST(count(m) AS BIGINT) AS weight, round(coalesce(avg(gain), 0), 6) AS gain
FROM (VALUES ('is_weekend', true), ('second_half', false)) names(feature, weekend)
LEFT JOIN (SELECT * FROM b WHERE m <= (SELECT arg_min(m, e) FROM kept)) k USING (weekend) GROUP BY feature"""
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


LI_SPLIT = [
    (
        "ls",
        "SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM lineitem_daily",
    ),
    ("lk", f"SELECT *, {_k(0.2)} AS k FROM ls"),
]
LI_FEAT = [
    (
        "lf0",
        f"SELECT series_id, ts, y, x_qty, x_disc, {CAL_SQL}, lag(y, 1) OVER w AS y_lag_1, lag(y, 7) OVER w AS y_lag_7 "
        "FROM lineitem_daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)",
    ),
    (
        "lf1",
        "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n "
        "FROM lf0 WHERE y_lag_1 IS NOT NULL AND y_lag_7 IS NOT NULL",
    ),
    ("lf", f"SELECT *, CASE WHEN pos < {_k(0.2)} THEN 'train' ELSE 'test' END AS split FROM lf1"),
]


def _params_cte(kind: str) -> tuple[str, str]:
    parts = []
    for c in SCALE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        if kind == "standard":
            center, sc = f"avg({x})", f"stddev_pop({x})"
        else:
            center, sc = f"min({x})", f"max({x}) - min({x})"
        parts.append(
            f"SELECT series_id, '{c}' AS \"column\", {center} AS center, CASE WHEN {sc} < 10 * {EPS} THEN CAST(1.0 AS DOUBLE) ELSE {sc} END AS scale "
            f"FROM lf WHERE split = 'train' GROUP BY series_id"
        )
    return ("params", " UNION ALL ".join(parts))


def _apply_sql(kind: str) -> str:
    cols = ", ".join(
        f"round((CAST(lf.{c} AS DOUBLE) - (SELECT center FROM params p WHERE p.series_id = lf.series_id AND p.\"column\" = '{c}')) / "
        f"(SELECT scale FROM params p WHERE p.series_id = lf.series_id AND p.\"column\" = '{c}'), 6) AS {c}"
        for c in SCALE_COLS
    )
    return with_fixtures(f"SELECT series_id, ts, split, {cols} FROM lf", "lineitem_daily", extra=LI_FEAT + [_params_cte(kind)])


SQL_SCALE = {
    "split_train_test": with_fixtures("SELECT series_id, ts, CASE WHEN pos < k THEN 'train' ELSE 'test' END AS split FROM lk", "lineitem_daily", extra=LI_SPLIT),
    "split_fit_val_test": with_fixtures(
        "SELECT series_id, ts, CASE WHEN pos >= k THEN 'test' WHEN pos < least(greatest("
        + SPLIT_EXPR.format(n="k", t="0.2")
        + ", 1), k - 1) THEN 'fit' ELSE 'val' END AS split FROM lk",
        "lineitem_daily",
        extra=LI_SPLIT,
    ),
    "scaler_standard_params": with_fixtures(
        "SELECT series_id, \"column\", round(center, 4) AS center, round(scale, 4) AS scale FROM params", "lineitem_daily", extra=LI_FEAT + [_params_cte("standard")]
    ),
    "scaler_standard_apply": _apply_sql("standard"),
    "scaler_minmax_apply": _apply_sql("minmax"),
    "scaler_inverse": with_fixtures(
        "SELECT series_id, ts, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in SCALE_COLS) + " FROM lf", "lineitem_daily", extra=LI_FEAT
    ),
}

QUERIES.update(
    {
        "split_train_test": q_split_train_test,
        "split_fit_val_test": q_split_fit_val_test,
        "scaler_standard_params": q_scaler_standard_params,
        "scaler_standard_apply": q_scaler_standard_apply,
        "scaler_minmax_apply": q_scaler_minmax_apply,
        "scaler_inverse": q_scaler_inverse,
        "gbt_predict": q_gbt_predict,
        "gbt_importance": q_gbt_importance,
        "gbt_curve": q_gbt_curve,
    }
)
ORACLE_SQL.update(SQL_SCALE)


# ----------------------------------------------------------------------------- charts, sinks, end to end

DIRTY_SCHEMA = "event_id BIGINT, ts_raw STRING, value_raw STRING, series_id STRING"


def q_plot_frame(spark, d):
    return rounded(charts.plot_frame(_blended(spark, d), ["y_true", "pred_a", "hybrid_pred"], max_points=40))


def q_plot_frame_bands(spark, d):
    return rounded(charts.plot_frame(_blended(spark, d), ["y_true", "pred_b"], max_points=40, bands=True))


def q_land_roundtrip(spark, d):
    src = scratch_path(spark, "raw-csv")
    fx.events_dirty(spark, d).write.option("header", True).csv(src)
    dst = files.land_csv(spark, src, scratch_path(spark, "landed"), schema=DIRTY_SCHEMA)
    files.land_csv(spark, src, dst, schema=DIRTY_SCHEMA)  # second run is a no-op
    return files.read_series(spark, dst).drop(files.INPUT_ORDER)


def q_land_stream_roundtrip(spark, d):
    """Two batches of files in two calls: the second lands exactly the new ones."""
    src, dst = scratch_path(spark, "raw-csv"), scratch_path(spark, "landed-stream")
    rows = fx.events_dirty(spark, d)
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        rows.filter(part).write.mode("append").option("header", True).csv(src)
        land_stream(spark, src, dst, DIRTY_SCHEMA)
    return spark.read.parquet(dst)


def q_write_metrics(spark, d):
    path = sinks.write_metrics(metrics.forecast_metrics(_blended(spark, d), PREDS), scratch_path(spark, "metrics"))
    back = spark.read.schema("metric STRING, value DOUBLE, model STRING").json(path)
    return rounded(back.select("model", "metric", "value"))


def q_write_comparison(spark, d):
    path = sinks.write_comparison(metrics.compare_models(metrics.forecast_metrics(_blended(spark, d), PREDS)), scratch_path(spark, "comparison"))
    back = spark.read.option("header", True).schema("model STRING, mse DOUBLE, rmse DOUBLE, mae DOUBLE, mape DOUBLE, r2 DOUBLE").csv(path)
    return rounded(back)


def q_flagship(spark, d):
    return rounded(flagship_plan.flagship(spark, d))


PIPE_CFG = ForecastConfig(
    max_lag=14, seasonal_anchors=(1, 7, 28), rolling_candidates=(3, 7, 14), max_iter=12, patience=3, max_depth=4, step_size=0.1, min_info_gain=0.0,
    context_length=364, prediction_length=28, season_length=28,
)


def q_end_to_end(spark, d):
    out = run_end_to_end(fx.lineitem_daily(spark, d), PIPE_CFG)
    return out["comparison"]


def q_tabular_dataset(spark, d):
    ds, _, _ = _tab(spark, d)
    return rounded(ds)


def _plot_sql(lines, bands: bool) -> str:
    names = list(lines) + (["low", "high"] if bands else [])
    stacked = " UNION ALL ".join(f"SELECT series_id, ts, '{n}' AS line, CAST({n} AS DOUBLE) AS v FROM bl" for n in names)
    extra = EVAL_CTES + [
        ("bd", "SELECT series_id, min(ts) AS t0, max(ts) AS t1 FROM bl GROUP BY series_id"),
        ("st", stacked),
        (
            "bk",
            "SELECT st.*, CAST(floor(CAST(epoch_us(st.ts) - epoch_us(bd.t0) AS DOUBLE) * 40.0 / (CAST(epoch_us(bd.t1) - epoch_us(bd.t0) AS DOUBLE) + 1.0)) AS BIGINT) AS bucket "
            "FROM st JOIN bd USING (series_id)",
        ),
    ]
    body = (
        "SELECT series_id, bucket, line, min(ts) AS ts, round(avg(v), 6) AS value, round(min(v), 6) AS v_min, round(max(v), 6) AS v_max, "
        "min({'v': v, 't': ts}).t AS ts_min, min({'v': -v, 't': ts}).t AS ts_max FROM bk GROUP BY series_id, bucket, line"
    )
    return with_fixtures(body, "events_hourly_by_type", extra=extra)


def _metric_rows_sql(table: str, preds: dict) -> str:
    parts = []
    for model, col in preds.items():
        cols = ", ".join(f"round(CAST({_metric_sql(col, m)} AS DOUBLE), 6) AS {m}" for m in metrics.PREFERRED)
        parts.append(f"SELECT '{model}' AS model, {cols} FROM {table}")
    return " UNION ALL ".join(parts)


FLAGSHIP_CTES = [
    ("hh", "SELECT 'all' AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS y FROM events GROUP BY 2"),
    (
        "ff",
        "SELECT series_id, ts, y, lag(y, 1) OVER w AS pred_a, lag(y, 24) OVER w AS pred_b, row_number() OVER w - 1 AS pos, "
        "count(*) OVER (PARTITION BY series_id) AS n FROM hh WINDOW w AS (PARTITION BY series_id ORDER BY ts)",
    ),
    ("sc", f"SELECT series_id, ts, y AS y_true, pred_a, pred_b FROM ff WHERE pos >= {_k(0.2)} AND pred_a IS NOT NULL AND pred_b IS NOT NULL"),
    ("gg", "SELECT CASE WHEN i = 100 THEN CAST(1.0 AS DOUBLE) ELSE i * (CAST(1.0 AS DOUBLE) / 100) END AS w FROM range(0, 101) t(i)"),
    (
        "best",
        "SELECT w FROM (SELECT gg.w, sqrt(avg(power(y_true - (gg.w * pred_a + (1 - gg.w) * pred_b), 2))) AS rmse FROM sc, gg GROUP BY gg.w) "
        "ORDER BY rmse, w LIMIT 1",
    ),
    ("fb", "SELECT sc.*, best.w * pred_a + (CAST(1.0 AS DOUBLE) - best.w) * pred_b AS hybrid_pred FROM sc, best"),
]

SQL_MISC = {
    "plot_frame": _plot_sql(["y_true", "pred_a", "hybrid_pred"], False),
    "plot_frame_bands": _plot_sql(["y_true", "pred_b"], True),
    "land_roundtrip": with_fixtures("SELECT * FROM events_dirty", "events_dirty"),
    "land_stream_roundtrip": with_fixtures("SELECT * FROM events_dirty", "events_dirty"),
    "write_metrics": _metrics_sql(list(metrics.PREFERRED)),
    "write_comparison": _compare_sql(),
    "flagship": "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in FLAGSHIP_CTES) + "\n"
    + _metric_rows_sql("fb", {"naive": "pred_a", "seasonal_naive": "pred_b", "hybrid": "hybrid_pred"}),
}

ORACLE_SQL["gbt_curve"] = _gbt_curve_sql()

QUERIES.update(
    {
        "plot_frame": q_plot_frame,
        "plot_frame_bands": q_plot_frame_bands,
        "land_roundtrip": q_land_roundtrip,
        "land_stream_roundtrip": q_land_stream_roundtrip,
        "write_metrics": q_write_metrics,
        "write_comparison": q_write_comparison,
        "flagship": q_flagship,
        "tabular_dataset": q_tabular_dataset,
        "end_to_end": q_end_to_end,
    }
)
ORACLE_SQL.update(SQL_MISC)


# ----------------------------------------------------------------------------- block-layout variants
BLOCKS = ForecastConfig(layout="blocks")


def q_clean_series_blocks(spark, d):
    raw = fx.events_dirty(spark, d)
    out = clean.clean_series(raw, BLOCKS, value_cols=["value_raw"], time_raw="ts_raw", tie_break=["event_id"])
    return rounded(out.withColumnRenamed("value_raw", "y"))


def q_context_windows_blocks(spark, d):
    return summarize_windows(windows.context_windows(fx.events_30min(spark, d), BLOCKS.with_(on_short="skip")))


def q_position_blocks(spark, d):
    return features.with_position(fx.user_events(spark, d), layout="blocks").drop("y")


def q_split_train_test_blocks(spark, d):
    return split.split_chrono(fx.lineitem_daily(spark, d), 0.2, cfg=BLOCKS).select("series_id", "ts", "split")


QUERIES.update(
    {
        "clean_series_blocks": q_clean_series_blocks,
        "context_windows_blocks": q_context_windows_blocks,
        "position_blocks": q_position_blocks,
        "split_train_test_blocks": q_split_train_test_blocks,
    }
)
ORACLE_SQL.update(
    {
        "clean_series_blocks": ORACLE_SQL["clean_series"],
        "context_windows_blocks": ORACLE_SQL["context_windows"],
        "position_blocks": ORACLE_SQL["position"],
        "split_train_test_blocks": ORACLE_SQL["split_train_test"],
    }
)


def _tabular_sql(cfg: ForecastConfig, shown: str = "round({}, 6)") -> str:
    steps = features.lag_steps(cfg.max_lag, cfg.seasonal_anchors)
    widths = features.rolling_windows(cfg.max_lag, cfg.rolling_candidates)
    cal = ["hour", "day_of_week", "month", "quarter", "day_of_year", "is_weekend"]
    lag_cols = [f"y_lag_{k}" for k in steps]
    roll_cols = [f"y_roll_{kind}_{w}" for w in widths for kind in ("mean", "std")]
    feat_cols = ["x_qty", "x_disc"] + cal + lag_cols + roll_cols
    all_cols = ["y"] + feat_cols
    f0 = "SELECT series_id, ts, y, x_qty, x_disc, " + ", ".join([CAL_SQL] + lag_sql("y", steps, rnd=False) + rolling_sql("y", widths, rnd=False)) + " FROM lineitem_daily"
    f1 = "SELECT * FROM f0 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in all_cols)
    f2 = "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM f1"
    kf = "least(greatest(" + SPLIT_EXPR.format(n="k", t=repr(cfg.validation_ratio)) + ", 1), k - 1)"
    f3 = f"SELECT *, CASE WHEN pos >= k THEN 'test' WHEN pos < {kf} THEN 'fit' ELSE 'val' END AS split FROM (SELECT *, {_k(cfg.test_size)} AS k FROM f2)"
    pw = "SELECT series_id, " + ", ".join(
        f"avg(CAST({c} AS DOUBLE)) AS c__{c}, CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) < 10 * {EPS} THEN CAST(1.0 AS DOUBLE) ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS s__{c}"
        for c in all_cols
    ) + " FROM f3 WHERE split <> 'test' GROUP BY series_id"
    body = (
        "SELECT f3.series_id, ts, split, round(y, 6) AS y_raw, "
        + ", ".join(f"{shown.format(f'(CAST(f3.{c} AS DOUBLE) - c__{c}) / s__{c}')} AS {c}" for c in all_cols)
        + " FROM f3 JOIN pw USING (series_id)"
    )
    return with_fixtures(body, "lineitem_daily", extra=[("f0", f0), ("f1", f1), ("f2", f2), ("f3", f3), ("pw", pw)])


ORACLE_SQL["tabular_dataset"] = _tabular_sql(TAB_CFG)


def q_align_tail_fallback_blocks(spark, d):
    out = align.align_forecasts(_side_a(spark, d), _side_b(spark, d, 30), cfg=BLOCKS).withColumn("y_true", F.col("y_true_b"))
    return rounded(out)


QUERIES["align_tail_fallback_blocks"] = q_align_tail_fallback_blocks
ORACLE_SQL["align_tail_fallback_blocks"] = ORACLE_SQL["align_tail_fallback"]


MANY_CFG = ForecastConfig(context_length=20, prediction_length=5, stride=5, on_short="skip")


def q_context_windows_many(spark, d):
    return summarize_windows(windows.context_windows(fx.user_events(spark, d).drop("event_id"), MANY_CFG))


QUERIES["context_windows_many"] = q_context_windows_many
ORACLE_SQL["context_windows_many"] = _windows_summary_sql("user_events", 20, 5, 5)


def q_probabilistic_eval(spark, d):
    """Probabilistic branch end to end: test windows -> analog paths -> bands -> metrics of the
    median (and of the band edges) against the truth."""
    w = windows.context_windows(fx.events_30min(spark, d), WIN30, phases=("test",))
    bands = probabilistic.prediction_bands(probabilistic.sample_paths(w, WIN30), WIN30.confidence)
    return rounded(metrics.forecast_metrics(bands, {"median": "median", "low": "low", "high": "high"}, y="y"))


def _prob_eval_sql() -> str:
    parts = []
    for model in ("median", "low", "high"):
        for m in metrics.PREFERRED:
            expr = _metric_sql(model, m).replace("y_true", "y")
            parts.append(f"SELECT '{model}' AS model, '{m}' AS metric, round(CAST({expr} AS DOUBLE), 6) AS value FROM bands_t")
    bands_t = BANDS_SQL.replace("round(s.y, 6) AS y", "s.y AS y").replace("round(b.med, 6) AS median, round(b.lo, 6) AS low, round(b.hi, 6) AS high", "b.med AS median, b.lo AS low, b.hi AS high")
    return with_fixtures(
        " UNION ALL ".join(parts),
        "events_30min",
        extra=_windows_ctes("events_30min", 1024, 24, 24) + [("samples", SAMPLES_SQL), ("bands_t", f"SELECT * FROM ({bands_t}) WHERE split = 'test'")],
    )


QUERIES["probabilistic_eval"] = q_probabilistic_eval
ORACLE_SQL["probabilistic_eval"] = _prob_eval_sql()


def q_clean_series_causal(spark, d):
    raw = fx.events_dirty(spark, d)
    out = clean.clean_series(raw, ForecastConfig(), value_cols=["value_raw"], time_raw="ts_raw", tie_break=["event_id"], fill="causal")
    return rounded(out.withColumnRenamed("value_raw", "y"))


CAUSAL_SQL = (
    "SELECT series_id, ts, coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS y FROM coerced"
)
QUERIES["clean_series_causal"] = q_clean_series_causal
ORACLE_SQL["clean_series_causal"] = with_fixtures(
    "SELECT series_id, ts, round(y, 6) AS y FROM ffilled WHERE y IS NOT NULL", "events_dirty", extra=CLEAN_CHAIN + [("ffilled", CAUSAL_SQL)]
)


def q_truncate_context(spark, d):
    return summarize_windows(windows.truncate_context(_win30(spark, d), 512))


ORACLE_SQL["truncate_context"] = with_fixtures(
    """SELECT series_id, CAST(e AS BIGINT) AS window_id, split,
  CAST(count(*) FILTER (WHERE pos < e AND pos >= e - 512) AS BIGINT) AS ctx_len,
  round(arg_min(y, pos) FILTER (WHERE pos < e AND pos >= e - 512), 6) AS ctx_first,
  round(arg_max(y, pos) FILTER (WHERE pos < e), 6) AS ctx_last,
  round(sum(y) FILTER (WHERE pos < e AND pos >= e - 512), 2) AS ctx_sum,
  CAST(count(*) FILTER (WHERE pos >= e) AS BIGINT) AS h_len,
  min(ts) FILTER (WHERE pos >= e) AS h_first_ts,
  max(ts) FILTER (WHERE pos >= e) AS h_last_ts,
  round(sum(y) FILTER (WHERE pos >= e), 2) AS h_sum
FROM pts GROUP BY series_id, e, split""",
    "events_30min",
    extra=_windows_ctes("events_30min", 1024, 24, 24),
)
QUERIES["truncate_context"] = q_truncate_context


# ----------------------------------------------------------------------------- refusals, layouts, input order
def q_series_status(spark, d):
    """Every user's series: how many windows it gives, or why none."""
    return windows.series_status(fx.user_events(spark, d), MANY_CFG)


QUERIES["series_status"] = q_series_status
ORACLE_SQL["series_status"] = with_fixtures(
    f"""SELECT series_id, n AS "rows", CASE WHEN status = 'ok' THEN (cut - 20 - 5) // 5 + 1 ELSE 0 END AS train_windows,
  CASE WHEN status = 'ok' THEN (n - cut - 5) // 5 + 1 ELSE 0 END AS test_windows, status
FROM (SELECT *, CASE WHEN n < 3 THEN 'fewer than three rows' WHEN cut < 25 OR n - cut < 5 THEN 'too short for windows' ELSE 'ok' END AS status
  FROM (SELECT series_id, n, least(greatest({SPLIT_EXPR.format(n="n", t="0.2")}, 25), n - 1) AS cut FROM (SELECT series_id, count(*) AS n FROM user_events GROUP BY 1)))""",
    "user_events",
)


def q_metrics_common_rows(spark, d):
    """Two forecasts with gaps of their own: both are scored, and the blend is tuned, on shared rows."""
    both = fx.events_hourly_by_type(spark, d)
    both = features.add_lags(both, [1, 24]).withColumn("y_true", F.col("y"))
    scored = metrics.forecast_metrics(both, {"naive": "y_lag_1", "seasonal": "y_lag_24"}, by=["series_id"], metrics=("rmse", "mae", "n"))
    tuned = align.tune_blend(both, a="y_lag_1", b="y_lag_24", by=["series_id"])
    more = tuned.select("series_id", F.lit("blend").alias("model"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("weight", "rmse")])))
    return rounded(scored.unionByName(more))


_COMMON = [
    ("al", "SELECT * FROM (SELECT series_id, y AS y_true, lag(y, 1) OVER w AS pred_a, lag(y, 24) OVER w AS pred_b FROM events_hourly_by_type WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE pred_b IS NOT NULL")
]


def _common_rows_sql() -> str:
    parts = [
        f"SELECT series_id, '{model}' AS model, '{m}' AS metric, round(CAST({'count(*)' if m == 'n' else _metric_sql(col, m)} AS DOUBLE), 6) AS value FROM al GROUP BY series_id"
        for model, col in (("naive", "pred_a"), ("seasonal", "pred_b"))
        for m in ("rmse", "mae", "n")
    ]
    tuned = (
        "SELECT series_id, w AS weight, rmse FROM (SELECT series_id, g.w, sqrt(avg(power(y_true - (g.w * pred_a + (1 - g.w) * pred_b), 2))) AS rmse FROM al, "
        "(SELECT CASE WHEN i = 100 THEN CAST(1.0 AS DOUBLE) ELSE i * (CAST(1.0 AS DOUBLE) / 100) END AS w FROM range(0, 101) t(i)) g GROUP BY series_id, g.w) "
        "QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rmse, w) = 1"
    )
    parts += [f"SELECT series_id, 'blend' AS model, '{c}' AS metric, round({c}, 6) AS value FROM tuned" for c in ("weight", "rmse")]
    return with_fixtures(" UNION ALL ".join(parts), "events_hourly_by_type", extra=[*_COMMON, ("tuned", tuned)])


QUERIES["metrics_common_rows"] = q_metrics_common_rows
ORACLE_SQL["metrics_common_rows"] = _common_rows_sql()


def q_dedup_input_order(spark, d):
    """Landed from text files that hold the events by id: of equal stamps the last line counts."""
    src = scratch_path(spark, "raw-csv")
    rows = fx.events_dirty(spark, d)
    rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.option("header", True).csv(src)
    landed = files.read_series(spark, files.land_csv(spark, src, scratch_path(spark, "landed"), schema=DIRTY_SCHEMA))
    parsed = clean.parse_ts(landed, "ts_raw", out="ts", on_unparsed="error")
    return clean.dedup_last(parsed, ["series_id", "ts"], [files.INPUT_ORDER]).select("series_id", "ts", "event_id", "value_raw")


QUERIES["dedup_input_order"] = q_dedup_input_order
ORACLE_SQL["dedup_input_order"] = ORACLE_SQL["dedup_last"]


def q_interpolate_time_blocks(spark, d):
    return rounded(clean.interpolate_time(_coerced(spark, d), ["y"], cfg=BLOCKS))


def q_fill_edges_blocks(spark, d):
    return rounded(clean.fill_edges(_coerced(spark, d), ["y"], cfg=BLOCKS))


QUERIES.update({"interpolate_time_blocks": q_interpolate_time_blocks, "fill_edges_blocks": q_fill_edges_blocks})
ORACLE_SQL.update({"interpolate_time_blocks": ORACLE_SQL["interpolate_time"], "fill_edges_blocks": ORACLE_SQL["fill_edges"]})

ODD_CFG = ForecastConfig(max_lag=3, seasonal_anchors=(1,), rolling_candidates=(3,))


def _odd_values(spark, d, layout: str):
    """Features over a target with NaN and NULL, beside a BIGINT beyond 2**53 with NULLs."""
    eid = F.col("event_id")
    rows = fx.user_events(spark, d).select(
        "series_id",
        "ts",
        F.when(eid % 11 == 0, F.lit(float("nan"))).when(eid % 13 != 0, F.col("y")).alias("y"),
        F.when(eid % 7 != 0, eid + 9_007_199_254_740_993).alias("big"),
    )
    out = features.build_features(rows, ODD_CFG.with_(layout=layout, block_rows=64), drop_nulls=False)
    odd = [F.col(c).isNull().alias(f"{n}_null") for n, c in (("lag", "y_lag_1"), ("mean", "y_roll_mean_3"))]
    odd += [F.coalesce(F.isnan(c), F.lit(False)).alias(f"{n}_nan") for n, c in (("lag", "y_lag_1"), ("mean", "y_roll_mean_3"))]
    return rounded(out.select("series_id", "ts", "big", *odd, F.when(~F.isnan("y_lag_1"), F.col("y_lag_1")).alias("lag")))


def q_odd_values(spark, d):
    return _odd_values(spark, d, "series")


def q_odd_values_blocks(spark, d):
    return _odd_values(spark, d, "blocks")


QUERIES.update({"odd_values": q_odd_values, "odd_values_blocks": q_odd_values_blocks})
ORACLE_SQL["odd_values"] = ORACLE_SQL["odd_values_blocks"] = with_fixtures(
    """SELECT series_id, ts, big, l IS NULL AS lag_null, coalesce(isnan(l), false) AS lag_nan, (known < 3) AS mean_null, (known = 3 AND nans > 0) AS mean_nan,
  round(CASE WHEN NOT isnan(l) THEN l END, 6) AS lag
FROM (SELECT *, lag(y) OVER w AS l, count(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS known,
    count(*) FILTER (WHERE isnan(y)) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS nans
  FROM (SELECT series_id, ts, CASE WHEN event_id % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 13 <> 0 THEN y END AS y,
      CASE WHEN event_id % 7 <> 0 THEN event_id + 9007199254740993 END AS big FROM user_events)
  WINDOW w AS (PARTITION BY series_id ORDER BY ts))""",
    "user_events",
)


def q_sample_paths_ragged(spark, d):
    """Contexts of different lengths through the plugin: each keeps all the samples it allows."""
    cut = F.slice("ctx", F.lit(1), (F.size("ctx") - F.pmod("window_id", F.lit(1000))).cast("int"))
    ragged = _win30(spark, d).withColumn("ctx", cut)
    paths = probabilistic.sample_paths(ragged, WIN30, method="plugin", fn=probabilistic.seasonal_analog_plugin(48))
    return paths.select("series_id", "window_id", "split", F.size("samples").cast("bigint").alias("n_samples"), F.round(F.get(F.get(F.col("samples"), F.size("samples") - 1), 0), 6).alias("oldest"))


QUERIES["sample_paths_ragged"] = q_sample_paths_ragged
ORACLE_SQL["sample_paths_ragged"] = with_fixtures(
    """SELECT r.series_id, CAST(r.e AS BIGINT) AS window_id, r.split, CAST(r.j AS BIGINT) AS n_samples, round(s.y, 6) AS oldest
FROM (SELECT *, CAST(least(32, (1024 - e % 1000) // 48) AS BIGINT) AS j, e - e % 1000 AS stop FROM win) r
LEFT JOIN s ON s.series_id = r.series_id AND r.j > 0 AND s.pos = r.stop - r.j * 48""",
    "events_30min",
    extra=_windows_ctes("events_30min", 1024, 24, 24)[:4],
)

_M = probabilistic.DRAW_MODULUS
BOOT_SQL = f"""SELECT w.series_id, w.e, w.split, h.h AS step, a.y + b.y - c.y AS value
FROM (SELECT *, {{first}} AS k FROM win) w, range(1, {WIN30.num_samples + 1}) j(j), range(0, {WIN30.prediction_length}) h(h),
  LATERAL (SELECT (w.k + w.e * 7919 + j.j * 104729 + h.h * 1299709 + {WIN30.seed} * 15485863) % {_M} AS m) x1,
  LATERAL (SELECT (((x1.m * x1.m + 12345) % {_M}) * 48271) % {_M} AS t) x2,
  LATERAL (SELECT {WIN30.season_length} + ((x2.t * x2.t + x1.m) % {_M}) % {WIN30.context_length - WIN30.season_length} AS p) x3,
  s a, s b, s c
WHERE a.series_id = w.series_id AND a.pos = w.e - {WIN30.season_length} + h.h % {WIN30.season_length}
  AND b.series_id = w.series_id AND b.pos = w.e - {WIN30.context_length} + x3.p
  AND c.series_id = w.series_id AND c.pos = w.e - {WIN30.context_length} + x3.p - {WIN30.season_length}""".format(first="CAST('0x' || substr(md5(series_id), 1, 7) AS BIGINT)")
ORACLE_SQL["sample_paths_bootstrap"] = with_fixtures(BANDS_SQL, "events_30min", extra=_windows_ctes("events_30min", 1024, 24, 24)[:4] + [("samples", BOOT_SQL)])


def q_gbt_predict_rows(spark, d):
    """The exact part of the tree predictions: their rows, truth, and that each has one."""
    out = q_gbt_predict(spark, d)
    return rounded(out.select("series_id", "ts", "y_true", (F.col("prediction").isNotNull() & ~F.isnan("prediction")).alias("predicted")))


QUERIES["gbt_predict_rows"] = q_gbt_predict_rows
ORACLE_SQL["gbt_predict_rows"] = f"SELECT series_id, ts, y_raw AS y_true, true AS predicted FROM ({ORACLE_SQL['tabular_dataset']}) WHERE split = 'test'"


def q_end_to_end_aligned(spark, d):
    """The exact part of the pipeline's aligned frame: rows, both truths, median and bands."""
    out = run_end_to_end(fx.lineitem_daily(spark, d), PIPE_CFG)["aligned"]
    return rounded(out.select("series_id", "ts", "y_true_a", "y_true_b", "pred_b", "low", "high"))


def _aligned_sql() -> str:
    C, H, S = PIPE_CFG.context_length, PIPE_CFG.prediction_length, PIPE_CFG.season_length
    n_paths = min(PIPE_CFG.num_samples, C // S)
    samples = (
        f"SELECT w.series_id, w.e, h.h AS step, s.y AS value FROM win w, range(1, {n_paths + 1}) j(j), range(0, {H}) h(h), s "
        f"WHERE w.split = 'test' AND s.series_id = w.series_id AND s.pos = w.e - j.j * {S} + (h.h % {S})"
    )
    bands = (
        "SELECT b.series_id, s.ts, s.y, b.med, b.lo, b.hi FROM (SELECT series_id, e, step, list_sort(list(value))[CAST((count(*) - 1) // 2 AS BIGINT) + 1] AS med, "
        f"quantile_cont(value, {_LOQ!r}) AS lo, quantile_cont(value, {_HIQ!r}) AS hi FROM samples GROUP BY ALL) b JOIN s ON s.series_id = b.series_id AND s.pos = b.e + b.step"
    )
    body = (
        f"SELECT series_id, ts, y_raw AS y_true_a, round(bands.y, 6) AS y_true_b, round(med, 6) AS pred_b, round(lo, 6) AS low, round(hi, 6) AS high "
        f"FROM bands JOIN ({ORACLE_SQL['tabular_dataset']}) t USING (series_id, ts) WHERE t.split = 'test'"
    )
    return with_fixtures(body, "lineitem_daily", extra=[*_windows_ctes("lineitem_daily", C, H, H)[:4], ("samples", samples), ("bands", bands)])


QUERIES["end_to_end_aligned"] = q_end_to_end_aligned
ORACLE_SQL["end_to_end_aligned"] = _aligned_sql()


# ----------------------------------------------------------------------------- bands in long form, as-of alignment


def q_prediction_bands_long(spark, d):
    """The bands again, from one row per window, step and sample."""
    return rounded(probabilistic.prediction_bands_long(probabilistic.sample_rows(_paths(spark, d))).withColumn("step", F.col("step").cast("int")))


SKETCH_K = 800


def q_band_sketch_error(spark, d):
    """Are quantiles of all events of a type, from merged sketches of parts, within the stated error?"""
    rows = fx.table(spark, d, "events").select("event_type", F.hour("ts").alias("hour"), "value")
    merged = probabilistic.merge_sketches(probabilistic.band_sketches(rows, ["event_type", "hour"], SKETCH_K), ["event_type"])
    bands = probabilistic.bands_from_sketches(merged, 0.9)
    cols = {"median": 0.5, "low": 0.05, "high": 0.95}
    below = [F.avg((F.col("value") < F.col(c)).cast("double")).alias(f"{c}_below") for c in cols]
    to = [F.avg((F.col("value") <= F.col(c)).cast("double")).alias(f"{c}_to") for c in cols]
    ranks = rows.join(bands, "event_type").groupBy("event_type").agg(F.max("n").alias("n"), *below, *to)
    error = 2 * probabilistic.sketch_error(SKETCH_K)  # twice the bound of 99 %, which is all but never passed
    fits = [((F.col(f"{c}_below") <= q + error) & (F.col(f"{c}_to") >= q - error)).alias(c) for c, q in cols.items()]
    return ranks.select("event_type", F.col("n").cast("bigint").alias("n"), *fits)


ASOF_COLS = "series_id, ts, round(y_true_a, 6) AS y_true_a, round(pred_a, 6) AS pred_a, round(y_true_b, 6) AS y_true_b, round(pred_b, 6) AS pred_b, ts_b"


def _asof(spark, d, cfg=None):
    b = _side_b(spark, d, shift_minutes=17).drop("low", "high").filter(F.hour("ts") % 5 != 0)
    return rounded(asof.align_asof(_side_a(spark, d), b, timedelta(minutes=50), cfg=cfg))


def q_align_asof(spark, d):
    return _asof(spark, d)


def q_align_asof_blocks(spark, d):
    return _asof(spark, d, BLOCKS)


_ASOF_SQL = with_fixtures(
    f"SELECT {ASOF_COLS} FROM m",
    "events_hourly_by_type",
    extra=EVAL_CTES[:3]
    + [
        ("bs", "SELECT series_id, ts + INTERVAL 17 MINUTE AS ts, y_true_b, pred_b FROM b"),
        ("bh", "SELECT * FROM bs WHERE hour(ts) % 5 <> 0"),
        ("j", "SELECT a.*, bh.y_true_b, bh.pred_b, bh.ts AS ts_b FROM a ASOF LEFT JOIN bh ON a.series_id = bh.series_id AND a.ts >= bh.ts"),
        ("m", "SELECT series_id, ts, y_true_a, pred_a, " + ", ".join(f"CASE WHEN ts - ts_b <= INTERVAL 50 MINUTE THEN {c} END AS {c}" for c in ("y_true_b", "pred_b", "ts_b")) + " FROM j"),
    ],
)
QUERIES.update(
    {
        "prediction_bands_long": q_prediction_bands_long,
        "band_sketch_error": q_band_sketch_error,
        "align_asof": q_align_asof,
        "align_asof_blocks": q_align_asof_blocks,
    }
)
ORACLE_SQL.update(
    {
        "prediction_bands_long": ORACLE_SQL["prediction_bands"],
        "band_sketch_error": "SELECT event_type, count(value) AS n, true AS median, true AS low, true AS high FROM events GROUP BY event_type",
        "align_asof": _ASOF_SQL,
        "align_asof_blocks": _ASOF_SQL,
    }
)


# ----------------------------------------------------------------------------- metrics by level, outages

LEVELS = [["daypart", "series_id"], ["daypart"], ["series_id"], []]
LEVEL_PREDS = {"a": "pred_a", "b": "pred_b", "hybrid": "hybrid_pred"}


def q_metrics_hierarchy(spark, d):
    """Metrics by part of the day and series, each alone, and in all: one aggregate."""
    rows = _blended(spark, d).withColumn("daypart", F.when(F.hour("ts") < 12, "am").otherwise("pm"))
    out = metrics.metrics_hierarchy(rows, LEVEL_PREDS, LEVELS, metrics=[*metrics.PREFERRED, "n"])
    return rounded(out)


def _hierarchy_sql() -> str:
    parts = []
    for i, level in enumerate(LEVELS):
        keys = ", ".join(f"{c if c in level else 'CAST(NULL AS VARCHAR)'} AS {c}" for c in ("daypart", "series_id"))
        group = f" GROUP BY {', '.join(level)}" if level else ""
        for model, col in LEVEL_PREDS.items():
            for m in (*metrics.PREFERRED, "n"):
                value = "CAST(count(*) AS DOUBLE)" if m == "n" else f"round(CAST({_metric_sql(col, m)} AS DOUBLE), 6)"
                parts.append(f"SELECT {keys}, {i} AS level, '{model}' AS model, '{m}' AS metric, {value} AS value FROM dp{group}")
    extra = EVAL_CTES + [("dp", "SELECT *, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS daypart FROM bl")]
    return with_fixtures(" UNION ALL ".join(parts), "events_hourly_by_type", extra=extra)


GAP = timedelta(hours=3)


def _outage(spark, d, cfg=None):
    return rounded(clean.interpolate_time(_coerced(spark, d), ["y"], max_gap=GAP, cfg=cfg))


def q_interpolate_outages(spark, d):
    return _outage(spark, d)


def q_interpolate_outages_blocks(spark, d):
    return _outage(spark, d, BLOCKS)


def _segments(spark, d, cfg=None):
    known = _coerced(spark, d).filter("y IS NOT NULL")
    return clean.outage_segments(known, GAP, cfg=cfg).select("series_id", "ts", "segment")


def q_outage_segments(spark, d):
    return _segments(spark, d)


def q_outage_segments_blocks(spark, d):
    return _segments(spark, d, BLOCKS)


_OUTAGE = INTERP_SQL.replace(
    "WHEN y IS NOT NULL THEN y",
    "WHEN y IS NOT NULL THEN y WHEN coalesce(epoch_us(nt) - epoch_us(pt), epoch_us(ts) - epoch_us(pt), epoch_us(nt) - epoch_us(ts)) > 10800000000 THEN NULL",
)
_OUTAGE_SQL = with_fixtures("SELECT series_id, ts, round(y, 6) AS y FROM interp", "events_dirty", extra=CLEAN_CHAIN + [("interp", _OUTAGE)])
_SEGMENT_SQL = with_fixtures(
    "SELECT series_id, ts, CAST(sum(starts) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment "
    "FROM (SELECT series_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) > 10800000000 THEN 1 ELSE 0 END AS starts FROM coerced WHERE y IS NOT NULL)",
    "events_dirty",
    extra=CLEAN_CHAIN,
)
QUERIES.update(
    {
        "metrics_hierarchy": q_metrics_hierarchy,
        "interpolate_outages": q_interpolate_outages,
        "interpolate_outages_blocks": q_interpolate_outages_blocks,
        "outage_segments": q_outage_segments,
        "outage_segments_blocks": q_outage_segments_blocks,
    }
)
ORACLE_SQL.update(
    {
        "metrics_hierarchy": _hierarchy_sql(),
        "interpolate_outages": _OUTAGE_SQL,
        "interpolate_outages_blocks": _OUTAGE_SQL,
        "outage_segments": _SEGMENT_SQL,
        "outage_segments_blocks": _SEGMENT_SQL,
    }
)


# ----------------------------------------------------------------------------- loaded scorer, arriving data, versions, guards


def q_sample_paths_model(spark, d):
    """The paths of the plugin sampler, from a scorer that each worker loads once."""
    factory = probabilistic.seasonal_analog_model(WIN30.num_samples, WIN30.prediction_length, WIN30.season_length)
    return rounded(probabilistic.prediction_bands(probabilistic.sample_paths(_win30(spark, d), WIN30, method="model", factory=factory), 0.9))


STREAM_STEPS, STREAM_DELAY = (1, 2, 24), "12 hours"
STREAM_SCHEMA = "series_id STRING, ts TIMESTAMP_NTZ, y DOUBLE, event_id BIGINT"


def q_stream_clean_lags(spark, d):
    """Lags of events that arrive in two calls; every fifth event of the last hours before the cut comes late."""
    raw = fx.table(spark, d, "events").select(
        F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("y"), "event_id"
    )
    cut = raw.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("at")).select(F.timestamp_micros("at").cast("timestamp_ntz")).first()[0]
    late = (F.col("event_id") % 5 == 0) & (F.col("ts") > F.lit(cut) - F.expr("INTERVAL 6 HOURS"))
    first = (F.col("ts") <= F.lit(cut)) & ~late
    src, dst = scratch_path(spark, "arriving"), scratch_path(spark, "stream-lags")
    for part in (raw.filter(first), raw.filter(~first)):
        part.write.mode("append").parquet(src)
        stream_clean_lags(spark, src, dst, STREAM_SCHEMA, STREAM_STEPS, STREAM_DELAY, "event_id")
    return rounded(files.read_series(spark, dst))


def _stream_sql() -> str:
    src = "SELECT event_type AS series_id, ts, arg_max({'y': CASE WHEN event_id % 17 <> 0 THEN value END}, event_id).y AS y FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"
    filled = "SELECT series_id, ts, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM last"
    lagged = f"SELECT series_id, ts, round(y, 6) AS y, {', '.join(lag_sql('y', STREAM_STEPS))} FROM (SELECT * FROM filled WHERE y IS NOT NULL) WINDOW w AS (PARTITION BY series_id ORDER BY ts)"
    return f"WITH last AS ({src}), filled AS ({filled}), lagged AS ({lagged}) SELECT * FROM lagged WHERE ts <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 12 HOUR"


def q_artefact_versions(spark, d):
    """The comparison table read back from its current version, after a further version failed."""
    m = metrics.forecast_metrics(_blended(spark, d), PREDS)
    root = scratch_path(spark, "versions")
    artefacts.publish(spark, root, lambda path: sinks.write_comparison(metrics.compare_models(m.filter("model <> 'hybrid'")), path))
    artefacts.publish(spark, root, lambda path: sinks.write_comparison(metrics.compare_models(m), path))
    broken = m.withColumn("value", F.raise_error(F.lit("no")).cast("double"))
    try:
        artefacts.publish(spark, root, lambda path: sinks.write_comparison(metrics.compare_models(broken), path))
    except Exception as e:  # noqa: BLE001 - the version is meant to fail
        if "no" not in str(e):
            raise
    schema = "model STRING, " + ", ".join(f"{x} DOUBLE" for x in metrics.PREFERRED)
    return rounded(files.read_series(spark, artefacts.current(spark, root), fmt="csv", schema=schema))


def q_blend_fixed(spark, d):
    """Fixed weights, clipped to [0, 1]."""
    out = _aligned(spark, d).withColumn("y_true", F.col("y_true_b"))
    for name, w in (("over", 1.7), ("under", -0.3), ("fixed", ForecastConfig().blend_weight)):
        out = align.blend(out, w, out=f"hybrid_{name}")
    return rounded(out.select("series_id", "ts", "hybrid_over", "hybrid_under", "hybrid_fixed"))


def q_completeness(spark, d):
    """What the guard before scoring counts: missing and non-finite values."""
    odd = _coerced(spark, d).withColumn("x", F.when(F.col("y") > 0, F.when(F.dayofmonth("ts") == 3, F.lit(float("inf"))).when(F.dayofmonth("ts") == 4, F.lit(float("nan"))).otherwise(F.col("y"))))
    return metrics.completeness(odd, ["y", "x"], by=["series_id"])


def q_tabular_float32(spark, d):
    """The scaled matrix narrowed to FLOAT."""
    ds, _, cols = tabular.tabular_dataset(fx.lineitem_daily(spark, d), TAB_CFG.with_(float32=True))
    shown = [(F.round(F.col(c).cast("double"), 4) + F.lit(0.0)).alias(c) for c in ("y", "y_lag_1", "y_roll_mean_7", "x_qty")]  # no -0.0
    return ds.select("series_id", "ts", "split", *shown)


def q_gbt_importance_rows(spark, d):
    """Number of splits and mean gain per feature, read from the saved nodes of the curve's trees."""
    return rounded(tabular.feature_importance(_curve_model(spark, d)))


QUERIES.update(
    {
        "sample_paths_model": q_sample_paths_model,
        "stream_clean_lags": q_stream_clean_lags,
        "artefact_versions": q_artefact_versions,
        "blend_fixed": q_blend_fixed,
        "completeness": q_completeness,
        "tabular_float32": q_tabular_float32,
        "gbt_importance_rows": q_gbt_importance_rows,
    }
)
ORACLE_SQL.update(
    {
        "sample_paths_model": ORACLE_SQL["sample_paths_plugin"],
        "stream_clean_lags": _stream_sql(),
        "artefact_versions": ORACLE_SQL["write_comparison"],
        "blend_fixed": with_fixtures(
            "SELECT series_id, ts, round(pred_a, 6) AS hybrid_over, round(pred_b, 6) AS hybrid_under, round(hybrid_pred, 6) AS hybrid_fixed FROM bl",
            "events_hourly_by_type",
            extra=EVAL_CTES,
        ),
        "completeness": with_fixtures(
            "SELECT series_id, count(*) AS n, count(*) FILTER (WHERE y IS NULL) AS y, count(*) FILTER (WHERE y IS NULL OR y <= 0 OR day(ts) IN (3, 4)) AS x FROM coerced GROUP BY series_id",
            "events_dirty",
            extra=CLEAN_CHAIN,
        ),
        "tabular_float32": f"SELECT series_id, ts, split, y, y_lag_1, y_roll_mean_7, x_qty FROM ({_tabular_sql(TAB_CFG.with_(float32=True), 'round(CAST(CAST({} AS FLOAT) AS DOUBLE), 4) + 0')})",
        "gbt_importance_rows": _gbt_curve_sql(importance=True),
    }
)
