"""tsengine: Spark-native preparation, forecasting and evaluation of many time series.

Every operator takes and returns a :class:`pyspark.sql.DataFrame`. Series are keyed by a
``series_id`` column and ordered by a ``ts`` column; order is never implicit.
"""

from tsengine.config import ForecastConfig
from tsengine.operators.align import align_forecasts, blend, blend_tuned, truth_gap, tune_blend
from tsengine.operators.charts import plot_frame
from tsengine.operators.clean import clean_series, coerce_numeric, dedup_last, drop_incomplete, fill_edges, interpolate_time, parse_ts
from tsengine.operators.features import add_calendar, add_lags, add_rolling, build_features, lag_steps, rolling_windows, tail_n, with_position
from tsengine.operators.metrics import assert_complete, compare_models, forecast_metrics
from tsengine.operators.probabilistic import prediction_bands, sample_paths
from tsengine.operators.scale import apply_scaler, fit_scaler, invert_scaler
from tsengine.operators.split import split_chrono
from tsengine.operators.tabular import GbtForecaster, assemble, feature_importance, tabular_dataset
from tsengine.operators.windows import context_windows, explode_horizon, first_step, truncate_context, window_dataset
from tsengine.plans.end_to_end import run_end_to_end

__all__ = [
    "ForecastConfig",
    "GbtForecaster",
    "add_calendar",
    "add_lags",
    "add_rolling",
    "align_forecasts",
    "apply_scaler",
    "assemble",
    "assert_complete",
    "blend",
    "blend_tuned",
    "build_features",
    "clean_series",
    "coerce_numeric",
    "compare_models",
    "context_windows",
    "dedup_last",
    "drop_incomplete",
    "explode_horizon",
    "feature_importance",
    "fill_edges",
    "first_step",
    "fit_scaler",
    "forecast_metrics",
    "interpolate_time",
    "invert_scaler",
    "lag_steps",
    "parse_ts",
    "plot_frame",
    "prediction_bands",
    "rolling_windows",
    "run_end_to_end",
    "sample_paths",
    "split_chrono",
    "tabular_dataset",
    "tail_n",
    "truncate_context",
    "truth_gap",
    "tune_blend",
    "window_dataset",
    "with_position",
]
__version__ = "0.1.0"
