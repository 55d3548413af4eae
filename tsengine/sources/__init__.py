"""Scans, landing, fixture series built from the driver tables, and sinks."""

from tsengine.sources.files import land_csv, read_series, require_columns
from tsengine.sources.sinks import load_model, save_model, write_comparison, write_metrics

__all__ = [
    "land_csv",
    "load_model",
    "read_series",
    "require_columns",
    "save_model",
    "write_comparison",
    "write_metrics",
]
