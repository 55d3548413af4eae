"""Structured Streaming pieces: incremental landing, clean rows and lags of arriving data."""

from tsengine.streaming.features import clean_lags, stream_clean_lags
from tsengine.streaming.landing import land_stream

__all__ = ["clean_lags", "land_stream", "stream_clean_lags"]
