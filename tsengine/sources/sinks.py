"""Sinks: metric records, comparison tables, fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Long metric records ``(model, metric, value[, by...])`` as JSON, one folder per model."""
    df.write.mode(mode).partitionBy("model").json(path)
    return path


def write_comparison(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Model x metric comparison as headed CSV files."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def save_model(model, path: str) -> str:
    if model is None:
        raise RuntimeError("There are no trees to save: fit a model first")
    model.write().overwrite().save(path)
    return path


def load_model(spark, path: str):
    """Reload a saved GBT model; a missing path raises ``FileNotFoundError``."""
    from pyspark.errors import AnalysisException
    from pyspark.ml.regression import GBTRegressionModel

    try:
        return GBTRegressionModel.load(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"Model path does not exist: {path}") from e
    except Exception as e:  # noqa: BLE001 - the JVM reports a missing path as InvalidInputException
        if "does not exist" in str(e) or "FileNotFound" in str(e) or "InvalidInput" in str(e):
            raise FileNotFoundError(f"Model path does not exist: {path}") from e
        raise
