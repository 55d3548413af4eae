"""Landing and reading raw series files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Fail fast (driver side, schema only) when a required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"Required column(s) not found: {missing}; have {df.columns}")
    return df


#: Column of a landed table that holds the place of a row in its source: file, block, row.
INPUT_ORDER = "_input_order"


def require_rows(df: DataFrame, by: str, least: int = 1) -> DataFrame:
    """Raise when there are no rows, or a series has fewer than ``least`` (one grouped count)."""
    seen = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("fewest"), F.min_by(by, "n").alias("of")).first()
    if seen["fewest"] is None:
        raise ValueError("The input has no rows")
    if seen["fewest"] < least:
        raise ValueError(f"Series {seen['of']!r} has {seen['fewest']} rows; at least {least} are needed")
    return df


def land_csv(
    spark: SparkSession,
    src: str,
    dst: str,
    schema: T.StructType | str | None = None,
    header: bool = True,
) -> str:
    """Copy a CSV source (any Hadoop path/URI) into a Parquet landing table once.

    Re-running is a no-op when the landing table already exists (``mode("ignore")``). Without an
    explicit schema every column is read as STRING so that coercion happens in ``clean_series``
    rather than in CSV type inference. ``_input_order`` keeps the place of every row in its source,
    so that the last of several rows can be told later.
    """
    if not src:
        raise ValueError("land_csv: source path is empty")
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", False)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    reader.csv(src).select("*", place.alias(INPUT_ORDER)).write.mode("ignore").parquet(dst)
    return dst


def read_series(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    header: bool = True,
) -> DataFrame:
    """Logical scan of a landed series table (filters/projections push into the scan)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", header).csv(path)
    return reader.format(fmt).load(path)
