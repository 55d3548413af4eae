"""Incremental landing: new raw files in a folder are appended to a Parquet landing table.

The batch ``land_csv`` copies a source once and skips when the target exists. As files keep
arriving, the streaming file source remembers which files it already landed (in its checkpoint),
so every run with ``trigger(availableNow=True)`` lands exactly the new files and stops. The
checkpoint lives under the shared checkpoint folder so a restarted job resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def land_stream(
    spark: SparkSession,
    src_dir: str,
    dst: str,
    schema: T.StructType | str,
    fmt: str = "csv",
    checkpoint: str | None = None,
    header: bool = True,
    max_files_per_trigger: int | None = None,
) -> str:
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(src_dir)
    q = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or f"{dst.rstrip('/')}/_landing_checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(dst)
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"landing stream failed: {q.exception()}")
    return dst
