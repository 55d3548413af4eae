"""Clean rows and lags from rows that keep arriving.

Each series keeps in its state the rows that later ones may still replace (those after the watermark),
the last clean values that lags reach back to, and nothing else. When the watermark passes a stamp, its
last row becomes final: a missing value takes the one before it (filling from the future would need
rows that haven't arrived), and the row is emitted once, with its lags.

What is emitted, over however many calls and batches, equals ``clean_series(fill="causal")`` and
``add_lags`` over all rows at once, up to the watermark. Rows that arrive behind the watermark are
dropped by Spark, as in every stream with one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.functions.columns import micros_between, ntz_from_micros

STATE = "ts ARRAY<BIGINT>, y ARRAY<DOUBLE>, place ARRAY<BIGINT>, recent ARRAY<DOUBLE>"


def clean_lags(rows: DataFrame, steps: Sequence[int], delay: str, place: str, series_col: str = "series_id", time_col: str = "ts", target: str = "y") -> DataFrame:
    """Streaming ``series, ts, y, y_lag_k...`` from streaming raw rows, in append mode.

    ``delay`` is how far behind the newest stamp a row may arrive ("2 hours"). Of several rows of one
    series and stamp, the one with the greatest ``place`` (an arrival number, BIGINT) counts. Rows without
    a stamp are dropped; so are a series' first rows while it has no value. A series' state is its rows
    within ``delay`` and ``max(steps)`` values; a batch's rows of one series are handled by one task, so
    batches are kept small (``max_files_per_trigger``) where one series is very hot.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    steps = [int(k) for k in steps]
    if not steps or min(steps) < 1:
        raise ValueError("steps must be positive")
    reach, names = max(steps), [f"{target}_lag_{k}" for k in steps]
    s, t = series_col, time_col
    micros = micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(t).cast("timestamp_ntz"))
    source = rows.filter(F.col(t).isNotNull()).select(F.col(s), micros.alias("__us"), F.col(target).cast("double").alias(target), F.col(place).cast("bigint").alias("__place"))
    keyed = source.withColumn("__at", F.timestamp_micros("__us")).withWatermark("__at", delay)
    kind = source.schema[s].dataType.simpleString()
    schema = ", ".join([f"`{s}` {kind}", "__us BIGINT", f"`{target}` DOUBLE", *(f"`{n}` DOUBLE" for n in names)])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, recent = {}, []
        if state.exists:
            ts, ys, places, recent = state.get
            pending, recent = {u: (p, v) for u, v, p in zip(ts, ys, places, strict=True)}, list(recent)
        if not state.hasTimedOut:
            for batch in batches:
                for u, v, p in zip(batch["__us"].tolist(), batch[target].tolist(), batch["__place"].tolist(), strict=True):
                    p = None if p is None or p != p else int(p)
                    v = None if v is None or v != v else v
                    if u not in pending or _after((p, v), pending[u]):
                        pending[u] = (p, v)
        limit = state.getCurrentWatermarkMs() * 1000
        out = []
        for u in sorted(u for u in pending if u <= limit):
            v = pending.pop(u)[1]
            if v is None:
                if not recent:
                    continue
                v = recent[-1]
            out.append((key[0], u, v, *(recent[-k] if k <= len(recent) else None for k in steps)))
            recent = [*recent, v][-reach:]
        left = sorted(pending)
        state.update((left, [pending[u][1] for u in left], [pending[u][0] for u in left], recent))
        if left:  # called again when the watermark passes the first of them, with or without new rows
            state.setTimeoutTimestamp(max(left[0] // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[s, "__us", target, *names]).astype({c: "float64" for c in (target, *names)})

    found = keyed.groupBy(s).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    nulls = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in (target, *names)]
    return found.select(s, ntz_from_micros("__us").alias(t), *nulls)


def _after(new: tuple, old: tuple) -> bool:
    """Does a row count rather than another of its stamp? Greatest place, then greatest value; NULLs least."""
    rank = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    return rank(new) > rank(old)


def stream_clean_lags(
    spark: SparkSession,
    src_dir: str,
    dst: str,
    schema: str,
    steps: Sequence[int],
    delay: str,
    place: str,
    series_col: str = "series_id",
    time_col: str = "ts",
    target: str = "y",
    max_files_per_trigger: int | None = None,
) -> str:
    """:func:`clean_lags` from the Parquet files of a folder to a Parquet table: every call takes the files
    that arrived since the last one and stops. Progress and state lie beside the table (shared storage),
    so a call that was lost goes on where it stopped."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = clean_lags(reader.parquet(src_dir), steps, delay, place, series_col, time_col, target)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{dst.rstrip('/')}/_features_checkpoint").outputMode("append").trigger(availableNow=True).start(dst)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"feature stream failed: {query.exception()}")
    return dst
