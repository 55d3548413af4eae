"""Context/horizon windows cut from each series, anchored like the reference split.

Windows end at ``e = anchor + k * stride`` with context rows ``[e - C, e)`` and horizon rows
``[e, e + H)``. Train windows are anchored at ``C`` and must end inside the train part; test
windows are anchored at the split position and may read train rows as context.

Instead of exploding every row into each window it belongs to (C/stride-fold), rows are first
grouped into stride-sized blocks (one array per block, ``n / stride`` rows), and each window
row concatenates the previous ``ceil(C / stride)`` blocks (context) and the next
``ceil(H / stride)`` blocks (horizon) with a window over the block rows. For very long series
the block rows are themselves cut into super-blocks with a halo of ``ceil(C / stride)`` blocks
so no task ever holds a whole series.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.operators.split import split_index
from tsengine.plans.layout import BLOCK, HALO, halo_blocks, positions_and_counts

SUPERBLOCK_BLOCKS = 4096


def context_windows(
    df: DataFrame,
    cfg: ForecastConfig = ForecastConfig(),
    context_length: int | None = None,
    prediction_length: int | None = None,
    stride: int | None = None,
    test_size: float | None = None,
    phases: tuple[str, ...] = ("train", "test"),
) -> DataFrame:
    """``series_id, window_id, split, ctx ARRAY<DOUBLE>, horizon ARRAY<STRUCT<ts, y>>``.

    ``phases=("test",)`` cuts only test windows, reading only the last ``n - split + C`` rows of
    each series.

    ``window_id`` is the position of the first horizon row. A series is usable when its split
    position leaves ``C + H`` train rows and at least ``H`` test rows; other series raise
    (``cfg.on_short="error"``) or are left out (``"skip"``); :func:`series_status` lists them.
    """
    s_col, t_col, y_col = cfg.series_col, cfg.time_col, cfg.target
    C = int(cfg.context_length if context_length is None else context_length)
    H = int(cfg.prediction_length if prediction_length is None else prediction_length)
    S = int(cfg.effective_stride if stride is None else stride)
    tsz = cfg.test_size if test_size is None else test_size
    if C < 1 or H < 1 or S < 1:
        raise ValueError("context_length, prediction_length and stride must be >= 1")

    if cfg.on_short == "error":  # judged by one count per series, before any row is numbered
        status = series_status(df, cfg.with_(context_length=C, prediction_length=H, stride=S, test_size=tsz))
        short = status.filter(F.col("status") != "ok").select(s_col).limit(5).collect()
        if short:
            raise ValueError(f"Series too short for windows (need C+H train and H test rows): {[r[0] for r in short]}")
    base = positions_and_counts(df.select(s_col, t_col, y_col), cfg, pos="pos", n="n")
    split = split_index(F.col("n"), tsz, lo=F.lit(C + H))
    base = base.withColumn("cut", split)
    usable = (F.col("cut") >= C + H) & (F.col("n") - F.col("cut") >= H)
    base = base.filter(usable)

    # one pass: a row belongs to the train phase (before the split) and/or to the test phase
    # (the split and the C rows of history before it); both phases come from one Generate
    unknown = set(phases) - {"train", "test"}
    if unknown or not phases:
        raise ValueError(f"phases must be a non-empty subset of ('train', 'test'), got {phases}")
    spec = {
        "train": F.struct(F.lit("train").alias("split"), F.lit(C).cast("bigint").alias("anchor"), F.col("cut").alias("limit"), (F.col("pos") < F.col("cut")).alias("in")),
        "test": F.struct(F.lit("test").alias("split"), F.col("cut").alias("anchor"), F.col("n").alias("limit"), (F.col("pos") >= F.col("cut") - C).alias("in")),
    }
    if phases == ("test",) or list(phases) == ["test"]:
        base = base.filter(F.col("pos") >= F.col("cut") - C)
    wanted = F.array(*[spec[p] for p in ("train", "test") if p in phases])
    rows = base.select(s_col, t_col, y_col, "pos", F.inline(F.filter(wanted, lambda p: p["in"]))).drop("in")

    m_ctx, m_h = math.ceil(C / S), math.ceil(H / S)
    # block index shifted so the earliest context block of the train phase is 0
    rows = rows.withColumn("blk", (F.floor((F.col("pos") - F.col("anchor")) / F.lit(S)) + F.lit(m_ctx)).cast("bigint"))
    point = F.struct(F.col("pos"), F.col(t_col).alias("ts"), F.col(y_col).alias("y"))
    blocks = rows.groupBy(s_col, "split", "blk", "anchor", "limit").agg(F.array_sort(F.collect_list(point)).alias("pts"))

    # each window is emitted at the block row holding its last horizon step, so context and
    # horizon are both read with one backward frame; super-blocks of block rows with a halo of
    # that frame's length keep every task bounded for long series
    reach = m_ctx + m_h - 1
    span = max(SUPERBLOCK_BLOCKS, 4 * (reach + 1))
    blocks = halo_blocks(blocks, span, reach, pos_col="blk") if reach > 0 else blocks.withColumn(BLOCK, F.lit(0)).withColumn(HALO, F.lit(False))
    wb = Window.partitionBy(s_col, "split", BLOCK).orderBy("blk")
    pts = F.flatten(F.collect_list("pts").over(wb.rowsBetween(-reach, 0)))
    start_blk = F.col("blk") - F.lit(m_h - 1)
    e = F.col("anchor") + (start_blk - F.lit(m_ctx)) * F.lit(S)
    win = blocks.select(s_col, "split", "limit", HALO, start_blk.alias("sb"), e.alias("e"), pts.alias("pts"))
    win = win.filter(~F.col(HALO) & (F.col("sb") >= m_ctx) & (F.col("e") + H <= F.col("limit")))
    ctx = F.transform(F.filter("pts", lambda p: (p["pos"] >= F.col("e") - C) & (p["pos"] < F.col("e"))), lambda p: p["y"])
    hor = F.transform(
        F.filter("pts", lambda p: (p["pos"] >= F.col("e")) & (p["pos"] < F.col("e") + H)),
        lambda p: F.struct(p["ts"].alias("ts"), p["y"].alias("y")),
    )
    return win.select(s_col, F.col("e").cast("bigint").alias("window_id"), "split", ctx.alias("ctx"), hor.alias("horizon"))


def truncate_context(df: DataFrame, context_length: int, col: str = "ctx") -> DataFrame:
    """Keep the last ``context_length`` points of every context array."""
    c = F.col(col)
    return df.withColumn(col, F.when(F.size(c) > context_length, F.slice(c, -context_length, context_length)).otherwise(c))


def window_keys(df: DataFrame) -> list[str]:
    """Columns that name a window, whatever the series column is called."""
    return [c for c in df.columns if c not in ("ctx", "horizon", "samples")]


def series_status(df: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """One row per series: ``rows``, ``train_windows``, ``test_windows`` and ``status``: "ok",
    "fewer than three rows" or "too short for windows" (both with no windows).

    One map-side-combined count; says which series the windows leave out and why.
    """
    s, C, H, S = cfg.series_col, cfg.context_length, cfg.prediction_length, cfg.effective_stride
    counted = df.groupBy(s).agg(F.count(F.lit(1)).alias("rows"))
    counted = counted.withColumn("cut", split_index(F.col("rows"), cfg.test_size, lo=F.lit(C + H)))
    short = (F.col("cut") < C + H) | (F.col("rows") - F.col("cut") < H)
    status = F.when(F.col("rows") < 3, "fewer than three rows").when(short, "too short for windows").otherwise("ok")
    number = lambda span: F.when(status == "ok", F.floor((span - H) / S) + 1).otherwise(0).cast("bigint")
    return counted.select(s, "rows", number(F.col("cut") - C).alias("train_windows"), number(F.col("rows") - F.col("cut")).alias("test_windows"), status.alias("status"))


def explode_horizon(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per horizon step: the window's keys, ``step, ts, y`` (+ zipped ``extra`` arrays)."""
    keep = window_keys(df)
    if not extra:
        return df.select(*keep, F.posexplode("horizon").alias("step", "h")).select(*keep, "step", "h.ts", "h.y")
    zipped = F.arrays_zip(F.col("horizon").alias("h"), *[F.col(c).alias(c) for c in extra])
    return df.select(*keep, F.posexplode(zipped).alias("step", "z")).select(*keep, "step", "z.h.ts", "z.h.y", *[f"z.{c}" for c in extra])


def first_step(df: DataFrame) -> DataFrame:
    """Step 0 of every window (one-step-ahead view)."""
    if "step" in df.columns:
        return df.filter(F.col("step") == 0)
    return df.select(
        *window_keys(df),
        F.get(F.col("horizon"), 0)["ts"].alias("ts"),
        F.get(F.col("horizon"), 0)["y"].alias("y"),
    )


def window_dataset(df: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """Train and test windows of the target with the configured C, H and stride."""
    return context_windows(df, cfg)
