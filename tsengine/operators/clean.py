"""Landing-to-clean operators: typed coercion, last-wins dedup, time-weighted gap filling.

All ordered work is expressed as windows partitioned by the series key (plus an optional block
key from :mod:`tsengine.plans.layout`) and ordered by time. Two-sided fills use two running
frames (ascending and descending) instead of ``rowsBetween(current, unboundedFollowing)``, which
would re-aggregate the rest of the partition for every row.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.functions.columns import micros_between, nan_to_null, numeric_or_null
from tsengine.plans.layout import BLOCK, edge_carry, partition_blocks, resolve_layout
from tsengine.sources.files import INPUT_ORDER, require_columns


def _keys(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _wall_clock(text, fmt: str):
    """TIMESTAMP_NTZ of a text, the same in every session zone: read as UTC and counted from 1970."""
    instant = F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(fmt + " XXX")))
    seconds = (instant / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _parsed(df: DataFrame, col: str, fmt: str | Sequence[str]):
    dtype = dict(df.dtypes)[col]
    if dtype == "timestamp_ntz":
        return F.col(col)
    if dtype in ("timestamp", "date"):
        return F.col(col).cast("timestamp_ntz")
    return F.coalesce(*[_wall_clock(F.col(col).cast("string"), f) for f in ([fmt] if isinstance(fmt, str) else fmt)])


def _require_parsed(rows: int, parsed: int, col: str, fmt) -> None:
    if rows and not parsed:
        raise ValueError(f"None of {rows} values of {col!r} fits the time format {fmt!r}")


def parse_ts(df: DataFrame, col: str, fmt: str | Sequence[str] = "yyyy-MM-dd HH:mm:ss", out: str = "ts", on_unparsed: str = "drop") -> DataFrame:
    """Parse ``col`` with explicit patterns (the first that fits) into TIMESTAMP_NTZ.

    Rows without a stamp that parses are dropped. ``on_unparsed="error"`` raises if there are rows
    but not one of them parses, which is a wrong pattern rather than bad rows (one more pass over
    ``col`` alone).
    """
    require_columns(df, [col])
    parsed = _parsed(df, col, fmt)
    if on_unparsed == "error":
        seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count(parsed).alias("parsed")).first()
        _require_parsed(seen["rows"], seen["parsed"], col, fmt)
    rest = [c for c in df.columns if c not in (col, out)]
    return df.select(*rest, parsed.alias(out)).filter(F.col(out).isNotNull())


def dedup_last(df: DataFrame, keys: Sequence[str], tie_break: Sequence[str]) -> DataFrame:
    """One row per ``keys``; the row with the greatest ``tie_break`` tuple wins.

    A ``max_by`` aggregate rather than ``row_number``: it combines map-side, so a hot key costs
    one partial row per input partition instead of a full sort of its group.
    """
    keys, tie_break = list(keys), list(tie_break)
    if not tie_break:
        raise ValueError("dedup_last needs a total tie_break order (e.g. an event id)")
    require_columns(df, keys + tie_break)
    rest = [c for c in df.columns if c not in keys]
    winner = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in tie_break]))
    out = df.groupBy(*keys).agg(winner.alias("__row"))
    return out.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every listed column becomes DOUBLE; unparseable strings and NaN become NULL."""
    require_columns(df, cols)
    types = dict(df.dtypes)
    exprs = []
    for c in df.columns:
        if c not in cols:
            exprs.append(F.col(c))
        elif types[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or types[c].startswith("decimal"):
            exprs.append(nan_to_null(F.col(c).cast("double")).alias(c))
        else:
            exprs.append(numeric_or_null(c).alias(c))
    return df.select(*exprs)


def _running(by: list[str], time_col: str, descending: bool = False):
    order = F.col(time_col).desc() if descending else F.col(time_col).asc()
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def interpolate_time(
    df: DataFrame,
    cols: Sequence[str],
    by: str | Sequence[str] = "series_id",
    time_col: str = "ts",
    carry: dict | None = None,
    cfg: ForecastConfig | None = None,
    max_gap: timedelta | None = None,
) -> DataFrame:
    """Linear interpolation in elapsed time between the nearest known neighbours.

    Leading gaps take the first known value and trailing gaps the last known value (both
    directions are filled). ``carry`` (used by the block layout) maps each column to a pair of
    columns holding the last known ``(ts, v)`` before and first known ``(ts, v)`` after the
    partition, so edges of a block see neighbours outside it. With a ``cfg`` whose layout is or turns
    out "blocks", a series too large for one task is filled in blocks, with equal values.

    With ``max_gap``, values are not made up across an outage: a row whose known neighbours lie further
    apart stays NULL, and so does a leading or trailing row further than that from the known value.
    """
    by = _keys(by)
    if carry is None and _in_blocks(df, by, time_col, cfg):
        return _fill_blocks(df, cols, by[0], time_col, "interpolate", max_gap)
    fwd, bwd = _running(by, time_col), _running(by, time_col, descending=True)
    t = F.col(time_col)
    neighbours = []
    for c in cols:
        v = F.col(c)
        known_t = F.when(v.isNotNull(), t)
        prev_t = F.last(known_t, ignorenulls=True).over(fwd)
        prev_v = F.last(v, ignorenulls=True).over(fwd)
        next_t = F.last(known_t, ignorenulls=True).over(bwd)
        next_v = F.last(v, ignorenulls=True).over(bwd)
        if carry and c in carry:
            (pt, pv), (nt, nv) = carry[c]
            prev_t, prev_v = F.coalesce(prev_t, F.col(pt)), F.coalesce(prev_v, F.col(pv))
            next_t, next_v = F.coalesce(next_t, F.col(nt)), F.coalesce(next_v, F.col(nv))
        neighbours += [prev_t.alias(f"__pt_{c}"), prev_v.alias(f"__pv_{c}"), next_t.alias(f"__nt_{c}"), next_v.alias(f"__nv_{c}")]
    out = df.select("*", *neighbours)
    exprs = []
    for c in out.columns:
        if c.startswith("__"):
            continue
        if c in cols:
            pt, pv, nt, nv = (F.col(f"__{k}_{c}") for k in ("pt", "pv", "nt", "nv"))
            span = micros_between(pt, nt)
            between = pv + (nv - pv) * (micros_between(pt, t).cast("double") / span.cast("double"))
            missing = F.lit(False)
            if max_gap is not None:
                reach = F.coalesce(span, micros_between(pt, t), micros_between(t, nt))
                missing = reach > F.lit(_micros(max_gap))
            filled = (
                F.when(F.col(c).isNotNull(), F.col(c))
                .when(missing, F.lit(None))
                .when(pt.isNotNull() & nt.isNotNull() & (span > 0), between)
                .when(pt.isNotNull(), pv)
                .otherwise(nv)
            )
            exprs.append(filled.alias(c))
        else:
            exprs.append(F.col(c))
    return out.select(*exprs)


def fill_edges(
    df: DataFrame,
    cols: Sequence[str],
    by: str | Sequence[str] = "series_id",
    time_col: str = "ts",
    mode: str = "ffill_bfill",
    cfg: ForecastConfig | None = None,
) -> DataFrame:
    """Forward fill, then backward fill (``mode="ffill"`` stops after the forward pass); ``cfg`` as in
    :func:`interpolate_time`."""
    by = _keys(by)
    if _in_blocks(df, by, time_col, cfg):
        return _fill_blocks(df, cols, by[0], time_col, mode)
    fwd, bwd = _running(by, time_col), _running(by, time_col, descending=True)
    out = df.select(
        *[F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(fwd)).alias(c) if c in cols else F.col(c) for c in df.columns]
    )
    if mode == "ffill":
        return out
    return out.select(
        *[F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(bwd)).alias(c) if c in cols else F.col(c) for c in out.columns]
    )


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any (listed) column."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def _in_blocks(df: DataFrame, by: list[str], time_col: str, cfg: ForecastConfig | None) -> bool:
    return cfg is not None and len(by) == 1 and resolve_layout(df, cfg.with_(series_col=by[0], time_col=time_col)).layout == "blocks"


def _fill_blocks(df: DataFrame, cols: Sequence[str], s: str, t: str, mode: str, max_gap: timedelta | None = None) -> DataFrame:
    """Gap filling for series too large for one task: contiguous range blocks, with the nearest
    known neighbours outside each block carried in from a small per-block table."""
    blocked = partition_blocks(df, s, t)
    carried = edge_carry(blocked, list(cols), s, t).select(F.col(s).alias("__s"), F.col(BLOCK).alias("__b"), *[f"__{k}_{c}" for c in cols for k in ("prev", "next")])
    joined = blocked.join(carried, F.col(s).eqNullSafe(F.col("__s")) & (F.col(BLOCK) == F.col("__b")), "left").drop("__s", "__b")
    if mode == "interpolate":
        carry = {c: ((f"__prev_{c}.t", f"__prev_{c}.v"), (f"__next_{c}.t", f"__next_{c}.v")) for c in cols}
        return interpolate_time(joined, cols, by=[s, BLOCK], time_col=t, carry=carry, max_gap=max_gap).select(df.columns)
    fwd, bwd = _running([s, BLOCK], t), _running([s, BLOCK], t, descending=True)

    def filled(c):
        known = [F.col(c), F.last(c, ignorenulls=True).over(fwd), F.col(f"__prev_{c}.v")]
        if mode != "ffill":
            known += [F.last(c, ignorenulls=True).over(bwd), F.col(f"__next_{c}.v")]
        return F.coalesce(*known).alias(c)

    return joined.select(*[filled(c) if c in cols else F.col(c) for c in df.columns])


def _micros(span: timedelta) -> int:
    return int(span / timedelta(microseconds=1))


def outage_segments(
    df: DataFrame,
    max_gap: timedelta,
    by: str = "series_id",
    time_col: str = "ts",
    out: str = "segment",
    cfg: ForecastConfig | None = None,
) -> DataFrame:
    """Number the stretches of a series between outages: 0, 1, ... in time order (BIGINT).

    A row more than ``max_gap`` after the one before it starts a new segment, so that windows and lags
    by ``[series, segment]`` don't reach across. Equal stamps are one place in time; rows without a
    stamp have no segment. In the blocks layout (``cfg``) a block counts its own starts, and the last
    stamp and the number of segments before it come from one row per block.
    """
    require_columns(df, [by, time_col])
    t = F.col(time_col)
    limit = F.lit(_micros(max_gap))
    timed, untimed = df.filter(t.isNotNull()), df.filter(t.isNull()).withColumn(out, F.lit(None).cast("bigint"))
    if not _in_blocks(timed, [by], time_col, cfg):
        order = Window.partitionBy(by).orderBy(time_col)
        starts = timed.withColumn("__starts", (micros_between(F.lag(t).over(order), t) > limit).cast("bigint"))
        running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = starts.withColumn(out, F.coalesce(F.sum("__starts").over(running), F.lit(0).cast("bigint"))).drop("__starts")
        return numbered.unionByName(untimed)
    blocked = partition_blocks(timed, by, time_col)
    order = Window.partitionBy(by, BLOCK).orderBy(time_col)
    starts = blocked.withColumn("__starts", F.coalesce((micros_between(F.lag(t).over(order), t) > limit).cast("bigint"), F.lit(0).cast("bigint")))
    blocks = starts.groupBy(F.col(by).alias("__s"), F.col(BLOCK).alias("__k")).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"), F.sum("__starts").alias("__n"))
    along = Window.partitionBy("__s").orderBy("__k")
    blocks = blocks.withColumn("__edge", F.coalesce((micros_between(F.lag("__t1").over(along), F.col("__t0")) > limit).cast("bigint"), F.lit(0).cast("bigint")))
    before = F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.sum("__edge").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + before
    shifts = blocks.select("__s", "__k", shift.alias("__shift"))
    inside = F.sum("__starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = starts.withColumn("__inside", inside).join(shifts, F.col(by).eqNullSafe(F.col("__s")) & (F.col(BLOCK) == F.col("__k")))
    return numbered.select(*df.columns, (F.col("__inside") + F.col("__shift")).cast("bigint").alias(out)).unionByName(untimed)


def _all_null_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 0]


def _raw_layout(df: DataFrame, cfg: ForecastConfig) -> str:
    """The layout that the raw rows call for (an upper bound of the clean ones): a count that reads the
    series column alone, or nothing where the layout is given."""
    return resolve_layout(df, cfg).layout


def _require_any_parsed(df: DataFrame, col: str, fmt) -> None:
    """Raise if there are rows but not one stamp parses. Stops at the first that does, so only a wrong
    pattern costs a pass over the column."""
    if dict(df.dtypes)[col] in ("timestamp_ntz", "timestamp", "date"):
        return
    if df.filter(_parsed(df, col, fmt).isNotNull()).isEmpty():
        _require_parsed(df.count(), 0, col, fmt)


def clean_series(
    df: DataFrame,
    cfg: ForecastConfig = ForecastConfig(),
    value_cols: Sequence[str] | None = None,
    time_raw: str | None = None,
    fmt: str | Sequence[str] = "yyyy-MM-dd HH:mm:ss",
    tie_break: Sequence[str] | None = None,
    fill: str = "both",
    on_all_null: str = "empty",
) -> DataFrame:
    """Raw rows -> one clean row per (series, timestamp) with complete DOUBLE values.

    Steps: parse the time column (``time_raw`` -> ``cfg.time_col``), drop unparseable stamps,
    keep the last row per timestamp (``tie_break`` order; by default the input order that ``land_csv``
    stored, else the largest row, which is at least deterministic), coerce values to DOUBLE, interpolate
    in time, forward/backward fill, drop rows that are still incomplete.

    ``fill="both"`` interpolates with future neighbours (the reference behaviour; it reads values
    after a later train/test split point). ``fill="causal"`` only carries values forward.
    ``on_all_null``: "empty" keeps the reference behaviour (an all-null column empties the
    result), "drop_column" removes such columns, "error" raises. Rows without a single stamp that
    parses raise: the pattern is wrong.
    """
    s, t = cfg.series_col, cfg.time_col
    time_raw = time_raw or t
    require_columns(df, [s, time_raw])
    if tie_break is None and INPUT_ORDER in df.columns:
        tie_break = [INPUT_ORDER]
    if value_cols is None:
        value_cols = [c for c in df.columns if c not in (s, time_raw, *(tie_break or []))]
    require_columns(df, value_cols)
    layout = _raw_layout(df, cfg)
    _require_any_parsed(df, time_raw, fmt)
    out = parse_ts(df, time_raw, fmt, out=t)
    if layout == "series":
        # one shuffle by series serves both the dedup aggregate (clustered by series, ts) and
        # the per-series windows; duplicates are rare, so a map-side combine would save little
        out = out.repartition(s)
    out = dedup_last(out, [s, t], list(tie_break) if tie_break else list(value_cols))
    out = out.select(s, t, *value_cols)
    out = coerce_numeric(out, value_cols)
    if on_all_null != "empty":
        dead = _all_null_columns(out, value_cols)
        if dead and on_all_null == "error":
            raise ValueError(f"Columns could not be parsed at all: {dead}")
        value_cols = [c for c in value_cols if c not in dead]
        out = out.select(s, t, *value_cols)
    # two-sided interpolation leaves NULL only where a series has no known value at all, which a
    # forward/backward fill cannot repair either, so that pass (two more sorts) is skipped
    if layout == "blocks":
        out = _fill_blocks(out, value_cols, s, t, "ffill" if fill == "causal" else "interpolate")
    elif fill == "causal":
        out = fill_edges(out, value_cols, by=s, time_col=t, mode="ffill")
    else:
        out = interpolate_time(out, value_cols, by=s, time_col=t)
    return drop_incomplete(out, value_cols)
