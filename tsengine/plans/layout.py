"""Choosing how ordered per-series work is partitioned.

``series`` layout: every ordered window is ``partitionBy(series)``. One Exchange, one Sort, and
all lag/rolling columns in one Window operator. A task holds one whole series.

``blocks`` layout, for a series too large for one task (one key may hold a third of all rows):

1. Row positions without a per-series window: ``repartitionByRange(series, ts)`` splits even a
   single hot series across many balanced partitions; the range-sorted frame is checkpointed
   to the shared checkpoint folder with each row's partition and index (stable for all later passes,
   lineage cut, survives executor loss). A grouped count per (partition, series) says where a series
   starts in a partition and how many of its rows came before; an equi-join adds that to the index.
2. Position blocks of ``block_rows`` rows. The last ``reach`` rows of every block are copied into
   the next block as a halo, so a window partitioned by ``(series, block)`` sees every row a lag
   or rolling frame needs. Halo rows are dropped afterwards. Tasks are bounded by
   ``block_rows + reach`` rows whatever the series size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.config import ForecastConfig
from tsengine.session import materialize

POS = "__pos"
BLOCK = "__blk"
HALO = "__halo"


def series_stats(df: DataFrame, series_col: str) -> tuple[int, int]:
    """(largest series, total rows): two scalars to the driver from one map-side-combined count."""
    row = df.groupBy(series_col).count().agg(F.max("count").alias("m"), F.sum("count").alias("t")).first()
    return int(row["m"] or 0), int(row["t"] or 0)


def resolve_layout(df: DataFrame, cfg: ForecastConfig) -> ForecastConfig:
    """Decide "auto" once and pin it (with a block size) for the downstream operators.

    A series is split into blocks when it is larger than its fair share of the work
    (total rows / parallelism) and than ``min_split_rows``, and always when it is larger than
    ``max_rows_per_task``: one hot key can then never become the straggler task.
    """
    if cfg.layout in ("series", "blocks"):
        return cfg
    return pin_layout(df.sparkSession, cfg, *series_stats(df, cfg.series_col))


def pin_layout(spark, cfg: ForecastConfig, biggest: int, total: int) -> ForecastConfig:
    """The layout for a largest series and a number of rows that are known already."""
    if cfg.layout in ("series", "blocks"):
        return cfg
    par = max(1, spark.sparkContext.defaultParallelism)
    threshold = min(cfg.max_rows_per_task, max(cfg.min_split_rows, total // par))
    if biggest <= threshold:
        return cfg.with_(layout="series")
    block = max(1, min(cfg.block_rows, -(-biggest // (4 * par))))
    return cfg.with_(layout="blocks", block_rows=block)


def choose_layout(df: DataFrame, cfg: ForecastConfig) -> str:
    return resolve_layout(df, cfg).layout


def _num_partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, spark.sparkContext.defaultParallelism)


INDEX_BITS = 33  # monotonically_increasing_id holds the partition above them, the row's index below


def range_checkpoint(df: DataFrame, series_col: str, time_col: str, num_partitions: int | None = None, sort: bool = True, index: str | None = None) -> DataFrame:
    """Range-partition by (series, ts) and checkpoint, stamping each row's range partition into
    ``__blk`` (and its place in it into ``index``) *inside the checkpoint job*: both are stored data,
    so they stay right when the frame is later read inside a union (where task partition ids shift)."""
    n_parts = num_partitions or _num_partitions(df)
    ranged = df.repartitionByRange(n_parts, F.col(series_col), F.col(time_col))
    if sort:
        ranged = ranged.sortWithinPartitions(series_col, time_col)
    stamped = ranged.withColumn("__id", F.monotonically_increasing_id())
    stamped = stamped.withColumn(BLOCK, F.shiftright("__id", INDEX_BITS))
    if index:
        stamped = stamped.withColumn(index, F.col("__id").bitwiseAND(F.lit((1 << INDEX_BITS) - 1)))
    return materialize(stamped.drop("__id"))


def range_positions(df: DataFrame, series_col: str, time_col: str, out: str = POS, num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row within its series, safe for arbitrarily large series.

    A row's position is its stored index in its range partition, less the index at which its series
    starts there, plus the rows of that series in earlier partitions. The last two are one number per
    (partition, series), from a grouped count; the join on both keys is measured at run time.
    """
    ranged = range_checkpoint(df, series_col, time_col, num_partitions, index="__at")
    runs = ranged.groupBy(F.col(BLOCK).alias("__pid"), F.col(series_col).alias("__sid")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("__sid").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    shifts = runs.select("__pid", "__sid", shift)
    placed = ranged.join(shifts, (F.col(BLOCK) == F.col("__pid")) & F.col(series_col).eqNullSafe(F.col("__sid")))
    return placed.select(*df.columns, (F.col("__at") + F.col("__shift")).cast("bigint").alias(out))


def halo_blocks(df: DataFrame, block_rows: int, reach: int, pos_col: str = POS) -> DataFrame:
    """Assign ``__blk = pos div block_rows`` and copy each block's last ``reach`` rows forward."""
    if reach >= block_rows:
        raise ValueError("halo reach must be smaller than the block size")
    blk = F.floor(F.col(pos_col) / F.lit(block_rows)).cast("bigint")
    tail = (F.col(pos_col) % F.lit(block_rows)) >= F.lit(block_rows - reach)
    out = df.withColumn("__own", blk).withColumn(BLOCK, F.explode(F.when(tail, F.array(blk, blk + 1)).otherwise(F.array(blk))))
    return out.withColumn(HALO, F.col(BLOCK) != F.col("__own")).drop("__own")


def features_by_layout(df: DataFrame, cfg: ForecastConfig, keep_position: bool = False) -> DataFrame:
    """Calendar, lag and rolling columns; ``keep_position`` leaves ``__pos`` in the blocks layout."""
    from tsengine.operators.features import add_calendar, feature_exprs, feature_reach

    s, t = cfg.series_col, cfg.time_col
    cfg = resolve_layout(df, cfg)
    base = add_calendar(df, t)
    if cfg.layout == "series":
        w = Window.partitionBy(s).orderBy(t)
        return base.select("*", *feature_exprs(cfg, w))
    reach = feature_reach(cfg)
    block_rows = max(cfg.block_rows, reach + 1)
    positioned = range_positions(base, s, t)
    blocked = halo_blocks(positioned, block_rows, reach)
    w = Window.partitionBy(s, BLOCK).orderBy(t)
    out = blocked.select("*", *feature_exprs(cfg, w)).filter(~F.col(HALO))
    return out.drop(BLOCK, HALO) if keep_position else out.drop(POS, BLOCK, HALO)


def positions_and_counts(df: DataFrame, cfg: ForecastConfig, pos: str = POS, n: str = "__n") -> DataFrame:
    """Add 0-based position and series length using the layout the data calls for."""
    s, t = cfg.series_col, cfg.time_col
    if choose_layout(df, cfg) == "series":
        w = Window.partitionBy(s).orderBy(t)
        return df.withColumn(pos, (F.row_number().over(w) - 1).cast("bigint")).withColumn(
            n, F.count(F.lit(1)).over(Window.partitionBy(s)).cast("bigint")
        )
    positioned = range_positions(df, s, t, out=pos)
    lengths = positioned.groupBy(F.col(s).alias("__s")).agg((F.max(pos) + 1).cast("bigint").alias(n))
    # one row per series: AQE broadcasts it when small, else splits skewed join partitions
    return positioned.join(lengths, F.col(s).eqNullSafe(F.col("__s")), "left").drop("__s")


def partition_blocks(df: DataFrame, series_col: str, time_col: str, num_partitions: int | None = None) -> DataFrame:
    """Balanced contiguous (series, ts) blocks, materialised, block id in ``__blk``."""
    return range_checkpoint(df, series_col, time_col, num_partitions, sort=False)


def edge_carry(blocked: DataFrame, cols: list[str], series_col: str, time_col: str) -> DataFrame:
    """For every (series, block): the last known ``(t, v)`` before the block and the first known
    ``(t, v)`` after it, per column. Built from one small per-block aggregate (map-side
    combined) and windows over block rows only (a series has at most #partitions blocks)."""
    t = F.col(time_col)
    aggs = []
    for c in cols:
        known_t = F.when(F.col(c).isNotNull(), t)
        point = F.struct(t.alias("t"), F.col(c).alias("v"))
        aggs += [F.max_by(point, known_t).alias(f"__lk_{c}"), F.min_by(point, known_t).alias(f"__fk_{c}")]
    per_block = blocked.groupBy(series_col, BLOCK).agg(*aggs)
    before = Window.partitionBy(series_col).orderBy(F.col(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(series_col).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = [series_col, BLOCK]
    for c in cols:
        out += [
            F.last(f"__lk_{c}", ignorenulls=True).over(before).alias(f"__prev_{c}"),
            F.last(f"__fk_{c}", ignorenulls=True).over(after).alias(f"__next_{c}"),
        ]
    return per_block.select(*out)
