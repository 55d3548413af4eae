"""Series derived from the driver tables (``{sf_dir}/{table}.parquet``).

Each builder is a projection + grouped aggregate over a parquet scan, so column pruning and
partial aggregation reach the scan. Output schema: ``series_id, ts TIMESTAMP_NTZ, y DOUBLE``
(+ extra value columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.functions.columns import floor_ts

# Fixed values of the damaged-events fixture (see FIXTURES.md): modulus rules on event_id.
BAD_TS_MOD = 29
BAD_VALUE_MOD = 23
NULL_VALUE_MOD = 17
DUPLICATE_MOD = 31
DUPLICATE_ID_SHIFT = 10_000_000
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_30min(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (
        ev.groupBy(floor_ts("ts", "30 minutes").alias("ts"))
        .agg(F.sum("value").alias("y"))
        .select(F.lit("all").alias("series_id"), "ts", "y")
    )


def events_hourly_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("series_id"), floor_ts("ts", "1 hour").alias("ts")).agg(F.sum("value").alias("y"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (
        o.groupBy(floor_ts("o_orderdate", "1 day").alias("ts"))
        .agg(F.sum("o_totalprice").alias("y"))
        .select(F.lit("all").alias("series_id"), "ts", "y")
    )


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("series_id"), floor_ts("l_shipdate", "1 day").alias("ts")).agg(
        F.sum("l_extendedprice").alias("y"),
        F.sum("l_quantity").alias("x_qty"),
        F.avg("l_discount").alias("x_disc"),
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("series_id"), "ts", "event_id", F.col("value").alias("y"))


def events_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw strings, damaged by fixed modulus rules (bad stamps, bad/missing values,
    duplicated stamps whose later id must win)."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    ts_text = F.when(eid % BAD_TS_MOD == 0, F.lit("bad")).otherwise(F.date_format("ts", TS_TEXT_FORMAT))
    value_text = (
        F.when(eid % NULL_VALUE_MOD == 0, F.lit(None).cast("string"))
        .when(eid % BAD_VALUE_MOD == 0, F.lit("n/a"))
        .otherwise(F.col("value").cast("string"))
    )
    base = ev.select(eid, ts_text.alias("ts_raw"), value_text.alias("value_raw"), F.col("event_type").alias("series_id"), "value")
    dup = base.filter(eid % DUPLICATE_MOD == 0).select(
        (eid + DUPLICATE_ID_SHIFT).alias("event_id"),
        "ts_raw",
        (F.col("value") + 1).cast("string").alias("value_raw"),
        "series_id",
        "value",
    )
    return base.unionByName(dup).drop("value")


BUILDERS = {
    "events_30min": events_30min,
    "events_hourly_by_type": events_hourly_by_type,
    "orders_daily": orders_daily,
    "lineitem_daily": lineitem_daily,
    "user_events": user_events,
    "events_dirty": events_dirty,
}
