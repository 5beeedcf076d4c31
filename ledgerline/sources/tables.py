"""Domain views over the star-schema tables: prices, vintages, calendar, headlines and a point process.

All times are kept as timestamps without zone (UTC by convention), so no result depends on the session's zone.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in a local folder only where that is unset and Spark runs in one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def micros(ts: Column | str, origin: str = ORIGIN) -> Column:
    """Microseconds from ``origin`` to a timestamp, by the wall clock."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit(origin).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def daily_close(spark: SparkSession, sf_dir: str, by_asset: bool = False) -> DataFrame:
    """prices(asset, fecha, close): mean order price of each day, of all orders or by priority.

    The mean is an exact decimal sum over a count, so it does not depend on the order of rows.
    """
    asset = F.col("o_orderpriority") if by_asset else F.lit("ALL")
    orders = table(spark, sf_dir, "orders").select(asset.alias("asset"), F.col("o_orderdate").cast("timestamp_ntz").cast("date").alias("fecha"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return orders.groupBy("asset", "fecha").agg((F.sum("p").cast("double") / F.count("p")).alias("close"))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vintages(series_id, obs_date, value, realtime_start): prices of line items by order and shipping date."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("series_id"), F.col("l_extendedprice").alias("value"), F.col("l_shipdate").cast("timestamp_ntz").cast("date").alias("realtime_start"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp_ntz").cast("date").alias("obs_date"))
    return line.join(orders, "l_orderkey").where("realtime_start > obs_date")


def one_per_vintage(rows: DataFrame) -> DataFrame:
    """One value for each (series_id, obs_date, realtime_start): the largest."""
    return rows.groupBy("series_id", "obs_date", "realtime_start").agg(F.max("value").alias("value"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calendar(indicator, event_id, ts, actual, consensus): the consensus is the indicator's value before (first: null)."""
    from ..operators import prefix

    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("indicator"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("actual"))
    return prefix.scan(events, ["indicator"], ["ts", "event_id"], lags={"consensus": F.col("actual")})


def point_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events(key, event_id, t, s): days since the origin and a mark in [0, 1], keyed by event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id", (micros("ts") / 86_400_000_000).alias("t"), (F.col("value") / 1000).alias("s"), "user_id")
