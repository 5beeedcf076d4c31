"""Queries that run a stream over the events and read its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rolling
from ..sources import tables as src
from ..streaming import jobs
from .regime import FIXED, HIST_MULTI
from .relational import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return add


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = src.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_type, strftime(b, '%Y-%m-%d %H:%M:%S') as start, count(*) as n from (select event_type, time_bucket(interval '15 minutes', ts) as b from events) where b + interval 15 minute <= (select max(ts) from events) - interval 2 hour group by 1, 2")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Complete 15-minute counts per event type, up to two hours before the last event."""
    out = jobs.run_available(jobs.window_counts(_stream(spark, d)), src.shared_path(spark, "stream"))
    end = src.table(spark, d, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 2 hours")).alias("end"))
    kept = out.join(F.broadcast(end), (F.col("start") + F.expr("interval 15 minutes")) <= F.col("end"))
    return kept.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select distinct user_id from events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Users as they first turn up in the stream, one row each."""
    return jobs.run_available(jobs.first_seen(_stream(spark, d), url="user_id").select("user_id"), src.shared_path(spark, "stream"))


@query(f"with recursive {HIST_MULTI} select asset, cast(fecha as varchar) as fecha, round(q0, 6) as xi_p_0, round(q1, 6) as xi_p_1, round(x0, 6) as xi_f_0, round(x1, 6) as xi_f_1, round(ll, 6) as loglik from hist")
def stream_hamilton_filter(spark: SparkSession, d: str) -> DataFrame:
    """Each asset's daily returns, landing in three parts of the calendar and filtered as a stream that carries its state: equal to the batch filter."""
    returns = rolling.log_returns(src.daily_close(spark, d, by_asset=True)).select("asset", "fecha", "r")
    returns = src.materialise(returns, "returns")
    days = returns.select(F.unix_date("fecha").alias("n"))
    cuts = days.agg(F.percentile_approx("n", [0.34, 0.67])).first()[0] or [0, 0]
    landing = src.shared_path(spark, "landing")
    part = F.when(F.unix_date("fecha") < cuts[0], 0).when(F.unix_date("fecha") < cuts[1], 1).otherwise(2)
    for k in range(3):
        returns.where(part == k).coalesce(1).write.mode("append").parquet(landing)
    jobs.use_state_store(spark)
    stream = spark.readStream.schema(returns.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    out = jobs.run_available(jobs.filter_state(stream, FIXED), src.shared_path(spark, "stream"))
    return rounded(out.drop("r"), "xi_p_0", "xi_p_1", "xi_f_0", "xi_f_1", "loglik")
