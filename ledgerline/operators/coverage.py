"""Date spines, missing and censored days, coverage summaries, and observed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def date_spine(df: DataFrame, day: str) -> DataFrame:
    """Every day from the first to the last of ``df``, made from its two bounds."""
    bounds = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where("lo is not null")
    return bounds.select(F.explode(F.sequence("lo", "hi")).alias(day))


def missing_days(df: DataFrame, day: str) -> DataFrame:
    """Days of the spine on which ``df`` has no row."""
    return date_spine(df, day).join(df.select(day).distinct(), day, "left_anti")


def censored_days(df: DataFrame, day: str, cap: int) -> DataFrame:
    """Days that reached ``cap`` rows: what lies beyond was not captured."""
    return df.groupBy(day).agg(F.count("*").alias("n")).where(F.col("n") >= cap)


def coverage_summary(calendar: DataFrame, indicators: DataFrame) -> DataFrame:
    """Per wanted indicator: events, events with consensus, first and last; indicators without events stay, with zeros."""
    own = calendar.groupBy("indicator").agg(F.count("*").alias("n"), F.count("consensus").alias("n_with_consensus"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    out = indicators.join(own, "indicator", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_with_consensus")})


def observed_time(events: DataFrame, t: str, spine: DataFrame) -> DataFrame:
    """Adds t_observed: ``t`` (days from the origin) less the measure of missing days before it.

    ``spine`` has (day_no, is_missing), one row per whole day from the origin. Within a missing day time stands still.
    """
    before = Window.orderBy("day_no").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spine.withColumn("gone", F.coalesce(F.sum(F.col("is_missing").cast("int")).over(before), F.lit(0)))
    day = F.floor(t).cast("int")
    joined = events.withColumn("day_no", day).join(F.broadcast(gaps), "day_no", "left")
    part = F.when(F.col("is_missing"), F.col(t) - F.col("day_no")).otherwise(0.0)
    return joined.withColumn("t_observed", F.col(t) - F.coalesce("gone", F.lit(0)) - part).drop("day_no", "is_missing", "gone")


def lag_histogram(rows: DataFrame, lag: str, bins: int = 12) -> DataFrame:
    """(bin, edge_lo, edge_hi, n): equal bins from the least to the greatest lag, closed above; empty bins stay.

    The lowest edge is widened by a thousandth of the range, so that the least lag is inside. If all lags are equal
    both ends are a thousandth of the value away (0.001 for 0). No rows give no bins.
    """
    ends = rows.agg(F.min(lag).alias("a"), F.max(lag).alias("z")).where("a is not null")
    away = lambda c: F.coalesce(F.nullif(0.001 * F.abs(F.col(c)), F.lit(0.0)), F.lit(0.001))
    flat = F.col("a") == F.col("z")
    wide = ends.select(F.when(flat, F.col("a") - away("a")).otherwise(F.col("a")).alias("lo"), F.when(flat, F.col("z") + away("z")).otherwise(F.col("z")).alias("hi"), flat.alias("flat"))
    step, i = (F.col("hi") - F.col("lo")) / bins, F.col("bin")
    named = wide.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    low = F.col("lo") + i * step - F.when((i == 0) & ~F.col("flat"), 0.001 * (F.col("hi") - F.col("lo"))).otherwise(0.0)
    edges = named.select("bin", low.alias("edge_lo"), (F.col("lo") + (i + 1) * step).alias("edge_hi"))
    inside = (F.col(lag) > F.col("edge_lo")) & ((F.col(lag) <= F.col("edge_hi")) | (i == bins - 1))
    # lags are counted once each before they meet the few edges
    counted = rows.where(F.col(lag).isNotNull()).groupBy(lag).agg(F.count("*").alias("m"))
    own = counted.join(F.broadcast(edges), inside).groupBy("bin").agg(F.sum("m").alias("n"))
    return edges.join(own, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
