"""As-of, nearest and bitemporal operators by carried values: stacked sides in order, no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import business_days_later
from . import prefix


def asof_backward(left: DataFrame, right: DataFrame, on: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``left`` with the last known ``values`` of ``right`` at or before ``on`` within ``keys``.

    Both sides are stacked and values carried forward; a right row at the same time counts. Of several right
    rows at one time the greatest by ``values`` is taken.
    """
    right = right.groupBy(*keys, on).agg(F.max(F.struct(*values)).alias("_v"))
    stacked = left.withColumn("_v", F.lit(None).cast(right.schema["_v"].dataType)).withColumn("_left", F.lit(1)).unionByName(
        right.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    carried = prefix.scan(stacked, keys, [on, "_left"], lasts={"_v": F.col("_v")}).where("_left = 1")
    return carried.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def asof_nearest(left: DataFrame, right: DataFrame, on: str, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """``left`` with the nearest ``right`` row's time (matched_on) and ``value`` within ``tolerance``, both ways.

    The tolerance is inclusive; of two equally near rows the earlier one is taken. Rows without a match keep nulls.
    ``on`` is numeric.
    """
    right = right.groupBy(*keys, on).agg(F.max(value).alias("_value")).withColumn("_v", F.struct(F.col(on).alias("at"), F.col("_value").alias("value"))).drop("_value")
    stacked = left.withColumn("_v", F.lit(None).cast(right.schema["_v"].dataType)).withColumn("_left", F.lit(1)).unionByName(
        right.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    both = prefix.scan(stacked, keys, [on, "_left"], lasts={"_p": F.col("_v")}, nexts={"_n": F.col("_v")}, back=[F.col(on).desc(), "_left"]).where("_left = 1")
    past, future = F.col(on) - F.col("_p.at"), F.col("_n.at") - F.col(on)
    use_past = F.col("_n").isNull() | (F.col("_p").isNotNull() & (past <= future))
    picked = both.withColumn("_m", F.when(use_past, F.col("_p")).otherwise(F.col("_n")))
    picked = picked.withColumn("_m", F.when(F.abs(F.col(on) - F.col("_m.at")) <= tolerance, F.col("_m")))
    return picked.select(*left.columns, F.col("_m.at").alias("matched_on"), F.col("_m.value").alias(value))


def match_events(headlines: DataFrame, releases: DataFrame, keywords: list[tuple[str, str]], on: str, key: str, text: str, tolerance: float) -> DataFrame:
    """``headlines`` with the indicator they name and the time of its nearest release within ``tolerance``, else nulls.

    Indicators are tried in the order of ``keywords`` (name, pattern): the first that the lower-cased text matches and
    that has a release near enough counts. ``releases`` has (indicator, ``on``); ``key`` is unique in ``headlines``.
    """
    tries = F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.struct(F.lit(k).alias("rank"), F.lit(n).alias("indicator"))) for k, (n, p) in enumerate(keywords)]))
    asked = headlines.select(key, on, F.explode(tries).alias("_t")).select(key, on, "_t.rank", "_t.indicator")
    near = asof_nearest(asked, releases.select("indicator", on).withColumn("_v1", F.lit(0)), on, ["indicator"], "_v1", tolerance).where("matched_on is not null")
    first = near.groupBy(key).agg(F.min(F.struct("rank", "indicator", "matched_on")).alias("_m"))
    return headlines.join(first, key, "left").select(*headlines.columns, F.col("_m.indicator").alias("event_indicator"), F.col("_m.matched_on").alias("event_at"))


def point_in_time(vintages: DataFrame, key: str = "series_id", margin: int = 1) -> DataFrame:
    """(key, avail_date, value): what the newest observation known at each publication was worth, ``margin`` business days on.

    Vintages are read in order of publication, then of observation. A revision of an older observation than
    the newest known is stale and ignored; a revision of the newest one counts. Of several on one available
    day the last is kept.
    """
    w = Window.partitionBy(key).orderBy("realtime_start", "obs_date")
    seen = F.max("obs_date").over(w.rowsBetween(Window.unboundedPreceding, 0))
    live = vintages.withColumn("_seen", seen).where("obs_date >= _seen").withColumn("avail_date", business_days_later(F.col("realtime_start"), margin))
    return live.groupBy(key, "avail_date").agg(F.max_by("value", F.struct("realtime_start", "obs_date")).alias("value"))


def splice_prefix(prefix: DataFrame, main: DataFrame, key: str = "series_id") -> DataFrame:
    """``main`` preceded by the rows of ``prefix`` observed before main's first observation of the key.

    Prefix rows are published after the median lag (whole days, cut off) of main's first publications.
    """
    first = main.groupBy(key, "obs_date").agg(F.min("realtime_start").alias("published"))
    facts = first.groupBy(key).agg(F.min("obs_date").alias("start"), F.percentile(F.datediff("published", "obs_date"), F.lit(0.5)).cast("int").alias("lag"))
    before = prefix.join(facts, key).where(F.col("obs_date") < F.col("start")).withColumn("realtime_start", F.date_add("obs_date", F.col("lag")))
    columns = [key, "obs_date", "value", "realtime_start"]
    return before.select(columns).unionByName(main.select(columns))


def vintage_ledger(vintages: DataFrame, key: str = "series_id") -> DataFrame:
    """Per key: distinct observations, rows, first and last observation, and lags of the first publications."""
    totals = vintages.groupBy(key).agg(F.count_distinct("obs_date").alias("n_obs"), F.count("*").alias("n_rows"), F.min("obs_date").alias("first_obs"), F.max("obs_date").alias("last_obs"))
    lags = (vintages.groupBy(key, "obs_date").agg(F.datediff(F.min("realtime_start"), F.col("obs_date")).alias("lag")).groupBy(key)
            .agg(F.percentile("lag", F.lit(0.5)).alias("lag_median"), F.percentile("lag", F.lit(0.95)).alias("lag_p95"), F.max("lag").alias("lag_max")))
    return totals.join(lags, key)


def first_print_last_vintage(vintages: DataFrame, key: str = "series_id") -> DataFrame:
    """Per key and observation: its first and its last published value."""
    return vintages.groupBy(key, "obs_date").agg(F.min_by("value", "realtime_start").alias("first_print"), F.max_by("value", "realtime_start").alias("last_vintage"))


def availability(published: Column, event: Column) -> Column:
    """Whether something captured at ``published`` was known by ``event``; null if either is."""
    return published <= event
