"""Full-window rolling, expanding and cumulative operators over ordered series, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix

TRADING_DAYS = 252


def series(key: str = "asset", order: str = "fecha"):
    """The window of a key's rows in order."""
    return Window.partitionBy(key).orderBy(order)


def log_returns(prices: DataFrame, key: str = "asset", order: str = "fecha", close: str = "close") -> DataFrame:
    """Adds r, the log return in per cent; the first row of each key goes, as do rows without a return."""
    previous = F.lag(close).over(series(key, order))
    ratio = F.when((previous > 0) & (F.col(close) > 0), F.ln(F.col(close) / previous) * 100)
    return prices.withColumn("r", ratio).where("r is not null")


def full_window(value: Column, statistic, width: int, window) -> Column:
    """A statistic of the last ``width`` values, null unless all are there."""
    rows = window.rowsBetween(-(width - 1), 0)
    return F.when(F.count(value).over(rows) == width, statistic(value).over(rows))


def rolling_z(value: Column, width: int, window) -> Column:
    """(x - rolling mean) / rolling sample deviation over a full window."""
    return F.try_divide(value - full_window(value, F.avg, width, window), full_window(value, F.stddev_samp, width, window))


def technical_features(prices: DataFrame, short: int = 20, long: int = 200, band: int = 20, k: float = 2.0, z: int = 250, key: str = "asset", order: str = "fecha", close: str = "close") -> DataFrame:
    """sma_gap, bb_width and bb_width_z of closes, each lagged once, so that row t holds what was known at t-1."""
    w, c = series(key, order), F.col(close)
    raw = prices.withColumns({
        "_gap": F.try_divide(full_window(c, F.avg, short, w) - full_window(c, F.avg, long, w), full_window(c, F.stddev_samp, short, w)),
        "_width": F.try_divide(2 * k * full_window(c, F.stddev_samp, band, w), full_window(c, F.avg, band, w)),
    })
    raw = raw.withColumn("_z", rolling_z(F.col("_width"), z, w))
    return raw.withColumns({n: F.lag(s).over(w) for n, s in (("sma_gap", "_gap"), ("bb_width", "_width"), ("bb_width_z", "_z"))}).drop("_gap", "_width", "_z")


def expanding_surprise_z(calendar: DataFrame, min_count: int = 12, key: str = "indicator", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """z = surprise / expanding sample deviation (current event included), from ``min_count`` events on.

    Events without consensus or actual are left out, never filled in; the surprise is not demeaned.
    """
    valid = calendar.where("actual is not null and consensus is not null").withColumn("surprise", F.col("actual") - F.col("consensus"))
    seen = prefix.scan(valid, [key], list(order), moments={"_m": F.col("surprise")})
    n, sigma = F.col("_m.n"), prefix.sample_deviation(F.col("_m"))
    return seen.withColumns({"n_seen": n, "sigma": sigma, "z": F.when(n >= min_count, F.try_divide(F.col("surprise"), sigma))}).drop("_m")


def equity(returns: DataFrame, r: str = "r", key: str = "asset", order: str = "fecha") -> DataFrame:
    """Adds equity, the exponential of the running sum of per-cent log returns."""
    rows = series(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", F.exp(F.sum(F.col(r) / 100).over(rows)))


def max_drawdown(returns: DataFrame, r: str = "r", key: str = "asset", order: str = "fecha") -> DataFrame:
    """Per key: the least equity/peak - 1, and the greatest 1 - equity/peak (the two conventions)."""
    rows = series(key, order).rowsBetween(Window.unboundedPreceding, 0)
    fall = equity(returns, r, key, order).withColumn("fall", F.col("equity") / F.max("equity").over(rows) - 1)
    return fall.groupBy(key).agg(F.min("fall").alias("drawdown_negative"), F.max(-F.col("fall")).alias("drawdown_positive"))


def annualised(r: Column) -> dict[str, Column]:
    """Mean, volatility and Sharpe ratio (null for no volatility) at 252 days a year."""
    mean, vol = F.avg(r) * TRADING_DAYS, F.stddev_samp(r) * float(TRADING_DAYS) ** 0.5
    return {"ann_mean": mean, "ann_vol": vol, "sharpe": F.try_divide(mean, vol)}


def runs(df: DataFrame, state: str, key: str = "asset", order: str = "fecha") -> DataFrame:
    """Maximal stretches of equal ``state``: key, run_id, state, first, last, n."""
    w = series(key, order)
    change = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_change", change)
    marked = marked.withColumn("run_id", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run_id", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def boundaries(df: DataFrame, block: str, key: str = "asset", order: str = "fecha") -> DataFrame:
    """Adds is_boundary: the block differs from the row's before."""
    return df.withColumn("is_boundary", ~F.lag(block).over(series(key, order)).eqNullSafe(F.col(block)))
