"""The de-risking rule and its economics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bootstrap import sharpe_ci
from .rolling import annualised, series


def derisk(history: DataFrame, signal: str, threshold: float = 0.5, reduced: float = 0.0, cost_bp: float = 2.0, key: str = "asset", order: str = "fecha", r: str = "r") -> DataFrame:
    """Adds w (1 where yesterday's signal is at most ``threshold``, 1 on the first day), turnover and r_strategy."""
    w = series(key, order)
    weight = F.when(F.coalesce(F.lag(signal).over(w), F.lit(0.0)) <= threshold, 1.0).otherwise(reduced)
    out = history.withColumn("w", weight)
    out = out.withColumn("turnover", F.abs(F.col("w") - F.coalesce(F.lag("w").over(w), F.lit(1.0))))
    return out.withColumn("r_strategy", F.col("w") * F.col(r) - F.col("turnover") * cost_bp * 0.01)


def summary(strategy: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    """Per group: Sharpe ratios of the rule and of holding, mean exposure, and number of changes."""
    rule, hold = annualised(F.col("r_strategy")), annualised(F.col(r))
    return strategy.groupBy(*by).agg(F.count("*").alias("n"), rule["sharpe"].alias("sharpe_rule"), hold["sharpe"].alias("sharpe_hold"), F.avg("w").alias("exposure"), F.count(F.when(F.col("turnover") > 0, 1)).alias("n_changes"))


def momentum(history: DataFrame, column: str, steps: int = 5, key: str = "asset", order: str = "fecha") -> DataFrame:
    """Adds momentum: the column less its value ``steps`` rows before; 0 before there is one."""
    return history.withColumn("momentum", F.coalesce(F.col(column) - F.lag(column, steps).over(Window.partitionBy(key).orderBy(order)), F.lit(0.0)))


def cost_sensitivity(history: DataFrame, signal: str, costs: list[float], threshold: float = 0.5, reduced: float = 0.0, key: str = "asset", order: str = "fecha", r: str = "r") -> DataFrame:
    """Per key and cost: Sharpe ratios of the rule, of holding and of their difference, means, volatilities, exposure, changes and turnover."""
    runs = reduce(lambda a, b: a.unionByName(b), [derisk(history, signal, threshold, reduced, c, key, order, r).withColumn("cost_bp", F.lit(float(c))) for c in costs])
    diff = F.col("r_strategy") - F.col(r)
    rule, hold, gain = annualised(F.col("r_strategy")), annualised(F.col(r)), annualised(diff)
    return runs.groupBy(key, "cost_bp").agg(
        F.count("*").alias("n"), rule["sharpe"].alias("sharpe_rule"), hold["sharpe"].alias("sharpe_hold"), gain["sharpe"].alias("sharpe_diff"), rule["ann_mean"].alias("ann_rule"), hold["ann_mean"].alias("ann_hold"),
        rule["ann_vol"].alias("vol_rule"), hold["ann_vol"].alias("vol_hold"), F.avg((F.col("w") > 0).cast("double")).alias("exposure"), F.count(F.when(F.col("turnover") > 0, 1)).alias("n_changes"), F.sum("turnover").alias("turnover"))


def verdict(history: DataFrame, signal: str, cost_bp: float = 2.0, replicas: int = 499, threshold: float = 0.5, reduced: float = 0.0, key: str = "asset", order: str = "fecha", r: str = "r") -> DataFrame:
    """Per key: bootstrap interval (95 %) of the Sharpe ratio of rule less holding, and success: it lies above zero."""
    strategy = derisk(history, signal, threshold, reduced, cost_bp, key, order, r).withColumn("_diff", F.col("r_strategy") - F.col(r))
    return sharpe_ci(strategy, replicas, 0.95, key=key, order=order, r="_diff").withColumn("success", F.coalesce(F.col("low") > 0, F.lit(False)))
