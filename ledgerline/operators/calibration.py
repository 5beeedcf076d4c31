"""Calibration and forecast comparison as plain aggregates and windows."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import specfun
from ..functions.cleaning import first_argmax


def two_class(filtered: DataFrame) -> DataFrame:
    """Rows (p, y): predicted probability of the last of two regimes, and whether the filter then chose it.

    Only predicted probabilities are calibrated; filtered ones have seen the outcome.
    """
    return filtered.select("*", F.col("xi_p_1").alias("p"), (F.col("xi_f_1") > F.col("xi_f_0")).cast("int").alias("y"))


def brier_logloss(filtered: DataFrame, k: int = 2) -> DataFrame:
    """n, Brier score and log loss over ``k`` classes of the predicted probabilities, and those of the constant forecast.

    The outcome is the filter's first most probable class.
    """
    truth = first_argmax(F.array(*[F.col(f"xi_f_{i}") for i in range(k)]))
    rows = filtered.select(*[F.col(f"xi_p_{i}").alias(f"p{i}") for i in range(k)], *[(truth == i).cast("double").alias(f"y{i}") for i in range(k)])
    clipped = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-15)), F.lit(1e-15))
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    score = add([(F.col(f"p{i}") - F.col(f"y{i}")) * (F.col(f"p{i}") - F.col(f"y{i}")) for i in range(k)])
    loss = add([-F.col(f"y{i}") * F.ln(clipped(F.col(f"p{i}"))) for i in range(k)])
    s = rows.agg(F.count("*").alias("n"), F.avg(score).alias("brier"), F.avg(loss).alias("logloss"), *[F.avg(f"y{i}").alias(f"f{i}") for i in range(k)])
    fs = [F.col(f"f{i}") for i in range(k)]
    return s.select("n", "brier", "logloss", add([f * (1 - f) for f in fs]).alias("brier_base"), add([-f * F.ln(clipped(f)) for f in fs]).alias("logloss_base"))


def top_label(filtered: DataFrame, k: int = 2) -> DataFrame:
    """Rows (confidence, hit): the greatest predicted probability, and whether its class is the one the filter chose."""
    p, f = (F.array(*[F.col(f"{x}_{i}") for i in range(k)]) for x in ("xi_p", "xi_f"))
    return filtered.select(F.array_max(p).alias("confidence"), (first_argmax(p) == first_argmax(f)).cast("double").alias("hit"))


def bin_edges(bins: int) -> list[float]:
    """The inner edges of equal bins of [0, 1]."""
    return [float(x) for x in np.linspace(0.0, 1.0, bins + 1)[1:-1]]


def top_label_reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, bin_lo, bin_hi, n, mean confidence and accuracy of each of ``bins`` equal bins; empty ones stay, with nulls.

    Bins are closed below; a confidence of 1 is in the last.
    """
    edges = bin_edges(bins)
    place = reduce(lambda a, b: a + b, [(F.col("confidence") >= e).cast("int") for e in edges])
    own = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("hit").alias("accuracy"))
    names = [(i, lo, hi) for i, (lo, hi) in enumerate(pairwise([0.0, *edges, 1.0]))]
    return rows.sparkSession.createDataFrame(names, "bin int, bin_lo double, bin_hi double").join(own, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_label_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of the most probable class: bins' gaps weighted by their rows; null without rows."""
    r = top_label_reliability(rows, bins).where("n > 0")
    return r.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))), F.sum("n")).alias("ece"))


def calibration_bundle(filtered: DataFrame, k: int = 2, least_gap: float = 1e-12) -> DataFrame:
    """One row: scores, calibration error, and whether the rows are refused, as predicted and filtered probabilities are the same.

    Filtered probabilities have seen the outcome; calibrating them would be a fraud on oneself.
    """
    gap = F.greatest(*[F.abs(F.col(f"xi_p_{i}") - F.col(f"xi_f_{i}")) for i in range(k)])
    checks = filtered.agg(F.max(gap).alias("max_gap")).withColumn("refused", F.col("max_gap") < least_gap)
    return brier_logloss(filtered, k).crossJoin(top_label_error(top_label(filtered, k))).crossJoin(checks)  # one row each


def _bin(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean forecast and observed share of each of ``bins`` equal bins; empty ones stay, with nulls."""
    own = rows.groupBy(_bin(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(own, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def murphy(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty of the one-class Brier score over bins."""
    r = reliability(rows, bins).where("n > 0")
    base = rows.agg(F.avg(F.col("y").cast("double")).alias("f"))
    j = r.join(F.broadcast(base), F.lit(True))  # one row
    total = F.sum("n")
    return j.agg((F.sum(F.col("n") * (F.col("mean_p") - F.col("observed")) ** 2) / total).alias("reliability"), (F.sum(F.col("n") * (F.col("observed") - F.col("f")) ** 2) / total).alias("resolution"), F.max(F.col("f") * (1 - F.col("f"))).alias("uncertainty"))


def auc(rows: DataFrame, tie: str, cells: int = 1_000) -> DataFrame:
    """Area under the ROC curve by rank sum, ties in order of ``tie``.

    Ranks are counted in cells of p, so no task holds all rows; a window over the cells' counts gives each its first rank.
    """
    placed = rows.withColumn("cell", F.floor(F.col("p") * cells).cast("int"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most cells + 1 rows
    offsets = sizes.select("cell", before.alias("before"))
    ranked = placed.join(F.broadcast(offsets), "cell").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("p", tie)))
    n1, n0 = F.sum("y"), F.sum(1 - F.col("y"))
    return ranked.agg(F.try_divide(F.sum(F.when(F.col("y") == 1, F.col("rank"))) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def autocovariance(df: DataFrame, value: str, lags: int, key: str = "asset", order: str = "fecha") -> DataFrame:
    """(key, lag, gamma): sums of products of deviations ``lag`` apart, over n; one window pass for all lags."""
    w = Window.partitionBy(key).orderBy(order)
    centred = df.withColumn("_e", F.col(value) - F.avg(value).over(Window.partitionBy(key)))
    shifted = centred.withColumns({f"_l{j}": F.lag("_e", j).over(w) for j in range(1, lags + 1)})
    sums = shifted.groupBy(key).agg(*[F.sum(F.col("_e") * (F.col(f"_l{j}") if j else F.col("_e"))).alias(f"g{j}") for j in range(lags + 1)], F.count("*").alias("n"))
    return sums.select(key, F.explode(F.array(*[F.struct(F.lit(j).alias("lag"), (F.col(f"g{j}") / F.col("n")).alias("gamma")) for j in range(lags + 1)])).alias("x")).select(key, "x.lag", "x.gamma")


def dm_lags(n: int, h: int = 1) -> int:
    """Newey-West lags of the comparison: max(h - 1, floor(1.5 n ** (1/3)))."""
    return max(h - 1, int(1.5 * n ** (1 / 3) + 1e-12))


def diebold_mariano(losses: DataFrame, a: str, b: str, h: int = 1, lags: int | None = None, key: str = "asset", order: str = "fecha") -> DataFrame:
    """(key, n, mean_diff, hac_var, stat) of paired losses; negative favours ``a``. Null for no positive variance.

    The statistic has the small-sample factor of Harvey, Leybourne and Newbold.
    """
    d = losses.select(key, order, (F.col(a) - F.col(b)).alias("d"))
    if lags is None:
        lags = dm_lags((d.groupBy(key).count().agg(F.max("count")).first()[0]) or 1, h)
    gamma = autocovariance(d, "d", lags, key, order)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (lags + 1)))
    hac = gamma.groupBy(key).agg(F.sum(weight * F.col("gamma")).alias("hac_var"))
    out = d.groupBy(key).agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff")).join(hac, key)
    n = F.col("n").cast("double")
    stat = F.when(F.col("hac_var") > 0, F.col("mean_diff") / F.sqrt(F.col("hac_var") / n) * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n))
    return out.withColumn("stat", stat)


def dm_p_value(stat: float, n: int) -> float:
    """Two-sided p value by Student's t with n - 1 degrees of freedom."""
    return 2 * specfun.student_sf(abs(stat), n - 1)


def pesaran_timmermann(rows: DataFrame, actual: str, forecast: str) -> DataFrame:
    """n, hit rate, expected hit rate and statistic of directional accuracy; null statistic if degenerate."""
    up, said = (F.col(actual) > 0).cast("double"), (F.col(forecast) > 0).cast("double")
    s = rows.agg(F.count("*").alias("n"), F.avg((up == said).cast("double")).alias("hit"), F.avg(up).alias("py"), F.avg(said).alias("px"))
    py, px, n = F.col("py"), F.col("px"), F.col("n").cast("double")
    star = py * px + (1 - py) * (1 - px)
    v_hit = star * (1 - star) / n
    v_star = ((2 * py - 1) ** 2 * px * (1 - px) + (2 * px - 1) ** 2 * py * (1 - py)) / n + 4 * py * px * (1 - py) * (1 - px) / (n * n)
    return s.select("n", "hit", star.alias("expected"), F.when(v_hit - v_star > 1e-15, (F.col("hit") - star) / F.sqrt(v_hit - v_star)).alias("stat"))


def pt_p_value(stat: float) -> float:
    """One-sided p value of directional accuracy."""
    return 1 - specfun.norm_cdf(stat)


def rubin_pool(rows: DataFrame, estimate: str = "estimate", variance: str = "variance") -> DataFrame:
    """Pooled estimate, within, between and total variance, and relative increase, of repeated imputations."""
    s = rows.agg(F.count("*").alias("m"), F.avg(estimate).alias("pooled"), F.avg(variance).alias("within"), F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("between"))
    extra = (1 + 1 / F.col("m")) * F.col("between")
    return s.withColumns({"total": F.col("within") + extra, "relative_increase": F.try_divide(extra, F.col("within"))})

