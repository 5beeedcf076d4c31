"""Stationary bootstrap: replicas as rows, blocks of geometric length with wrap-around."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample_index(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """Indices of one replica: each step goes on by one, or with probability 1/block starts anew."""
    fresh = rng.random(n) < 1 / max(block, 1.0)
    fresh[0] = True
    starts = rng.integers(0, n, n)
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return (starts[last] + np.arange(n) - last) % n


def optimal_block(x: np.ndarray) -> float:
    """Politis and White's automatic mean block length for the stationary bootstrap, at least 1."""
    n = len(x)
    e = x - x.mean()
    if n < 8 or not e.any():
        return 1.0
    k = max(5, int(np.ceil(np.sqrt(np.log10(n)))))
    most = int(np.ceil(np.sqrt(n))) + k
    gamma = np.array([(e[j:] * e[: n - j]).sum() / n for j in range(min(most, n - 1) + 1)])
    rho = gamma / gamma[0]
    small = np.abs(rho[1:]) < 2 * np.sqrt(np.log10(n) / n)
    significant = np.flatnonzero(~small) + 1
    # without a run of insignificant lags the last significant one counts
    m = next((j for j in range(len(small) - k + 1) if small[j : j + k].all()), significant[-1] if len(significant) else 1)
    m = max(1, m)
    lags = np.arange(1, min(2 * m, len(gamma) - 1) + 1)
    weight = np.where(lags / (2 * m) <= 0.5, 1.0, 2 * (1 - lags / (2 * m)))
    g = 2 * (weight * lags * gamma[lags]).sum()
    d = 2 * (gamma[0] + 2 * (weight * gamma[lags]).sum()) ** 2
    if d <= 0:
        return 1.0
    return float(min(max(1.0, (2 * g * g / d) ** (1 / 3) * n ** (1 / 3)), np.ceil(min(3 * np.sqrt(n), n / 3))))


def sharpe_ci(returns: DataFrame, replicas: int = 499, level: float = 0.90, seed: int = 42, min_obs: int = 30, key: str = "asset", order: str = "fecha", r: str = "r") -> DataFrame:
    """Per key: n, block, sharpe, low, high and includes_zero. No interval below ``min_obs`` rows, or when fewer
    than max(10, half) of the replicas are finite. Replicas run as tasks of 50."""
    packed = returns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, r))).alias("x")).select(F.col(key).cast("string").alias("key"), F.col(f"x.{r}").alias("r"))
    jobs = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((replicas - 1) // 50)))).repartition("key", "part")
    scale = np.sqrt(252)

    def run(frames):
        for frame in frames:
            rows = []
            for k, x, part in zip(frame["key"], frame["r"], frame["part"], strict=True):
                x = np.asarray(x, float)
                block = optimal_block(x)
                for b in range(part * 50, min(replicas, part * 50 + 50)):
                    y = x[resample_index(len(x), block, np.random.default_rng((seed, b)))]
                    sd = y.std(ddof=1) if len(y) > 1 else 0.0
                    rows.append((k, len(x), block, scale * x.mean() / x.std(ddof=1) if len(x) > 1 and x.std() > 0 else None, scale * y.mean() / sd if sd > 0 else None))
            yield pd.DataFrame(rows, columns=["key", "n", "block", "sharpe", "replica"])

    each = jobs.mapInPandas(run, "key string, n int, block double, sharpe double, replica double")
    tail = (1 - level) / 2
    enough = (F.max("n") >= min_obs) & (F.count("replica") >= max(10, replicas / 2))
    out = each.groupBy("key").agg(F.max("n").alias("n"), F.max("block").alias("block"), F.max("sharpe").alias("sharpe"), F.when(enough, F.percentile("replica", F.lit(tail))).alias("low"), F.when(enough, F.percentile("replica", F.lit(1 - tail))).alias("high"))
    return out.withColumn("includes_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


def _stats(x: np.ndarray) -> dict[str, float]:
    """Annualised mean, volatility and Sharpe ratio, and greatest fall from the peak, of decimal log returns."""
    mean, sd = x.mean() * 252, x.std(ddof=1) * np.sqrt(252) if len(x) > 1 else np.nan
    equity = np.exp(np.cumsum(x))
    return {"mean_ann": mean, "vol_ann": sd, "sharpe": mean / sd if sd > 0 else np.nan, "maxdd": float((equity / np.maximum.accumulate(equity) - 1).min())}


def conditional_stats(history: DataFrame, durations: list[float], replicas: int = 499, block: float = 10.0, level: float = 0.90, min_obs: int = 60, least_days: float = 2.0, seed: int = 42,
                      key: str = "asset", order: str = "fecha", r: str = "r", argmax: str = "argmax_idx") -> DataFrame:
    """(key, regime, metric, value, ci_low, ci_high, n_obs) of a regime's days: mean_ann, vol_ann, sharpe, maxdd.

    Intervals are percentiles of stationary bootstrap replicas; there is none for maxdd, below ``min_obs`` days, for
    regimes expected to last less than ``least_days``, or if fewer than max(10, half) of the replicas are finite. In
    such short-lived or rarely seen regimes mean, Sharpe and maxdd have no value either: they would pretend a year of it.
    A task per key and regime; replicas are seeded by regime.
    """
    kinds = dict(history.dtypes)
    columns = ["regime", "metric", "value", "ci_low", "ci_high", "n_obs"]

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        regime = int(group[1])
        x = part.sort_values(order)[r].to_numpy(float) / 100
        x = x[np.isfinite(x)]
        brief = regime < len(durations) and durations[regime] < least_days
        few = len(x) < min_obs
        point = _stats(x) if len(x) > 1 else dict.fromkeys(("mean_ann", "vol_ann", "sharpe", "maxdd"), 0.0)
        rng = np.random.default_rng(seed + regime)
        each = [_stats(x[resample_index(len(x), block, rng)]) for _ in range(replicas)] if not few and not brief else []
        rows = []
        for name, value in point.items():
            found = np.array([s[name] for s in each])
            found = found[np.isfinite(found)]
            sure = name != "maxdd" and len(found) >= max(10, replicas // 2)
            low, high = np.quantile(found, [(1 - level) / 2, (1 + level) / 2]) if sure else (None, None)
            hidden = (brief or few) and name != "vol_ann"
            rows.append((group[0], regime, name, None if hidden else value if np.isfinite(value) else 0.0, low, high, len(x)))
        return pd.DataFrame(rows, columns=[key, *columns])

    return history.select(key, order, r, argmax).groupBy(key, argmax).applyInPandas(run, f"{key} {kinds[key]}, regime int, metric string, value double, ci_low double, ci_high double, n_obs bigint")
