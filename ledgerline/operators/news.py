"""News pressure: surprise weights, decayed sums, and marked self-exciting intensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix


def impact_weights(pairs: DataFrame, z: str = "z", move: str = "move", key: str = "indicator", least: int = 3, t_min: float = 2.0) -> DataFrame:
    """Per key, the least-squares slope of |move| on |z|: weight, its standard error and t, and whether |t| >= 2.

    Keys with fewer than ``least`` pairs, or no spread in |z|, have null results.
    """
    x, y = F.abs(F.col(z)), F.abs(F.col(move))
    s = (pairs.where(F.col(z).isNotNull() & F.col(move).isNotNull()).groupBy(key)
         .agg(F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")))
    good = (F.col("n") >= least) & (F.col("sxx") > 0)
    slope = F.when(good, F.col("sxy") / F.col("sxx"))
    sse = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    se = F.when(good & (F.col("n") > 2), F.sqrt(sse / (F.col("n") - 2) / F.col("sxx")))
    out = s.select(key, "n", slope.alias("weight"), se.alias("se"))
    t = F.try_divide("weight", "se")
    return out.withColumns({"t": t, "significant": F.coalesce(F.abs(t) >= t_min, F.lit(False))})


def weighted_events(scored: DataFrame, weights: DataFrame, key: str = "indicator", day: str = "day") -> DataFrame:
    """(day, c): sums of weight times z over a day's events; events without z or weight are left out."""
    return (scored.join(weights.select(key, "weight"), key).where("z is not null and weight is not null")
            .groupBy(day).agg(F.sum(F.col("weight") * F.col("z")).alias("c")))


def surprise_index(events: DataFrame, days: DataFrame, decay: float, day: str = "day") -> DataFrame:
    """(day, value) for each target day: contributions up to the day, each decayed by exp(-decay) a calendar day.

    The decay scan carries sums from block to block of time, so any decay and any span will do.
    """
    stacked = days.select(day).distinct().withColumns({"s": F.lit(0.0), "target": F.lit(1)}).unionByName(events.select(day, F.coalesce("c", F.lit(0.0)).alias("s")).withColumn("target", F.lit(0)))
    dated = stacked.withColumns({"t": F.unix_date(F.col(day).cast("date")).cast("double"), "key": F.lit(0)})
    return decay_scan(dated, decay, ["t", "target"]).where("target = 1").select(day, F.col("a").alias("value"))


def decay_scan(rows: DataFrame, beta: float | Column, order: list[str], key: str = "key") -> DataFrame:
    """Adds a, the sum of s * exp(-beta * (t - t_j)), and before, the sum of s, over the key's rows before each (by ``order``, which starts with t).

    Time is cut into blocks of 24 / beta, so a hot key is many tasks: sums inside a block are scaled to its start, and what
    earlier blocks leave behind comes from one number each. Of these, 32 blocks count; older ones have decayed below 1e-300.
    ``beta`` may be a column of ``rows`` that is constant within a key.
    """
    width = 24.0 / beta
    placed = rows.withColumn("_b", F.floor(F.col("t") / width).cast("bigint"))
    start = F.col("_b") * width
    totals = placed.groupBy(key, "_b").agg(F.sum(F.col("s") * F.exp(-beta * ((F.col("_b") + 1) * width - F.col("t")))).alias("left"), F.sum("s").alias("mass"))
    ahead = totals.select(key, "left", F.explode(F.sequence(F.lit(1), F.lit(32))).alias("_n"), F.col("_b").alias("_from"))
    carried = ahead.groupBy(key, (F.col("_from") + F.col("_n")).alias("_b")).agg(F.sum(F.col("left") * F.exp(-24.0 * (F.col("_n") - 1))).alias("carry"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    sums = totals.select(key, "_b", F.coalesce(F.sum("mass").over(earlier), F.lit(0.0)).alias("mass_before")).join(carried, [key, "_b"], "left")
    w = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({"_in": F.coalesce(F.sum(F.col("s") * F.exp(beta * (F.col("t") - start))).over(w), F.lit(0.0)), "_mass": F.coalesce(F.sum("s").over(w), F.lit(0.0))})
    out = own.join(sums, [key, "_b"])
    a = (F.col("_in") + F.coalesce("carry", F.lit(0.0))) * F.exp(-beta * (F.col("t") - start))
    return out.select(*rows.columns, a.alias("a"), (F.col("mass_before") + F.col("_mass")).alias("before"))


def hawkes_states(events: DataFrame, mu: float, alpha: float, beta: float, key: str = "key") -> DataFrame:
    """(key, event_id, t, s, a, intensity, tau): decay state, intensity and rescaled time at each event."""
    scanned = decay_scan(events.select(key, "event_id", "t", "s"), beta, ["t", "event_id"], key)
    return scanned.withColumns({"intensity": mu + alpha * F.col("a"), "tau": mu * F.col("t") + alpha / beta * (F.col("before") - F.col("a"))}).drop("before")


def lambda_on_grid(events: DataFrame, grid: DataFrame, mu: float, alpha: float, beta: float, inclusive: bool = True, key: str = "key") -> DataFrame:
    """``grid`` (key, t) with lam, the intensity there; events at the very time count if ``inclusive``."""
    stacked = (events.select(key, "t", "s", F.lit(False).alias("_grid"))
               .unionByName(grid.select(key, "t", F.lit(0.0).alias("s"), F.lit(True).alias("_grid"))).withColumn("_last", F.col("_grid") == F.lit(inclusive)))
    return decay_scan(stacked, beta, ["t", "_last"], key).where("_grid").select(key, "t", (mu + alpha * F.col("a")).alias("lam"))


def hawkes_compensator(events: DataFrame, mu: float, alpha: float, beta: float, horizon: float, key: str = "key") -> DataFrame:
    """(key, compensator) at the horizon: a plain aggregate."""
    part = F.sum(F.col("s") * (1 - F.exp(-beta * (horizon - F.col("t")))))
    return events.groupBy(key).agg((F.lit(mu * horizon) + alpha / beta * part).alias("compensator"))


def hawkes_loglik(events: DataFrame, mu: float, alpha: float, beta: float, horizon: float, key: str = "key") -> DataFrame:
    """(key, n, loglik) of the exponential kernel, intensities floored at 1e-300."""
    logs = hawkes_states(events, mu, alpha, beta, key).groupBy(key).agg(F.count("*").alias("n"), F.sum(F.ln(F.greatest("intensity", F.lit(1e-300)))).alias("logs"))
    return logs.join(hawkes_compensator(events, mu, alpha, beta, horizon, key), key).select(key, "n", (F.col("logs") - F.col("compensator")).alias("loglik"))


def rescaled_gaps(states: DataFrame, key: str = "key") -> DataFrame:
    """Adds gap, the difference of successive rescaled times; the first event of a key has none."""
    return prefix.scan(states, [key], ["t", "event_id"], lags={"_before": F.col("tau")}).withColumn("gap", F.col("tau") - F.col("_before")).where("gap is not null").drop("_before")


def ks_exponential(gaps: DataFrame, key: str = "key") -> DataFrame:
    """(key, n, d, p): greatest distance of the gaps' distribution from the unit exponential, and its asymptotic p value."""
    ranked = prefix.scan(gaps.select(key, "gap"), [key], ["gap"], position="i").withColumn("f", 1 - F.exp(-F.col("gap")))
    sizes = ranked.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    ranked = ranked.join(sizes, F.col(key).eqNullSafe(F.col("_key")))
    out = ranked.groupBy(key).agg(F.max("n").alias("n"), F.max(F.greatest(F.col("i") / F.col("n") - F.col("f"), F.col("f") - (F.col("i") - 1) / F.col("n"))).alias("d"))
    x2 = F.col("n") * F.col("d") * F.col("d")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x2))
    # where the series converges too slowly the distance is as small as can be
    return out.withColumn("p", F.when(x2 < 0.04, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0))))


def lambda_daily(events: DataFrame, mu: float, alpha: float, beta: float, days: DataFrame, key: str = "key") -> DataFrame:
    """(key, day_no, lam): intensity at the end of each day, events up to and at it; null outside a key's coverage.

    ``days`` has (day_no).
    """
    bounds = events.groupBy(key).agg(F.floor(F.min("t")).alias("lo"), F.floor(F.max("t")).alias("hi"))
    grid = bounds.join(F.broadcast(days), F.lit(True)).select(key, "day_no", (F.col("day_no") + 1).cast("double").alias("t"), ((F.col("day_no") >= F.col("lo")) & (F.col("day_no") <= F.col("hi"))).alias("covered"))
    lam = lambda_on_grid(events, grid.select(key, "t"), mu, alpha, beta, True, key)
    return grid.join(lam, [key, "t"]).select(key, F.col("day_no").cast("bigint").alias("day_no"), F.when(F.col("covered"), F.col("lam")).alias("lam"))


def branching(events: DataFrame, alpha: float, beta: float, var_alpha: float, var_beta: float, cov: float, key: str = "key", level: float = 1.959963984540054, cap: float = 0.95) -> DataFrame:
    """n = alpha E[s] / beta per key with a delta-method interval; cascade 1/(1-n), null if the interval reaches ``cap``."""
    s = events.groupBy(key).agg(F.count("*").alias("events"), F.avg("s").alias("m"), (F.var_samp("s") / F.count("*")).alias("vm"))
    n = F.col("m") * alpha / beta
    variance = (F.col("m") / beta) ** 2 * var_alpha + (F.col("m") * alpha / beta**2) ** 2 * var_beta - 2 * F.col("m") ** 2 * alpha / beta**3 * cov + F.coalesce("vm", F.lit(0.0)) * (alpha / beta) ** 2
    out = s.select(key, "events", n.alias("n"), F.sqrt(variance).alias("se"))
    out = out.withColumns({"low": F.col("n") - level * F.col("se"), "high": F.col("n") + level * F.col("se")})
    return out.withColumns({"bounded": F.col("high") < cap, "cascade": F.when((F.col("high") < cap) & (F.col("n") < 1), 1 / (1 - F.col("n")))})


def attribution(df: DataFrame, parts: dict[str, tuple[str, float]], active: set[str]) -> DataFrame:
    """Shares share_<name> of |weight * column|, inactive parts 0; if all are 0 the first takes all."""
    sizes = {n: F.abs(F.col(c) * w) if n in active else F.lit(0.0) for n, (c, w) in parts.items()}
    total = sum(sizes.values(), F.lit(0.0))
    first = next(iter(parts))
    return df.withColumns({f"share_{n}": F.when(total > 0, s / total).otherwise(1.0 if n == first else 0.0) for n, s in sizes.items()})
