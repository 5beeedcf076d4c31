"""Checks, flags and small reports over histories, records and fitted models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import normal_cdf, title_key
from ..functions.kernels import Params
from .rolling import runs, series


def regime_labels(k: int) -> list[str]:
    """Names of ``k`` regimes in order of variance, the least first."""
    if k == 1:
        return ["single regime"]
    return ["low volatility", *[f"medium volatility {i}" for i in range(1, k - 1)], "high volatility"]


def params_table(spark: SparkSession, params: Params) -> DataFrame:
    """One row a regime: regime, label, kappa (persistence), p_stay, expected_duration, near_rank_one.

    ``near_rank_one`` (of the whole model) says that all rows of the transition matrix are within 0.05 of the first:
    tomorrow then hardly depends on today.
    """
    a = params.arrays()
    k = len(a["mu"])
    flat = k > 1 and bool((abs(a["P"] - a["P"][0]) < 0.05).all())
    kappa = a["alpha"] + a["gamma"] / 2 + a["beta"]
    rows = [(i, regime_labels(k)[i], float(kappa[i]), float(a["P"][i, i]), float(1 / (1 - min(a["P"][i, i], 1 - 1e-12))), flat) for i in range(k)]
    return spark.createDataFrame(rows, "regime int, label string, kappa double, p_stay double, expected_duration double, near_rank_one boolean")


def empirical_transitions(filtered: DataFrame, k: int = 2, key: str = "asset", order: str = "fecha") -> DataFrame:
    """(key, regime, n, p_0 .. p_(k-1)): shares of the next day's most probable regime after each regime, over a key's filtered days."""
    states = filtered.withColumn("_next", F.lead("argmax_idx").over(Window.partitionBy(key).orderBy(order))).where("_next is not null")
    counts = states.groupBy(key, F.col("argmax_idx").alias("regime")).agg(F.count("*").alias("n"), *[F.count(F.when(F.col("_next") == j, 1)).alias(f"_{j}") for j in range(k)])
    return counts.select(key, "regime", "n", *[(F.col(f"_{j}") / F.col("n")).alias(f"p_{j}") for j in range(k)])


def transition_rows(transitions: DataFrame, k: int = 2, key: str = "asset", near: float = 0.05) -> DataFrame:
    """Adds p_stay, expected_duration (1 / (1 - p), p held below one), degenerate (shorter than two days) and near_rank_one: all rows of a key's matrix within ``near`` of each other."""
    stay = F.element_at(F.array(*[F.col(f"p_{j}") for j in range(k)]), F.col("regime") + 1)
    own = Window.partitionBy(key)  # k rows a key
    flat = F.lit(True)
    for j in range(k):
        flat = flat & (F.max(f"p_{j}").over(own) - F.min(f"p_{j}").over(own) < near)
    out = transitions.withColumns({"p_stay": stay, "near_rank_one": flat & (F.count("*").over(own) > 1)})
    out = out.withColumn("expected_duration", 1 / (1 - F.least("p_stay", F.lit(1 - 1e-12))))
    return out.withColumn("degenerate", F.col("expected_duration") < 2)


def transition_rules(transitions: DataFrame, k: int = 2, key: str = "asset") -> DataFrame:
    """(key, rule, passed) of each key's transition rows: sums of one, entries in range, as many rows as regimes, persistence below one."""
    ps = [F.col(f"p_{j}") for j in range(k)]
    total = ps[0]
    for p in ps[1:]:
        total = total + p
    stay = F.element_at(F.array(*ps), F.col("regime") + 1)
    rules = {"rows_sum_to_one": F.bool_and(F.abs(total - 1) < 1e-9), "entries_in_range": F.bool_and((F.least(*ps) >= 0) & (F.greatest(*ps) <= 1)), "every_regime_is_left": F.bool_and(stay < 1), "all_regimes_seen": F.count("*") == k}
    facts = transitions.groupBy(key).agg(*[c.alias(n) for n, c in rules.items()])
    return facts.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("passed")) for n in rules])).alias("r")).select(key, "r.rule", "r.passed")


def measured_lag(df: DataFrame, feature: str, raw: str, key: str = "asset", order: str = "fecha", most: int = 2) -> DataFrame:
    """(n, shift): rows that have the feature, and by how many rows it lags behind ``raw``: the shift up to ``most`` at which all of them agree, else null."""
    w = Window.partitionBy(key).orderBy(order)
    shifted = df.select(key, F.col(feature).alias("_f"), *[F.lag(raw, j).over(w).alias(f"_{j}") for j in range(most + 1)]).where("_f is not null")
    same = [F.count(F.when(F.col("_f") == F.col(f"_{j}"), 1)) for j in range(most + 1)]
    n = F.count("*")
    return shifted.agg(n.alias("n"), F.coalesce(*[F.when((s == n) & (n > 0), j) for j, s in enumerate(same)]).alias("shift"))


def degenerate(table: DataFrame, least_days: float = 2.0) -> DataFrame:
    """Adds degenerate: the regime is expected to last less than ``least_days``."""
    return table.withColumn("degenerate", F.col("expected_duration") < least_days)


def regime_table(history: DataFrame, table: DataFrame, r: str = "r", argmax: str = "argmax_idx") -> DataFrame:
    """``table`` (of ``params_table``) with days, pct_days and vol_ann (population deviation, as a fraction); null volatility without days."""
    own = history.groupBy(F.col(argmax).alias("regime")).agg(F.count("*").alias("days"), (F.stddev_pop(r) * float(252) ** 0.5 / 100).alias("vol_ann"))
    total = history.agg(F.count("*").alias("total"))
    out = table.join(own, "regime", "left").join(F.broadcast(total), F.lit(True))
    return out.withColumn("days", F.coalesce("days", F.lit(0))).withColumn("pct_days", F.try_divide(100 * F.col("days"), F.col("total"))).drop("total")


def pit_returns(history: DataFrame, mu: Sequence[float], r: str = "r") -> DataFrame:
    """Adds pit: the predictive mixture's distribution function at the return; uniform if the model is calibrated.

    ``history`` has predicted probabilities xi_p_k and variances s2_k, both known a day before.
    """
    z = [(F.col(r) - m) / F.sqrt(f"s2_{k}") for k, m in enumerate(mu)]
    marked = history.withColumns({f"_z{k}": x for k, x in enumerate(z)})
    total = sum((F.col(f"xi_p_{k}") * normal_cdf(F.col(f"_z{k}")) for k in range(len(mu))), F.lit(0.0))
    return marked.withColumn("pit", total).drop(*[f"_z{k}" for k in range(len(mu))])


def gap_report(df: DataFrame, columns: Sequence[str], key: str = "asset", order: str = "fecha") -> DataFrame:
    """(key, feature, n, warm_up, internal, trailing): nulls before, between and after the values of each column.

    Warm-up nulls are a window's; internal ones are holes in the data. A column without values is all warm-up.
    """
    long = df.select(key, order, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(key, order, "x.feature", "x.v")
    seen = F.when(F.col("v").isNotNull(), F.col(order))
    ends = long.groupBy(key, "feature").agg(F.min(seen).alias("a"), F.max(seen).alias("z"))
    empty, at = F.col("v").isNull(), F.col(order)
    count = lambda c: F.count(F.when(empty & c, 1))
    return (long.join(ends, [key, "feature"]).groupBy(key, "feature")
            .agg(F.count("*").alias("n"), count(F.col("a").isNull() | (at < F.col("a"))).alias("warm_up"), count((at > F.col("a")) & (at < F.col("z"))).alias("internal"), count(at > F.col("z")).alias("trailing")))


def high_entropy_runs(history: DataFrame, k: int = 2, share: float = 0.5, entropy: str = "entropy", key: str = "asset", order: str = "fecha") -> DataFrame:
    """Maximal stretches with entropy above ``share`` of ln k: key, first, last, n."""
    marked = history.withColumn("_high", F.col(entropy) > share * F.ln(F.lit(float(k))))
    return runs(marked, "_high", key, order).where("_high").select(key, "first", "last", "n")


def recent(df: DataFrame, days: int, order: str = "fecha") -> DataFrame:
    """The rows of the last ``days`` days before the newest row, which counts."""
    newest = df.agg(F.max(order).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(order) > F.date_sub("_newest", days)).drop("_newest")


def last_rows(df: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """The newest ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def by_size(weights: DataFrame, weight: str, tie: str) -> DataFrame:
    """Adds place: order by absolute weight, the greatest first, nulls last. ``weights`` is a short table, a row an indicator."""
    return weights.withColumn("place", F.row_number().over(Window.orderBy(F.abs(weight).desc_nulls_last(), tie)))


def looked_up(left: DataFrame, right: DataFrame, on: str, value: str, default: float = 0.0) -> DataFrame:
    """``left`` with ``right``'s value at the same ``on``, or ``default``."""
    return left.join(right.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def aligned_sample(returns: DataFrame, features: DataFrame, columns: Sequence[str], start: str | None = None, key: str = "asset", order: str = "fecha") -> DataFrame:
    """Returns with already lagged features of the same day, from ``start`` on, rows with any null gone."""
    both = returns.join(features.select(key, order, *columns), [key, order])
    both = both.where(F.col(order) >= F.lit(start).cast("date")) if start else both
    return both.dropna(subset=["r", *columns])


def checked_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of each column; an error for a flat, empty or non-finite one."""
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if s is None or not 0 < s < float("inf"):
            raise ValueError(f"column {c} has no spread in the training rows")
        out[c] = m, s
    return out


def standardise_with(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns less their given mean, over their given deviation; the scaler is never computed anew."""
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def freshness(df: DataFrame, source: str, at: str, asof: Column, most_days: int) -> DataFrame:
    """(source, last_day, gap_days, stale): how old each source's newest row is."""
    out = df.groupBy(source).agg(F.max(F.col(at).cast("date")).alias("last_day")).withColumn("gap_days", F.datediff(asof, "last_day"))
    return out.withColumn("stale", F.col("gap_days") > most_days)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n, broken): rows that break each rule; a rule that is null for a row is broken there."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.when(~F.coalesce(rule, F.lit(False)), 1)).alias(f"r{i}") for i, rule in enumerate(rules.values())])
    return counts.select("n", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("broken")) for i, name in enumerate(rules)])).alias("x")).select("x.rule", "n", "x.broken")


def valid_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break no rule."""
    for rule in rules.values():
        df = df.where(F.coalesce(rule, F.lit(False)))
    return df


def mapped(df: DataFrame, columns: dict[str, Column], required: Sequence[str]) -> DataFrame:
    """Source rows under the contract's names; rows whose required fields are null or blank are gone."""
    out = df.select(*[c.alias(n) for n, c in columns.items()])
    for c in required:
        out = out.where(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return out


def with_relevance(headlines: DataFrame, cache: DataFrame, title: str = "title") -> DataFrame:
    """``headlines`` with the cached score of their title's key (null if it is not cached). ``cache`` has (key, s)."""
    return headlines.withColumn("key", title_key(F.col(title))).join(cache.select("key", "s"), "key", "left")


def score_missing(headlines: DataFrame, cache: DataFrame, neutral: Callable[[list[str]], list[float]], title: str = "title") -> DataFrame:
    """(key, s) of ``cache`` and of the titles it lacks: s = 1 - P(neutral), how much a title may move, never which way.

    ``neutral`` gives probabilities for a batch of titles; each distinct title is scored once. There is no default model.
    """
    fresh = headlines.where(F.col(title).isNotNull()).withColumn("key", title_key(F.col(title))).join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min(title).alias("title"))

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "s": [1.0 - float(p) for p in neutral(frame["title"].tolist())]})

    return cache.select("key", "s").unionByName(fresh.mapInPandas(run, "key string, s double"))


def history_checks(history: DataFrame, k: int = 2, tolerance: float = 1e-9) -> DataFrame:
    """(rule, n, broken) of what any filter history must hold: probabilities that sum to one and lie in [0, 1], positive variances, finite likelihoods."""
    add = lambda p: sum((F.col(f"{p}_{i}") for i in range(k)), F.lit(0.0))
    within = lambda p: F.least(*[F.col(f"{p}_{i}") for i in range(k)]) >= -tolerance
    finite = F.col("loglik").isNotNull() & ~F.isnan("loglik") & (F.abs("loglik") < float("inf"))
    return violations(history, {"predicted_sum": F.abs(add("xi_p") - 1) <= tolerance, "filtered_sum": F.abs(add("xi_f") - 1) <= tolerance, "predicted_range": within("xi_p"), "filtered_range": within("xi_f"),
                                "variance_positive": F.least(*[F.col(f"s2_{i}") for i in range(k)]) > 0, "loglik_finite": finite})


def transition_checks(spark: SparkSession, params: Params) -> DataFrame:
    """(rule, passed) of a transition matrix: rows sum to one (columns need not: it is not transposed), entries in [0, 1], variances ascend."""
    a = params.arrays()
    P = a["P"]
    rows = [("rows_sum_to_one", bool(abs(P.sum(1) - 1).max() < 1e-9)), ("entries_in_range", bool(P.min() >= 0 and P.max() <= 1)), ("variances_ascend", bool((a["v"][1:] > a["v"][:-1]).all())),
            ("persistence_below_one", bool((a["alpha"] + a["gamma"] / 2 + a["beta"] < 1).all()))]
    return spark.createDataFrame(rows, "rule string, passed boolean")


def reopen_status(coverage: DataFrame, least: dict[str, float]) -> DataFrame:
    """``coverage`` with ready: every count of ``least`` is reached. For what waits until a feed has gathered enough."""
    ready = F.lit(True)
    for column, n in least.items():
        ready = ready & (F.coalesce(F.col(column), F.lit(0)) >= n)
    return coverage.withColumn("ready", ready)


def slope_signs(slopes: DataFrame, priors: dict[str, str]) -> DataFrame:
    """(covariate, origin, target, beta, se) with z, significant, effect on the last regime's probability, and whether the prior agrees.

    The last regime is the reference, so a positive slope towards another lowers its probability. ``priors`` has + or -
    for that effect; a covariate without one has none.
    """
    z = F.when(F.col("se") > 0, F.col("beta") / F.col("se"))
    effect = F.when(F.col("beta") > 0, "-").otherwise("+")
    prior = F.lit(None).cast("string")
    for name, sign in priors.items():
        prior = F.when(F.col("covariate") == name, sign).otherwise(prior)
    agrees = F.when(prior.isNull(), "no prior").when(prior == effect, "agrees").otherwise("contrary")
    return slopes.withColumns({"z": z, "significant": F.coalesce(F.abs(z) >= 1.96, F.lit(False)), "effect": effect, "prior": agrees})


def release_moves(releases: DataFrame, returns: DataFrame, at: str, order: str = "fecha", r: str = "r") -> DataFrame:
    """``releases`` with move, the absolute return of their day; releases on days without a return are gone."""
    return releases.withColumn(order, F.col(at).cast("date")).join(returns.select(order, F.abs(r).alias("move")), order)


def drawdown(history: DataFrame, r: str, key: str, order: str = "fecha") -> DataFrame:
    """(key, drawdown): greatest fall of the equity of per-cent log returns from its peak, as a negative fraction."""
    rows = series(key, order).rowsBetween(Window.unboundedPreceding, 0)
    equity = history.select(key, order, F.exp(F.sum(F.col(r) / 100).over(rows)).alias("e"))
    return equity.withColumn("fall", F.col("e") / F.max("e").over(rows) - 1).groupBy(key).agg(F.min("fall").alias("drawdown"))
