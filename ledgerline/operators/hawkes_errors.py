"""Errors and intervals of fits of the exponential kernel, and how they move with dithering and starts.

Everything here asks for likelihoods and their slopes only, so keys in a task and hot keys cut into stretches (a Spark job a batch of points) go
one way; all keys of a batch go on in step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.optimise import minimise_many
from ..sources.tables import materialise
from . import estimate

#: Fixed value: 97.5 % point of the normal distribution, the root of the likelihood-ratio bound.
Z = 1.959963984540054
ERRORS = "key string, n double, se_mu double, se_alpha double, se_beta double, se_n double, low double, high double, settled boolean"


def _curvature(objective, theta: np.ndarray) -> np.ndarray:
    """Hessians [keys, 3, 3] by differences of the slopes, one call for all keys."""
    m, k = theta.shape
    shifts = 2e-3 * np.concatenate([np.eye(k), -np.eye(k)])
    g = objective((theta[:, None] + shifts).reshape(-1, k), np.repeat(np.arange(m), len(shifts)))[1].reshape(m, 2, k, k)
    out = (g[:, 0] - g[:, 1]) / (2 * 2e-3)
    return (out + out.transpose(0, 2, 1)) / 2


def intervals(objective, theta: np.ndarray, mean: np.ndarray, mean_variance: np.ndarray, most: int = 20, close: float = 5e-3) -> pd.DataFrame:
    """Errors by curvature and likelihood-ratio bounds of the branching ratio, a row a key.

    ``objective(points, own)`` gives negative log likelihoods of log (mu, alpha, beta) of the keys ``own``, and their slopes; ``theta`` are their minima.
    A bound is where the root of twice the fall of the profile likelihood is ``Z``. Each side starts at the curvature's guess, goes
    out until it brackets the bound and then closes in by secants kept inside the bracket, for all keys and sides together. ``settled`` tells that both came within ``close``; it is false where the profile jumps across the
    bound to another mode (in short records a very slow decay can stand in for the base rate): the bound is then the place of the jump.
    """
    keys = len(theta)
    value = objective(theta, np.arange(keys))[0]
    covariance = np.full((keys, 3, 3), np.nan)
    for k, h in enumerate(_curvature(objective, theta)):
        if np.all(np.isfinite(h)) and np.linalg.eigvalsh(h).min() > 0:
            covariance[k] = np.linalg.inv(h)
    at = np.log(mean) + theta[:, 1] - theta[:, 2]  # log n
    spread = np.sqrt(covariance[:, 1, 1] + covariance[:, 2, 2] - 2 * covariance[:, 1, 2])
    spread = np.where(np.isfinite(spread) & (spread > 1e-6), np.minimum(spread, 1.0), 0.3)
    side, own = np.tile([-1.0, 1.0], keys), np.repeat(np.arange(keys), 2)
    inner, away = theta[own][:, [0, 2]].copy(), Z * spread[own]  # away: distance of log n from its estimate
    inside, z_inside, outside, settled = np.zeros(2 * keys), np.zeros(2 * keys), np.full(2 * keys, np.inf), np.zeros(2 * keys, bool)
    z_outside, inner_inside = np.full(2 * keys, np.inf), inner.copy()
    for _ in range(most):
        live = np.flatnonzero(~settled)
        if not len(live):
            break

        def profile(points: np.ndarray, place: np.ndarray, live=live) -> tuple[np.ndarray, np.ndarray]:
            problem = live[place // 2]
            alpha = at[own[problem]] + side[problem] * away[problem] - np.log(mean[own[problem]]) + points[:, 1]
            each, slopes = objective(np.stack([points[:, 0], alpha, points[:, 1]], 1), own[problem])
            return each, np.stack([slopes[:, 0], slopes[:, 1] + slopes[:, 2]], 1)

        # from where the last step ended, and from where the bracket's inner end did
        both = np.stack([inner[live], inner_inside[live]], 1).reshape(-1, 2)
        points, values, _, _ = minimise_many(profile, both, 60, owned=True, slopes=True)
        first = values.reshape(-1, 2).argmin(1)
        inner[live], found = points.reshape(-1, 2, 2)[np.arange(len(live)), first], values.reshape(-1, 2).min(1)
        z = np.sqrt(2 * np.maximum(found - value[own[live]], 0))
        settled[live] = np.abs(z - Z) < close
        short = z < Z
        inner_inside[live] = np.where(short[:, None], inner[live], inner_inside[live])
        inside[live], z_inside[live] = np.where(short, away[live], inside[live]), np.where(short, z, z_inside[live])
        outside[live], z_outside[live] = np.where(short, outside[live], away[live]), np.where(short, z_outside[live], z)
        held = np.isfinite(outside[live])
        share = (Z - z_inside[live]) / np.where(held, z_outside[live] - z_inside[live], 1.0)
        between = inside[live] + np.clip(share, 0.05, 0.95) * np.where(held, outside[live] - inside[live], 0.0)
        further = away[live] + np.minimum(away[live] * np.clip(Z / np.maximum(z, 0.2) - 1, 0.05, 2.0), 1.0)
        away[live] = np.where(settled[live], away[live], np.where(held, between, further))
    se = np.sqrt(np.diagonal(covariance, axis1=1, axis2=2)) * np.exp(theta)
    n = np.exp(at)
    se_n = n * np.sqrt(covariance[:, 1, 1] + covariance[:, 2, 2] - 2 * covariance[:, 1, 2] + mean_variance / mean**2)
    bounds, sure = np.exp(at[own] + side * away).reshape(keys, 2) if most else np.full((keys, 2), np.nan), settled.reshape(keys, 2).all(1)
    return pd.DataFrame({"n": n, "se_mu": se[:, 0], "se_alpha": se[:, 1], "se_beta": se[:, 2], "se_n": se_n, "low": bounds[:, 0], "high": bounds[:, 1], "settled": sure})


def hawkes_intervals(events: DataFrame, horizon: float, fits: DataFrame, key: str = "key", most: int = estimate.HOT_EVENTS, bounds: bool = True) -> DataFrame:
    """(key, n, se_mu, se_alpha, se_beta, se_n, low, high, settled) of ``fits`` (key, mu, alpha, beta): standard errors (NaN where the
    curvature is not positive definite) and the 95 % likelihood-ratio interval of the branching ratio n, at the marks' mean. Without ``bounds`` the interval is not sought: low and high are NaN.

    Keys of more than ``most`` events are cut into stretches, as in ``hawkes_fit``.
    """
    spark, rounds = events.sparkSession, 20 if bounds else 0
    events = events.where("t is not null and s is not null")
    hot, batches = estimate._hot_batches(events, key, most)
    at_fit = fits.select(F.col("key").alias("_key"), "mu", "alpha", "beta")
    columns = [c.split()[0] for c in ERRORS.split(", ")]

    def run(frames):
        for frame in frames:
            for k, t, s, *theta in zip(*(frame[c] for c in ("key", "t", "s", "mu", "alpha", "beta")), strict=True):
                t, s = np.asarray(t, float), np.asarray(s, float)
                out = intervals(lambda p, own, t=t, s=s: estimate.hawkes_value_and_slopes(p, t, s, horizon), np.log([theta]), np.array([s.mean()]), np.array([s.var() / len(s)]), rounds)
                out.insert(0, "key", k)
                yield out[columns]

    jobs = estimate._packed_events(events, hot, key).join(at_fit, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
    out = jobs.repartition("key").mapInPandas(run, ERRORS)
    for batch in batches():
        wanted = spark.createDataFrame([(row["key"], i) for i, row in enumerate(batch)], "_hot string, k int")
        found = at_fit.join(F.broadcast(wanted), F.col("_key").eqNullSafe(F.col("_hot")))
        spreads = events.select(F.col(key).cast("string").alias("_ekey"), "s").join(F.broadcast(wanted), F.col("_ekey").eqNullSafe(F.col("_hot"))).groupBy("k").agg((F.var_pop("s") / F.count("*")).alias("v"))
        known, variance = {r["k"]: r for r in found.select("k", "mu", "alpha", "beta").collect()}, {r["k"]: r["v"] for r in spreads.collect()}
        places = [i for i in range(len(batch)) if i in known]
        if places:
            whole = estimate._hot_objective(estimate._stretches(events, batch, key, "errors"), horizon, lambda own, places=places: np.array(places)[own])
            rows = intervals(whole, np.log([[known[i]["mu"], known[i]["alpha"], known[i]["beta"]] for i in places]), np.array([batch[i]["m"] for i in places]), np.array([variance[i] for i in places]), rounds)
            out = out.unionByName(spark.createDataFrame([(batch[i]["key"], *(float(v) if c != "settled" else bool(v) for c, v in zip(columns[1:], row, strict=True))) for i, row in zip(places, rows[columns[1:]].itertuples(index=False), strict=True)], ERRORS))
    return out


def dithered(binned: DataFrame, width: float, seeds: int, key: str = "key") -> DataFrame:
    """(key, seed, event_id, t, s): each event put anywhere in its bin (t is the bin's start), by a hash of event and seed."""
    u = F.pmod(F.xxhash64("event_id", "seed"), F.lit(1 << 30)) / float(1 << 30)
    rows = binned.select(F.col(key).cast("string").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"), "event_id", "t", "s")
    return rows.withColumn("t", F.col("t") + u * width)


def dither_sweep(binned: DataFrame, width: float, horizon: float, seeds: int = 5, starts: int = 4, rounds: int = 100, key: str = "key") -> DataFrame:
    """(key, seeds, pooled, within, between, total, low, high, between_seeds, between_starts): the branching ratio over ditherings and starts.

    Each (key, seed) is a key of one fit job over its own, newly sorted times; each start of it is kept. n is pooled over seeds by Rubin's
    rules with each fit's own variance; between_seeds and between_starts are standard deviations of the best n over seeds, and of all starts' n about their
    seed's best.
    """
    drawn = materialise(dithered(binned, width, seeds, key).withColumn("fit", F.to_json(F.struct("key", "seed"), {"ignoreNullFields": "false"})), "dither")
    every = materialise(estimate.hawkes_starts(drawn, horizon, starts, rounds=rounds, key="fit"), "starts")
    best = estimate.best_start(every)
    errors = hawkes_intervals(drawn, horizon, best, key="fit", bounds=False)  # pooling asks for variances alone
    named = drawn.select("fit", "key", "seed").distinct()
    rows = best.select(F.col("key").alias("fit"), "branching").join(errors.select(F.col("key").alias("fit"), (F.col("se_n") * F.col("se_n")).alias("variance")), "fit").join(named, "fit")
    m = F.count("*")
    pooled = rows.groupBy("key").agg(m.cast("int").alias("seeds"), F.avg("branching").alias("pooled"), F.avg("variance").alias("within"), F.coalesce(F.var_samp("branching"), F.lit(0.0)).alias("between"))
    total = F.col("within") + (1 + 1 / F.col("seeds")) * F.col("between")
    pooled = pooled.withColumn("total", total).withColumns({"low": F.col("pooled") - Z * F.sqrt("total"), "high": F.col("pooled") + Z * F.sqrt("total"), "between_seeds": F.sqrt("between")})
    top = F.max_by("branching", F.struct("loglik", -F.col("start"))).over(Window.partitionBy("key"))  # a few starts a fit
    about = every.withColumn("gap", F.col("branching") - top).select(F.col("key").alias("fit"), "gap").join(named, "fit")
    starts_ = about.groupBy(F.col("key").alias("_key")).agg(F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("between_starts"))
    return pooled.join(starts_, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
