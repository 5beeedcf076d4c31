"""The half-life of surprises inside the likelihood: each evaluation builds its own covariate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.optimise import hessian, minimise_many
from . import estimate
from .estimate import INFEASIBLE, STARTS_A_TASK, Shape

#: Half-lives that are sought, in days.
SHORTEST, LONGEST = 0.5, 3_650.0
FIT = "series string, start int, n int, loglik double, half_life double, delta double, se_half_life double, low double, high double, rounds int, converged boolean, theta array<double>"


def decayed_index(days: np.ndarray, at: np.ndarray, c: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """(days, rates): for each day the contributions up to it, each decayed at each rate by its age; one pass."""
    out, state, k, last = np.empty((len(days), len(rates))), np.zeros(len(rates)), 0, days[0] if len(days) else 0.0
    for t, day in enumerate(days):
        state = state * np.exp(-rates * (day - last))
        while k < len(at) and at[k] <= day:
            state = state + c[k] * np.exp(-rates * (day - at[k]))
            k += 1
        out[t], last = state, day
    return out


def joint_objective(r: np.ndarray, days: np.ndarray, at: np.ndarray, c: np.ndarray, shape: Shape, penalty: float = 0.0):
    """Negative log likelihoods of a batch of (model's vector, log half-life): the index is rebuilt for each, and lagged by a row."""

    def objective(points: np.ndarray) -> np.ndarray:
        points = np.atleast_2d(points)
        inside = np.clip(points[:, -1], math.log(SHORTEST), math.log(LONGEST))
        index = decayed_index(days, at, c, math.log(2) / np.exp(inside))
        x = np.concatenate([np.zeros((1, len(points))), index[:-1]])[:, :, None]
        out = estimate.negative_loglik(points[:, :-1], r, shape, x, penalty) + 100 * (points[:, -1] - inside) ** 2
        return np.where(np.isfinite(out), np.minimum(out, INFEASIBLE), INFEASIBLE)

    return objective


def fit_half_life(series: DataFrame, contributions: DataFrame, shape: Shape = Shape(2, slopes=True), starts: int = 12, rounds: int = 100, penalty: float = 0.0, seed: int = 3, key: str = "asset", order: str = "fecha", r: str = "r") -> DataFrame:
    """Each series' model with slopes on a surprise index whose half-life is a parameter like the others, with its error and 95 % interval.

    ``contributions`` (day, c) are a calendar's events, so at most some rows a day. The best of seeded starts wins; half-lives start anywhere between two
    days and half a year. The error is by the joint curvature, in the logarithm (so the interval is positive); null where that is not positive
    definite, or at the ends of the range that is sought.
    """
    if not shape.slopes:
        raise ValueError("a half-life needs slopes on the index")
    zero = F.lit("1970-01-01").cast("date")
    events = contributions.where("day is not null and c is not null").agg(F.array_sort(F.collect_list(F.struct(F.datediff("day", zero).alias("d"), "c"))).alias("e"))
    days = series.withColumn("_d", F.datediff(F.col(order), zero))
    groups = -(-starts // STARTS_A_TASK)
    jobs = (estimate._packed(days, key, order, [r, "_d"]).join(F.broadcast(events), F.lit(True))
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "series", "group"))

    def run(frames):
        for frame in frames:
            rows = []
            for name, y, d, e, group in zip(frame["series"], frame[r], frame["_d"], frame["e"], frame["group"], strict=True):
                y, d = np.asarray(y, float), np.asarray(d, float)
                objective = joint_objective(y, d, np.array([x["d"] for x in e], float), np.array([x["c"] for x in e], float), shape, penalty)
                own = range(int(group) * STARTS_A_TASK, min(starts, (int(group) + 1) * STARTS_A_TASK))
                first = np.stack([np.append(estimate.random_start(y, shape, seed * 1_000_003 + s), np.random.default_rng((seed, s)).uniform(math.log(2), math.log(180))) for s in own])
                x, value, used, sure = minimise_many(objective, first, rounds)
                best = int(value.argmin())
                for j, s in enumerate(own):
                    se = math.nan
                    if j == best and math.log(SHORTEST) < x[j, -1] < math.log(LONGEST):  # the others can't win
                        bend = hessian(objective, x[j])
                        if np.all(np.isfinite(bend)) and np.linalg.eigvalsh(bend).min() > 0:
                            se = math.sqrt(np.linalg.inv(bend)[-1, -1])
                    h = math.exp(x[j, -1])
                    known = not math.isnan(se)
                    rows.append((name, s, len(y), -float(value[j]), h, math.log(2) / h, h * se if known else None, h * math.exp(-1.96 * se) if known else None, h * math.exp(1.96 * se) if known else None, int(used[j]), bool(sure[j]), x[j, :-1].tolist()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FIT.split(", ")])

    fits = jobs.mapInPandas(run, FIT)
    best = fits.groupBy("series").agg(F.max_by(F.struct(*[c for c in fits.columns if c != "series"]), F.struct("loglik", -F.col("start"))).alias("b"), F.count("*").cast("int").alias("n_starts"), F.count(F.when(F.col("converged"), 1)).alias("n_converged"))
    return best.select("series", "b.*", "n_starts", "n_converged")
