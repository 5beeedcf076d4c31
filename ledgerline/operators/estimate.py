"""Maximum likelihood as Spark work: a row per (series, group of starts), a minimum to reduce.

A model's parameters are kept unconstrained in named blocks (``Shape``): logits of moving, slopes of these on a lagged
covariate, levels, variances as a first one and growth factors above one, persistence as a logistic that two
sticks break into alpha, gamma / 2 and beta, and tails. Infeasible points are worth 1e12.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.optimise import hessian, minimise, minimise_many
from ..sources.tables import materialise

INFEASIBLE = 1e12
STARTS_A_TASK = 3


@dataclass(frozen=True)
class Shape:
    """What a model has: regimes, Student's t or normal, and slopes on a covariate or not."""

    k: int = 2
    student: bool = False
    slopes: bool = False

    @property
    def blocks(self) -> list[tuple[str, int]]:
        k = self.k
        moves = k * (k - 1)
        return [("moves", moves), ("slopes", moves if self.slopes else 0), ("level", k), ("spread", k), ("memory", k), ("sticks", 2 * k), ("tails", k if self.student else 0)]

    @property
    def size(self) -> int:
        return sum(n for _, n in self.blocks)

    def split(self, theta: np.ndarray) -> dict[str, np.ndarray]:
        """The blocks of a batch of vectors."""
        theta, out, at = np.atleast_2d(theta), {}, 0
        for name, n in self.blocks:
            out[name] = theta[:, at : at + n]
            at += n
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _rows_of(moves: np.ndarray, k: int) -> np.ndarray:
    """Transition matrices of logits (batch, k * (k - 1)), the last column as reference."""
    z = np.concatenate([moves.reshape(len(moves), k, k - 1), np.zeros((len(moves), k, 1))], 2)
    z = np.exp(z - z.max(2, keepdims=True))
    return z / z.sum(2, keepdims=True)


def unpack(theta: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Natural parameters of a batch of vectors: arrays (batch, K), and P (batch, K, K) at a covariate of 0."""
    b, k = shape.split(theta), shape.k
    growth = np.concatenate([np.ones((len(b["spread"]), 1)), 1 + np.exp(np.clip(b["spread"][:, 1:], -40, 40))], 1)
    v = np.exp(np.clip(b["spread"][:, :1], -40, 40)) * np.cumprod(growth, 1)
    p = _logistic(b["memory"])
    first, second = _logistic(b["sticks"][:, :k]), _logistic(b["sticks"][:, k:])
    out = {"mu": b["level"], "v": v, "p": p, "alpha": p * first, "gamma": 2 * p * (1 - first) * second, "beta": p * (1 - first) * (1 - second), "omega": v * (1 - p), "P": _rows_of(b["moves"], k)}
    if shape.student:
        out["nu"] = 2 + np.exp(np.clip(b["tails"], -20, 8))
    if shape.slopes:
        out["B"] = b["slopes"].reshape(len(b["slopes"]), k, k - 1)
    return out


def pack(shape: Shape, mu, v, alpha, gamma, beta, P, nu=None, B=None) -> np.ndarray:
    """The vector of natural parameters (of one model)."""
    mu, v, alpha, gamma, beta, P = (np.asarray(x, float) for x in (mu, v, alpha, gamma, beta, P))
    p = alpha + gamma / 2 + beta
    rest = gamma / 2 + beta
    parts = {"moves": np.log(P[:, :-1] / P[:, -1:]).ravel(), "slopes": np.zeros(shape.k * (shape.k - 1)) if B is None else np.asarray(B, float).ravel(), "level": mu,
             "spread": np.append(np.log(v[0]), np.log(np.maximum(v[1:] / v[:-1] - 1, 1e-6))), "memory": _logit(p), "sticks": np.append(_logit(alpha / p), _logit(gamma / 2 / rest)),
             "tails": np.log(np.full(shape.k, 6.0) if nu is None else np.asarray(nu, float) - 2)}
    return np.concatenate([parts[name] for name, n in shape.blocks if n] or [np.zeros(0)])


def _stationary(P: np.ndarray) -> np.ndarray:
    """Stationary distributions of a batch of matrices."""
    k = P.shape[-1]
    A = np.swapaxes(P, 1, 2) - np.eye(k)
    A[:, -1] = 1
    rhs = np.zeros((len(P), k, 1))
    rhs[:, -1] = 1
    x = np.linalg.solve(A + 1e-12 * np.eye(k), rhs)[..., 0].clip(0)
    return x / x.sum(1, keepdims=True)


def step_logliks(theta: np.ndarray, r: np.ndarray, shape: Shape, x: np.ndarray | None = None, states: bool = False):
    """Log likelihood (T, batch) of each step, given those before it, under a batch of vectors; with ``states`` also predicted and filtered probabilities."""
    n = unpack(theta, shape)
    s2 = kernels.gjr_variances(r, n["mu"], n["omega"], n["alpha"], n["gamma"], n["beta"], n["v"])
    logf = kernels.log_density(r, n["mu"], s2, n.get("nu"))
    moves = shape.split(theta)["moves"]
    if shape.k == 1:
        one = np.ones_like(logf)
        return (logf[..., 0], one, one) if states else logf[..., 0]
    top = logf.max(-1, keepdims=True)
    f = np.exp(logf - top)
    totals, xi, P = np.empty((*logf.shape[:-1], 1)), _stationary(n["P"])[:, None, :], n["P"]
    kept = [np.empty_like(logf), np.empty_like(logf)] if states else None
    slopes = n["B"].reshape(len(moves), -1) if x is not None else None
    for t in range(len(r)):
        if t:
            xi = xi @ (P if x is None else _rows_of(moves + slopes * x[t], shape.k))
        w = xi[:, 0] * f[t]
        total = w.sum(-1, keepdims=True)
        totals[t] = total
        if states:
            kept[0][t], kept[1][t] = xi[:, 0], w / total
        xi = (w / total)[:, None, :]
    ll = (np.log(totals) + top)[..., 0]
    return (ll, *kept) if states else ll


#: Numbers of one batch of step matrices; more points go in several batches.
STEP_NUMBERS = 4_000_000


def total_loglik(theta: np.ndarray, r: np.ndarray, shape: Shape, x: np.ndarray | None = None) -> np.ndarray:
    """Log likelihoods of a batch of vectors: the sum of ``step_logliks``, without the states.

    A step multiplies the regimes' weights by a small matrix, and products of matrices may be taken in any grouping: neighbours are
    multiplied for all steps at once, then their products, some dozen passes instead of one for each day. Each product is scaled
    by its greatest entry, whose logarithm is kept.
    """
    theta, k = np.atleast_2d(theta), shape.k
    most = max(1, STEP_NUMBERS // max(1, len(r) * k * k))
    if len(theta) > most:
        cut = lambda a: x[:, a : a + most] if x is not None and x.ndim > 1 else x
        return np.concatenate([total_loglik(theta[a : a + most], r, shape, cut(a)) for a in range(0, len(theta), most)])
    n = unpack(theta, shape)
    s2 = kernels.gjr_variances(r, n["mu"], n["omega"], n["alpha"], n["gamma"], n["beta"], n["v"])
    logf = kernels.log_density(r, n["mu"], s2, n.get("nu"))
    if k == 1 or not len(r):
        return logf[..., 0].sum(0)
    top = logf.max(-1)
    f = np.exp(logf - top[..., None])
    if x is None or len(r) == 1:
        P = n["P"][None]
    else:
        logits = shape.split(theta)["moves"] + n["B"].reshape(len(theta), -1) * np.asarray(x, float)[1:].reshape(len(r) - 1, -1, 1)
        P = _rows_of(logits.reshape(-1, logits.shape[-1]), k).reshape(len(r) - 1, len(theta), k, k)
    steps = [[P[..., i, j] * f[1:, :, j] for j in range(k)] for i in range(k)]
    start = _stationary(n["P"]) * f[0]
    total = top.sum(0)
    while len(steps[0][0]) > 1:
        odd = len(steps[0][0]) % 2
        a, b = [[m[: len(m) - odd : 2] for m in row] for row in steps], [[m[1::2] for m in row] for row in steps]
        both = [[sum(a[i][h] * b[h][j] for h in range(k)) for j in range(k)] for i in range(k)]
        scale = np.maximum.reduce([m for row in both for m in row])
        total = total + np.log(scale).sum(0)
        steps = [[np.concatenate([m / scale, last[-1:]]) if odd else m / scale for m, last in zip(row, old, strict=True)] for row, old in zip(both, steps, strict=True)]
    if len(steps[0][0]):
        start = np.stack([sum(start[:, i] * steps[i][j][0] for i in range(k)) for j in range(k)], 1)
    return total + np.log(start.sum(1))


def negative_loglik(theta: np.ndarray, r: np.ndarray, shape: Shape, x: np.ndarray | None = None, penalty: float = 0.0) -> np.ndarray:
    """Negative log likelihoods of a batch of vectors, plus ``penalty`` times the smoothed absolute slopes."""
    with np.errstate(all="ignore"):
        out = -total_loglik(theta, r, shape, x)
    if penalty:
        out = out + penalty * np.sqrt(shape.split(theta)["slopes"] ** 2 + 1e-6).sum(1)
    return np.where(np.isfinite(out), np.minimum(out, INFEASIBLE), INFEASIBLE)


def random_start(r: np.ndarray, shape: Shape, seed: int) -> np.ndarray:
    """A start drawn in natural parameters, by its own seed."""
    g, k = np.random.default_rng(seed), shape.k
    v = np.sort(r.var() * np.exp(g.normal(0, 0.7, k)) * np.linspace(0.6, 1.8, k))
    v = np.maximum.accumulate(v * (1 + 1e-3 * np.arange(k)))
    p = g.uniform(0.7, 0.97, k)
    alpha, gamma = p * g.uniform(0.03, 0.12, k), p * g.uniform(0.01, 0.1, k)
    stay = g.uniform(0.85, 0.98, k)
    P = np.full((k, k), 0.0) + (1 - stay)[:, None] / max(k - 1, 1)
    P[np.arange(k), np.arange(k)] = stay if k > 1 else 1.0
    mu = r.mean() + g.normal(0, 0.1 * r.std(), k)
    return pack(shape, mu, v, alpha, gamma, p - alpha - gamma / 2, P, 2 + np.exp(g.normal(1.5, 0.5, k)), g.normal(0, 0.1, k * (k - 1)))


FIT = "series string, start int, k int, n int, loglik double, bic double, aic double, rounds int, converged boolean, theta array<double>"


def _packed(series: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(series, columns as arrays in order): one row a key, some thousand numbers of one asset's days."""
    whole = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), *columns))).alias("_x"))
    return whole.select(F.col(key).cast("string").alias("series"), *[F.col(f"_x.{c}").alias(c) for c in columns])


def fit_starts(series: DataFrame, shape: Shape = Shape(), starts: int = 20, seed: int = 42, rounds: int = 100, penalty: float = 0.0, key: str = "asset", order: str = "fecha", r: str = "r", covariate: str | None = None) -> DataFrame:
    """One row per (series, start): its log likelihood, BIC, AIC, whether it converged, and its parameters.

    ``STARTS_A_TASK`` starts of a series go on in step in one task. ``covariate`` names a lagged column, wanted exactly if
    the shape has slopes.
    """
    if shape.slopes != (covariate is not None):
        raise ValueError("a lagged covariate goes with slopes, and only with them")
    columns = [r, *([covariate] if covariate else [])]
    groups = -(-starts // STARTS_A_TASK)
    jobs = _packed(series, key, order, columns).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    jobs = jobs.repartition(max(groups, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "series", "group")  # many series, many tasks

    def run(frames):
        for frame in frames:
            rows = []
            for i in range(len(frame)):
                y = np.asarray(frame[r].iloc[i], float)
                x = np.asarray(frame[covariate].iloc[i], float) if covariate else None
                own = range(int(frame["group"].iloc[i]) * STARTS_A_TASK, min(starts, (int(frame["group"].iloc[i]) + 1) * STARTS_A_TASK))
                theta, _, used, sure = minimise_many(lambda t, y=y, x=x: negative_loglik(t, y, shape, x, penalty), np.stack([random_start(y, shape, seed * 1_000_003 + s) for s in own]), rounds)
                value = negative_loglik(theta, y, shape, x)
                rows += [(frame["series"].iloc[i], s, shape.k, len(y), -value[j], 2 * value[j] + shape.size * np.log(len(y)), 2 * value[j] + 2 * shape.size, int(used[j]), bool(sure[j]), theta[j].tolist()) for j, s in enumerate(own)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FIT.split(", ")])

    return jobs.mapInPandas(run, FIT)


def best_fit(fits: DataFrame) -> DataFrame:
    """The best start of each series (the first of equal ones), how many starts came within 1e-5 a row of it, and how many converged at all."""
    best = fits.groupBy("series", "k").agg(F.min_by(F.struct(*[c for c in fits.columns if c not in ("series", "k")]), F.struct(-F.col("loglik"), F.col("start"))).alias("b"))
    close = (fits.join(best.select("series", "k", F.col("b.loglik").alias("top")), ["series", "k"]).groupBy("series", "k")
             .agg(F.count("*").alias("n_starts"), F.count(F.when(F.col("top") - F.col("loglik") <= 1e-5 * F.col("n"), 1)).alias("n_converged"), F.count(F.when(F.col("converged"), 1)).alias("n_stopped_by_rule")))
    return best.select("series", "k", "b.*").join(close, ["series", "k"])


def out_of_sample(assigned: DataFrame, fits: DataFrame, shape: Shape, key: str = "block", order: str = "fecha", r: str = "r", covariate: str | None = None) -> DataFrame:
    """Test rows of each block under its fit: xi_p_k, xi_f_k, loglik and the predicted mean, filtered on from the block's train rows.

    ``assigned`` has the part (train or test) of each row; a block is some years of one asset's days.
    """
    columns = [r, "part", *([covariate] if covariate else [])]
    kinds = dict(assigned.dtypes)
    jobs = fits.select("series", "theta").join(_packed(assigned.withColumn("_at", F.col(order)), key, order, ["_at", *columns]), "series")
    names = [f"xi_{p}_{i}" for p in "pf" for i in range(shape.k)]
    spec = ", ".join([f"{key} string", f"{order} {kinds[order]}", "r double", *[f"{n} double" for n in names], "loglik double", "r_pred_mean double"])

    def run(frames):
        for frame in frames:
            for i in range(len(frame)):
                row = frame.iloc[i]
                theta = np.asarray(row["theta"], float)
                ll, predicted, filtered = step_logliks(theta[None], np.asarray(row[r], float), shape, np.asarray(row[covariate], float) if covariate else None, states=True)
                test = np.asarray(row["part"]) == "test"
                mean = predicted[:, 0] @ unpack(theta, shape)["mu"][0]
                out = pd.DataFrame(np.concatenate([predicted[test, 0], filtered[test, 0]], 1), columns=names)
                out.insert(0, "r", np.asarray(row[r], float)[test])
                out.insert(0, order, np.asarray(row["_at"])[test])
                out.insert(0, key, row["series"])
                yield out.assign(loglik=ll[test, 0], r_pred_mean=mean[test])

    return jobs.mapInPandas(run, spec)


def score_test(assigned: DataFrame, fits: DataFrame, shape: Shape, key: str = "block", order: str = "fecha", r: str = "r") -> DataFrame:
    """``fits`` with n_test and test_loglik of each block's test rows."""
    rows = out_of_sample(assigned, fits, shape, key, order, r).groupBy(F.col(key).alias("series")).agg(F.count("*").cast("int").alias("n_test"), F.sum("loglik").alias("test_loglik"))
    return fits.join(rows, "series", "left").withColumns({"n_test": F.coalesce("n_test", F.lit(0)), "test_loglik": F.coalesce("test_loglik", F.lit(0.0))})


def covariance(theta: np.ndarray, r: np.ndarray, shape: Shape, x: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the unconstrained parameters, by the inverse Hessian."""
    return np.linalg.pinv(hessian(lambda t: negative_loglik(t, r, shape, x), theta))


def standard_errors(theta: np.ndarray, r: np.ndarray, shape: Shape, x: np.ndarray | None = None) -> np.ndarray:
    """Of the unconstrained parameters; NaN where the inverse Hessian is not positive."""
    d = np.diag(covariance(theta, r, shape, x))
    return np.sqrt(np.where(d > 0, d, np.nan))


def _natural(theta: np.ndarray, shape: Shape) -> tuple[list[str], np.ndarray]:
    """Names and values (batch, m) of the natural parameters."""
    n = unpack(theta, shape)
    names, values = [], []
    for name in ("mu", "v", "alpha", "gamma", "beta", "nu"):
        if name in n:
            names += [f"{name}_{i}" for i in range(shape.k)]
            values.append(n[name])
    for name in ("P", "B"):
        if name in n and shape.k > 1:
            a = n[name]
            names += [f"{name}_{i}{j}" for i in range(a.shape[1]) for j in range(a.shape[2])]
            values.append(a.reshape(len(a), -1))
    return names, np.concatenate(values, 1)


def parameter_table(series: DataFrame, fits: DataFrame, shape: Shape, key: str = "asset", order: str = "fecha", r: str = "r", covariate: str | None = None) -> DataFrame:
    """(series, parameter, estimate, se): natural parameters of the fits with delta-method standard errors, null where there is none."""
    columns = [r, *([covariate] if covariate else [])]
    jobs = fits.select("series", "theta").join(_packed(series, key, order, columns), "series")

    def run(frames):
        for frame in frames:
            for i in range(len(frame)):
                theta, y = np.asarray(frame["theta"].iloc[i], float), np.asarray(frame[r].iloc[i], float)
                x = np.asarray(frame[covariate].iloc[i], float) if covariate else None
                names, value = _natural(theta, shape)
                h = 1e-5 * np.maximum(1.0, np.abs(theta))
                J = ((_natural(theta + np.diag(h), shape)[1] - _natural(theta - np.diag(h), shape)[1]) / (2 * h)[:, None]).T
                var = np.einsum("ij,jk,ik->i", J, covariance(theta, y, shape, x), J)
                yield pd.DataFrame({"series": frame["series"].iloc[i], "parameter": names, "estimate": value[0], "se": [float(np.sqrt(q)) if q > 0 else None for q in var]})

    return jobs.mapInPandas(run, "series string, parameter string, estimate double, se double")


def choose_penalty(series: DataFrame, shape: Shape, grid: list[float], covariate: str, folds: int = 3, starts: int = 4, rounds: int = 100, key: str = "asset", order: str = "fecha", r: str = "r") -> DataFrame:
    """(series, penalty, score, chosen): penalties of the slopes by temporal cross-validation.

    The rows are cut into folds + 1 stretches; fold f is fitted to the first f of them and scored on the next. The best
    sum of scores wins, the first of ``grid`` among equals. A job per (series, fold, penalty).
    """
    columns = [r, covariate]
    jobs = (_packed(series, key, order, columns).withColumn("penalty", F.explode(F.lit([float(x) for x in grid]))).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
            .repartition(len(grid) * folds, "series", "penalty", "fold"))

    def run(frames):
        for frame in frames:
            rows = []
            for name, y, x, penalty, fold in zip(frame["series"], frame[r], frame[covariate], frame["penalty"], frame["fold"], strict=True):
                y, x = np.asarray(y, float), np.asarray(x, float)
                a, b = len(y) * fold // (folds + 1), len(y) * (fold + 1) // (folds + 1)
                theta, value, _, _ = minimise_many(lambda t, y=y[:a], x=x[:a], p=penalty: negative_loglik(t, y, shape, x, p), np.stack([random_start(y[:a], shape, 91 + s) for s in range(starts)]), rounds)
                rows.append((name, float(penalty), float(step_logliks(theta[value.argmin()][None], y[:b], shape, x[:b])[a:].sum())))
            yield pd.DataFrame(rows, columns=["series", "penalty", "score"])

    scores = jobs.mapInPandas(run, "series string, penalty double, score double").groupBy("series", "penalty").agg(F.sum("score").alias("score"))
    best = scores.groupBy("series").agg(F.min_by("penalty", F.struct(-F.col("score"), F.array_position(F.lit([float(x) for x in grid]), F.col("penalty")))).alias("_best"))
    return scores.join(best, "series").select("series", "penalty", "score", (F.col("penalty") == F.col("_best")).alias("chosen"))


def fit_decay(series: DataFrame, contributions: DataFrame, half_lives: list[float], shape: Shape, starts: int = 4, rounds: int = 100, key: str = "asset", order: str = "fecha", r: str = "r") -> DataFrame:
    """(series, half_life, loglik, chosen): profile likelihood of the decay of a surprise covariate.

    For each half-life (in days) the index of ``contributions`` (day, c) is built, lagged by a row, and the model with
    slopes on it is fitted; the greatest likelihood wins. Contributions are a calendar's events, a row a day.
    """
    events = contributions.agg(F.array_sort(F.collect_list(F.struct(F.datediff("day", F.lit("1970-01-01").cast("date")).alias("d"), "c"))).alias("e"))
    days = series.withColumn("_d", F.datediff(F.col(order), F.lit("1970-01-01").cast("date")))
    jobs = _packed(days, key, order, [r, "_d"]).join(F.broadcast(events), F.lit(True)).withColumn("half_life", F.explode(F.lit([float(h) for h in half_lives]))).repartition(len(half_lives), "series", "half_life")

    def run(frames):
        for frame in frames:
            rows = []
            for name, y, d, e, h in zip(frame["series"], frame[r], frame["_d"], frame["e"], frame["half_life"], strict=True):
                y, d = np.asarray(y, float), np.asarray(d, float)
                at, c = np.array([x["d"] for x in e], float), np.array([x["c"] for x in e], float)
                state, k, last, index = 0.0, 0, d[0], np.zeros(len(d))
                rate = np.log(2) / h
                for t, day in enumerate(d):
                    state *= np.exp(-rate * (day - last))
                    while k < len(at) and at[k] <= day:
                        state += c[k] * np.exp(-rate * (day - at[k]))
                        k += 1
                    last, index[t] = day, state
                x = np.append(0.0, index[:-1])
                _, value, _, _ = minimise_many(lambda t, y=y, x=x: negative_loglik(t, y, shape, x), np.stack([random_start(y, shape, 17 + s) for s in range(starts)]), rounds)
                rows.append((name, float(h), float(-value.min())))
            yield pd.DataFrame(rows, columns=["series", "half_life", "loglik"])

    fits = jobs.mapInPandas(run, "series string, half_life double, loglik double")
    best = fits.groupBy("series").agg(F.min_by("half_life", F.struct(-F.col("loglik"), F.col("half_life"))).alias("_best"))
    return fits.join(best, "series").select("series", "half_life", "loglik", (F.col("half_life") == F.col("_best")).alias("chosen"))


#: Events of a key that one task may hold; a key with more is cut into stretches of time.
HOT_EVENTS = 131_072
#: Events of the hot keys in one partition of stretches, and hot keys that are fitted at once.
STRETCH_EVENTS, HOT_KEYS = 500_000, 64


#: Events in a row of ``_excited``'s blocks, and numbers (events times points) of a block.
ROW, BLOCK_NUMBERS = 32, 65_536


def _excited(t: np.ndarray, s: np.ndarray, beta: np.ndarray, begin: float, carry: np.ndarray, slope: np.ndarray, rows: int | None = None):
    """Blocks (place, n, a, b, carry, slope): for each event and point a, the sum of s_j exp(-beta (t - t_j)) over the events before, and b, that of s_j (t - t_j) exp(-beta (t - t_j)).

    ``carry`` and ``slope`` are a and b at ``begin``, and are given back after the block's last event. a and b of a block are (ROW, m, points), its
    event i at place (i % ROW, i // ROW); what lies behind n is padding. Rows of events go on in step, their ends are composed by doubling.
    """
    rows = rows or max(ROW, BLOCK_NUMBERS // len(beta) // ROW * ROW)
    for at in range(0, len(t), rows):
        n = len(t[at : at + rows])
        m = -(-n // ROW)
        times, marks = np.full(m * ROW, t[at + n - 1]), np.zeros(m * ROW)
        times[:n], marks[:n] = t[at : at + n], s[at : at + n]
        times, marks = np.ascontiguousarray(times.reshape(m, ROW).T), np.ascontiguousarray(marks.reshape(m, ROW).T)[..., None]
        gap = np.diff(times, axis=0, prepend=times[:1])[..., None]
        left = np.exp(-gap * beta)  # becomes what is left of a row's start at each event
        a, b = np.zeros_like(left), np.zeros_like(left)
        for i in range(1, ROW):
            np.multiply(left[i], a[i - 1] + marks[i - 1], out=a[i])
            np.multiply(left[i], b[i - 1], out=b[i])
            b[i] += gap[i] * a[i]
            left[i] *= left[i - 1]
        lead, rest = times[0, 0] - begin, (np.append(times[0, 1:], times[-1, -1]) - times[-1])[:, None]
        first, between, last = np.exp(-beta * lead), np.exp(-rest * beta), a[-1] + marks[-1]
        start, bend = np.concatenate([(first * carry)[None], between * last]), np.concatenate([(first * (slope + lead * carry))[None], between * (b[-1] + rest * last)])
        share, span = np.concatenate([np.ones((1, len(beta))), between * left[-1]]), np.concatenate([np.zeros((1, 1)), rest + (times[-1] - times[0])[:, None]])
        k = 1
        while k <= m:
            bend[k:] += share[k:] * (bend[:-k] + span[k:] * start[:-k])
            start[k:] += share[k:] * start[:-k]
            share[k:] *= share[:-k].copy()
            span[k:] += span[:-k].copy()
            k *= 2
        b += left * (bend[:-1] + (times - times[0])[..., None] * start[:-1])
        a += left * start[:-1]
        begin, carry, slope = times[-1, -1], start[-1], bend[-1]
        yield at, n, a, b, carry, slope


def _decayed(t: np.ndarray, s: np.ndarray, beta: np.ndarray, begin: float, carry: np.ndarray, rows: int = 4_096):
    """Blocks (place, states before each event (n, batch), states after the last) from ``carry``, the state at ``begin``."""
    for at, n, a, _, carry, _ in _excited(t, s, beta, begin, carry, np.zeros(len(beta)), rows):
        yield at, a.transpose(1, 0, 2).reshape(-1, len(beta))[:n], carry


def _left_behind(t: np.ndarray, s: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """(2, batch): a and b of ``_excited`` after the last event, of the events alone; what has decayed below 1e-300 is left out."""
    out = np.zeros((2, len(beta)))
    for k, rate in enumerate(beta):
        i = int(np.searchsorted(t, t[-1] - 700 / rate))
        ago = t[-1] - t[i:]
        weight = s[i:] * np.exp(-rate * ago)
        out[:, k] = weight.sum(), weight @ ago
    return out


def _hawkes_stretch(log_params: np.ndarray, t: np.ndarray, s: np.ndarray, horizon: float, begin: float, carry: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """(4, batch): compensator's part of the events less their log intensities, of a batch of log (mu, alpha, beta), and its slopes on these."""
    mu, alpha, beta = np.exp(np.clip(log_params, -50, 50)).T
    out = np.zeros((4, len(mu)))
    with np.errstate(all="ignore"):
        for at, n, a, b, _, _ in _excited(t, s, beta, begin, carry, slope):
            own, rest = s[at : at + n], np.maximum(horizon - t[at : at + n], 0)
            near = np.flatnonzero(beta * rest[-1] < 40)  # elsewhere nothing but the marks' sum is left in doubles
            mass, late = np.full(len(mu), own.sum()), np.zeros(len(mu))
            if len(near):
                fall = np.expm1(-rest[:, None] * beta[near])
                mass[near], late[near] = -(own @ fall), (own * rest) @ (1 + fall)
            real = (np.arange(ROW)[:, None] + ROW * np.arange(a.shape[1]) < n).astype(float).ravel()
            a, b = a.reshape(-1, len(mu)), b.reshape(-1, len(mu))
            lam = np.maximum(mu + alpha * a, 1e-300)
            each = 1 / lam
            out[0] += alpha / beta * mass - real @ np.log(lam)
            out[1] -= mu * (real @ each)
            out[2] += alpha / beta * mass - alpha * (real @ (a * each))
            out[3] += alpha * late - alpha / beta * mass + alpha * beta * (real @ (b * each))
    return out


def _with_base(log_params: np.ndarray, parts: np.ndarray, horizon: float) -> tuple[np.ndarray, np.ndarray]:
    """Negative log likelihoods and their slopes of the events' parts (4, batch); parameters beyond 50 have no slope."""
    base = np.exp(np.clip(log_params[:, 0], -50, 50)) * horizon
    value, slopes = base + parts[0], parts[1:].T.copy()
    slopes[:, 0] += base
    fine = np.isfinite(value) & np.isfinite(slopes).all(1)
    return np.where(fine, value, INFEASIBLE), np.where(fine[:, None] & (np.abs(log_params) <= 50), slopes, 0.0)


def hawkes_value_and_slopes(log_params: np.ndarray, t: np.ndarray, s: np.ndarray, horizon: float) -> tuple[np.ndarray, np.ndarray]:
    """Negative log likelihoods (batch) and their slopes (batch, 3) of a batch of log (mu, alpha, beta) of the exponential kernel."""
    log_params = np.atleast_2d(log_params)
    none = np.zeros(len(log_params))
    return _with_base(log_params, _hawkes_stretch(log_params, t, s, horizon, t[0], none, none) if len(t) else np.zeros((4, len(log_params))), horizon)


def hawkes_negative_loglik(log_params: np.ndarray, t: np.ndarray, s: np.ndarray, horizon: float) -> np.ndarray:
    """Negative log likelihoods of a batch of log (mu, alpha, beta) of the exponential kernel."""
    return hawkes_value_and_slopes(log_params, t, s, horizon)[0]


def _hot_batches(events: DataFrame, key: str, most: int):
    """(sizes, batches) where sizes has (key, n, m) of each key of more than ``most`` events, and batches yields up to HOT_KEYS such rows."""
    sizes = events.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"), F.avg("s").alias("m")).where(F.col("n") > most)

    def batches():
        batch = []
        for row in sizes.toLocalIterator():
            batch.append(row)
            if len(batch) == HOT_KEYS:
                yield batch
                batch = []
        if batch:
            yield batch

    return sizes, batches


def _stretches(events: DataFrame, batch: list, key: str, tag: str) -> DataFrame:
    """(k, no, t, s): the events of a batch of hot keys (k: place in it) in stretches of an Arrow batch at most, ``no`` rising with time; t and s are the bytes of doubles.

    Written to the shared folder. Events of one very time and mark stay in one partition.
    """
    spark = events.sparkSession
    known = spark.createDataFrame([(row["key"], i) for i, row in enumerate(batch)], "_hot string, k int")
    parts = max(1, -(-sum(row["n"] for row in batch) // STRETCH_EVENTS))
    own = (events.select(F.col(key).cast("string").alias("_key"), F.col("t").cast("double").alias("t"), F.col("s").cast("double").alias("s"))
           .join(F.broadcast(known), F.col("_key").eqNullSafe(F.col("_hot"))))
    ordered = own.select("k", "t", "s").repartitionByRange(parts, "k", "t", "s").sortWithinPartitions("k", "t", "s").withColumn("part", F.spark_partition_id())

    def pack(frames):
        count = 0
        for frame in frames:
            for k, rows in frame.groupby("k", sort=False):
                yield pd.DataFrame({"k": [k], "no": [(int(rows["part"].iloc[0]) << 32) + count], "t": [rows["t"].to_numpy().tobytes()], "s": [rows["s"].to_numpy().tobytes()]})
                count += 1

    return materialise(ordered.mapInPandas(pack, "k int, no bigint, t binary, s binary"), tag)


def _hot_objective(stretches: DataFrame, horizon: float, key_of):
    """A batch objective (points, their starts) of log (mu, alpha, beta), one Spark job a call; ``key_of`` gives the k of starts.

    It gives values and slopes. Each stretch leaves its decayed sums, a key's sums are carried on in order of time (two numbers a stretch
    and point), and the stretches then finish by themselves. The carried numbers are broadcast up to 32 MB, beyond that joined.
    """
    count = stretches.count()

    def objective(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ks = key_of(starts)
        places = {int(k): np.flatnonzero(ks == k) for k in np.unique(ks)}
        own = {k: points[at] for k, at in places.items()}

        def leave(frames):
            for frame in frames:
                for k, no, t, s in zip(frame["k"], frame["no"], frame["t"], frame["s"], strict=True):
                    if k in own:
                        t = np.frombuffer(t)
                        left = _left_behind(t, np.frombuffer(s), np.exp(np.clip(own[k][:, 2], -50, 50)))
                        yield pd.DataFrame({"k": [k], "no": [no], "begin": [t[0]], "end": [t[-1]], "left": [left.ravel()]})

        def carry(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("no")
            beta = np.exp(np.clip(own[int(rows["k"].iloc[0])][:, 2], -50, 50))
            state, last, out = np.zeros((2, len(beta))), rows["begin"].iloc[0], []

            def moved(state: np.ndarray, by: float) -> np.ndarray:
                return np.exp(-beta * by) * np.stack([state[0], state[1] + by * state[0]])

            for begin, end, left in zip(rows["begin"], rows["end"], rows["left"], strict=True):
                state = moved(state, begin - last)
                out.append(state.ravel())
                state, last = moved(state, end - begin) + np.asarray(left).reshape(2, -1), end
            return pd.DataFrame({"no": rows["no"], "carry": out})

        def finish(frames):
            for frame in frames:
                sums = {}
                for k, t, s, c in zip(frame["k"], frame["t"], frame["s"], frame["carry"], strict=True):
                    t, c = np.frombuffer(t), np.asarray(c, float).reshape(2, -1)
                    sums[k] = sums.get(k, 0.0) + _hawkes_stretch(own[k], t, np.frombuffer(s), horizon, t[0], *c)
                for k, part in sums.items():
                    part = np.where(np.isnan(part), np.inf, part)  # NaN would be a null, which sums pass over
                    yield pd.DataFrame({"place": places[k], **dict(zip("vxyz", part, strict=True))})

        carried = stretches.mapInPandas(leave, "k int, no bigint, begin double, end double, left array<double>").groupBy("k").applyInPandas(carry, "no bigint, carry array<double>")
        if count * max(map(len, own.values())) * 16 <= 32_000_000:
            carried = F.broadcast(carried)
        each = stretches.join(carried, "no").mapInPandas(finish, "place int, v double, x double, y double, z double")
        parts = np.zeros((4, len(points)))
        for row in each.groupBy("place").agg(*[F.sum(c).alias(c) for c in "vxyz"]).collect():  # four numbers a point
            parts[:, row["place"]] = row["v"], row["x"], row["y"], row["z"]
        return _with_base(points, parts, horizon)

    return objective


HAWKES = "key string, start int, n bigint, loglik double, mu double, alpha double, beta double, branching double, converged boolean"


def _hawkes_start(seed: int, start: int, n: int, mean: float, horizon: float) -> np.ndarray:
    g = np.random.default_rng((seed, start))
    beta = np.exp(g.uniform(0, 4))
    return np.log([n / horizon * g.uniform(0.3, 0.9), beta * g.uniform(0.1, 0.8) / max(mean, 1e-9), beta])


def _packed_events(events: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """(key, t, s): events as arrays in order, of the keys that are not hot."""
    named = events.select(F.col(key).cast("string").alias("key"), F.col("t").cast("double").alias("t"), F.col("s").cast("double").alias("s"))
    left = named.join(hot.select(F.col("key").alias("_hot")), F.col("key").eqNullSafe(F.col("_hot")), "left_anti")
    return left.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "s"))).alias("e")).select("key", "e.t", "e.s")


def best_start(fits: DataFrame) -> DataFrame:
    """The start of each key with the greatest likelihood, the first of equal ones."""
    return fits.groupBy("key").agg(F.max_by(F.struct(*[c for c in fits.columns if c != "key"]), F.struct("loglik", -F.col("start"))).alias("b")).select("key", "b.*")


def hawkes_fit(events: DataFrame, horizon: float, starts: int = 4, seed: int = 7, rounds: int = 60, key: str = "key", most: int = HOT_EVENTS) -> DataFrame:
    """Best of several seeded starts per key, as ``hawkes_starts`` gives them."""
    return best_start(hawkes_starts(events, horizon, starts, seed, rounds, key, most))


def hawkes_starts(events: DataFrame, horizon: float, starts: int = 4, seed: int = 7, rounds: int = 60, key: str = "key", most: int = HOT_EVENTS) -> DataFrame:
    """Each seeded start per key: parameters, log likelihood, branching ratio alpha E[s] / beta, and whether it converged.

    Keys of up to ``most`` events are a row of arrays each. Larger ones are cut into stretches of time, and each step of
    all their starts is one Spark job over these; the likelihood and the optimiser are the same. Null times or marks
    are left out.
    """
    spark = events.sparkSession
    events = events.where("t is not null and s is not null")
    hot, batches = _hot_batches(events, key, most)
    columns = [c.split()[0] for c in HAWKES.split(", ")]

    def rows_of(name, n, mean, theta, value, sure) -> list[tuple]:
        mu, alpha, beta = np.exp(np.clip(theta, -50, 50)).T
        sure = sure & (np.abs(theta) < 50).all(1)  # a start that ran away has not converged
        return [(name, i, int(n), float(-value[i]), float(mu[i]), float(alpha[i]), float(beta[i]), float(alpha[i] * mean / beta[i]), bool(sure[i])) for i in range(starts)]

    def run(frames):
        for frame in frames:
            for k, t, s in zip(frame["key"], frame["t"], frame["s"], strict=True):
                t, s = np.asarray(t, float), np.asarray(s, float)
                x0 = np.stack([_hawkes_start(seed, i, len(t), s.mean(), horizon) for i in range(starts)])
                theta, value, _, sure = minimise_many(lambda p, t=t, s=s: hawkes_value_and_slopes(p, t, s, horizon), x0, rounds, slopes=True)
                yield pd.DataFrame(rows_of(k, len(t), s.mean(), theta, value, sure), columns=columns)

    fits = _packed_events(events, hot, key).repartition("key").mapInPandas(run, HAWKES)
    for batch in batches():
        x0 = np.stack([_hawkes_start(seed, i, row["n"], row["m"], horizon) for row in batch for i in range(starts)])
        objective = _hot_objective(_stretches(events, batch, key, "hawkes"), horizon, lambda own: own // starts)
        theta, value, _, sure = minimise_many(objective, x0, rounds, owned=True, slopes=True)
        own = [slice(i * starts, (i + 1) * starts) for i in range(len(batch))]
        fits = fits.unionByName(spark.createDataFrame([r for row, o in zip(batch, own, strict=True) for r in rows_of(row["key"], row["n"], row["m"], theta[o], value[o], sure[o])], HAWKES))
    return fits


def simulate(params: kernels.Params, n: int, seed: int, burn: int = 500, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Returns and regimes of the model, after ``burn`` discarded steps; shocks are normal, or Student's t where there is nu.

    ``x`` (n lagged values) drives the transitions of parameters with slopes; it is 0 while burning in.
    """
    a, g = params.arrays(), np.random.default_rng(seed)
    k = len(a["mu"])
    moving = kernels.transitions(a["d"], a["B"], np.append(np.zeros(burn), x)) if params.B is not None else None
    s2, state = a["v"].copy(), int(g.choice(k, p=kernels.stationary(a["P"])))
    r, states = np.empty(n + burn), np.empty(n + burn, int)
    for t in range(n + burn):
        if t:
            e = r[t - 1] - a["mu"]
            s2 = a["omega"] + (a["alpha"] + a["gamma"] * (e < 0)) * e * e + a["beta"] * s2
            state = int(g.choice(k, p=a["P"][state] if moving is None else moving[t, state]))
        shock = g.normal() if "nu" not in a else g.standard_t(a["nu"][state]) * np.sqrt((a["nu"][state] - 2) / a["nu"][state])
        r[t], states[t] = a["mu"][state] + np.sqrt(s2[state]) * shock, state
    return r[burn:], states[burn:]


def simulate_garchx(mu: float, omega: float, alpha: float, beta: float, theta: float, x_lag: np.ndarray, seed: int) -> np.ndarray:
    """Returns of a GARCH with a lagged driver."""
    g, out = np.random.default_rng(seed), np.empty(len(x_lag))
    s2 = (omega + theta * x_lag.mean()) / max(1 - alpha - beta, 1e-6)
    for t in range(len(x_lag)):
        if t:
            s2 = max(omega + alpha * (out[t - 1] - mu) ** 2 + beta * s2 + theta * x_lag[t], 1e-12)
        out[t] = mu + np.sqrt(s2) * g.normal()
    return out


def simulate_hawkes(mu: float, alpha: float, beta: float, horizon: float, seed: int, marks=None) -> tuple[np.ndarray, np.ndarray]:
    """Times and marks of the exponential kernel by thinning."""
    g = np.random.default_rng(seed)
    draw = marks or (lambda rng: rng.uniform())
    t, state, times, out = 0.0, 0.0, [], []
    while True:
        top = mu + alpha * state
        wait = g.exponential(1 / top)
        t += wait
        if t > horizon:
            return np.array(times), np.array(out)
        state *= np.exp(-beta * wait)
        if g.uniform() * top <= mu + alpha * state:
            m = float(draw(g))
            times.append(t)
            out.append(m)
            state += m


def grid_fit(series: DataFrame, values: list[str], objective, starts, names: list[str], n_starts: int, rounds: int = 60, key: str = "key", order: str = "t") -> DataFrame:
    """Best of seeded starts of any batch objective: (key, n, start, loglik, one column per parameter, and se_ of each by the curvature, null where that is not positive definite).

    ``objective(points, *arrays)`` gives negative log likelihoods of a batch of unconstrained points, and
    ``starts(rng, *arrays)`` a start; the arrays are the ``values`` columns of a key in order. Parameters come
    back unconstrained, as the objective takes them.
    """
    packed = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[v for v in values if v != order]))).alias("x")).select(F.col(key).cast("string").alias("key"), *[F.col(f"x.{v}").alias(v) for v in values])
    jobs = packed.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(n_starts - 1)))).repartition("key", "start")
    spec = ", ".join(["key string", "n int", "start int", "loglik double", *[f"{n} double" for n in names], *[f"se_{n} double" for n in names]])

    def run(frames):
        for frame in frames:
            rows = []
            for _, row in frame.iterrows():
                arrays = [np.asarray(row[v], float) for v in values]
                x, value, _ = minimise(lambda p, a=arrays: objective(p, *a), starts(np.random.default_rng((17, int(row["start"]))), *arrays), rounds)
                bend = hessian(lambda p, a=arrays: objective(p, *a), x)
                definite = np.all(np.isfinite(bend)) and np.linalg.eigvalsh(bend).min() > 0
                se = np.sqrt(np.diag(np.linalg.inv(bend))).tolist() if definite else [None] * len(names)
                rows.append((row["key"], len(arrays[0]), int(row["start"]), -value, *map(float, x), *se))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in spec.split(", ")])

    fits = jobs.mapInPandas(run, spec)
    return fits.groupBy("key").agg(F.max_by(F.struct(*[c for c in fits.columns if c != "key"]), F.struct("loglik", -F.col("start"))).alias("b")).select("key", "b.*")


def garchx_negative_loglik(points: np.ndarray, r: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Batch of (mu, log omega, logit persistence, logit alpha's share, log theta) of a GARCH with a lagged driver."""
    points = np.atleast_2d(points)
    mu, omega, theta = points[:, 0], np.exp(np.clip(points[:, 1], -30, 30)), np.exp(np.clip(points[:, 4], -30, 30))
    p, share = (1 / (1 + np.exp(-np.clip(points[:, k], -30, 30))) for k in (2, 3))
    alpha, beta = p * share, p * (1 - share)
    s2 = (omega + theta * x.mean()) / np.maximum(1 - p, 1e-6)
    out = np.zeros(len(points))
    for t in range(len(r)):
        if t:
            s2 = np.maximum(omega + alpha * (r[t - 1] - mu) ** 2 + beta * s2 + theta * x[t], 1e-12)
        out += 0.5 * (kernels.LOG_2PI + np.log(s2) + (r[t] - mu) ** 2 / s2)
    return np.where(np.isfinite(out), out, INFEASIBLE)


def bootstrap_lr(series: DataFrame, replicas: int = 19, starts: int = 2, rounds: int = 20, seed: int = 5, key: str = "asset", order: str = "fecha", r: str = "r") -> DataFrame:
    """(series, lr, p): likelihood ratio of two regimes against one, by parametric bootstrap; a task per replica.

    Replica 0 is the data. The others are simulated from the fitted single regime. p = (1 + #{LR_b >= LR}) / (B + 1),
    ratios cut off below at 0; data and replicas have equally many starts.
    """
    one = best_fit(fit_starts(series, Shape(1), starts, seed, rounds, key=key, order=order, r=r)).select("series", F.col("theta").alias("theta1"))
    jobs = _packed(series, key, order, [r]).withColumnRenamed(r, "r").join(one, "series").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicas)))).repartition(replicas + 1, "series", "b")

    def ratio(x: np.ndarray, base: int) -> float:
        best = [minimise_many(lambda t, k=k: negative_loglik(t, x, Shape(k)), np.stack([random_start(x, Shape(k), base + i) for i in range(starts)]), rounds)[1].min() for k in (1, 2)]
        return max(0.0, 2 * (best[0] - best[1]))

    def run(frames):
        for frame in frames:
            rows = []
            for s, x, theta, b in zip(frame["series"], frame["r"], frame["theta1"], frame["b"], strict=True):
                x = np.asarray(x, float)
                if b:
                    n = {k: tuple(v[0]) if v.ndim == 2 else v[0] for k, v in unpack(np.asarray(theta), Shape(1)).items()}
                    model = kernels.Params(mu=n["mu"], v=n["v"], alpha=n["alpha"], gamma=n["gamma"], beta=n["beta"], P=((1.0,),), omega=n["omega"])
                    x, _ = simulate(model, len(x), seed * 1_000_003 + int(b))
                rows.append((s, int(b), ratio(x, seed * 7_919 + 100 * int(b))))
            yield pd.DataFrame(rows, columns=["series", "b", "lr"])

    each = jobs.mapInPandas(run, "series string, b int, lr double")
    own = each.where("b = 0").select("series", F.col("lr").alias("own"))
    return each.where("b > 0").join(own, "series").groupBy("series").agg(F.first("own").alias("lr"), ((1 + F.count(F.when(F.col("lr") >= F.col("own"), 1))) / (F.count("*") + 1)).alias("p"), F.count("*").alias("replicas"))


def profile_branching(events: DataFrame, horizon: float, fits: DataFrame, grid: list[float], key: str = "key", most: int = HOT_EVENTS) -> DataFrame:
    """(key, n, loglik): profile likelihood of the branching ratio around a fit; all grid points of a key go on in step.

    Keys of more than ``most`` events are cut into stretches, as in ``hawkes_fit``.
    """
    spark = events.sparkSession
    events = events.where("t is not null and s is not null")
    hot, batches = _hot_batches(events, key, most)
    values = np.asarray(grid, float)

    def full(points: np.ndarray, at: np.ndarray, mean) -> np.ndarray:
        """log (mu, alpha, beta) of points (log mu, log beta) at the grid's place ``at``."""
        return np.stack([points[:, 0], np.log(values[at] / mean) + points[:, 1], points[:, 1]], 1)

    def on_two(value: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes on (log mu, log beta), with which log alpha goes."""
        return value, np.stack([slopes[:, 0], slopes[:, 1] + slopes[:, 2]], 1)

    def run(frames):
        for frame in frames:
            for k, t, s, mu, beta in zip(*(frame[c] for c in ("key", "t", "s", "mu", "beta")), strict=True):
                t, s = np.asarray(t, float), np.asarray(s, float)
                x0 = np.tile(np.log([mu, beta]), (len(values), 1))
                value = minimise_many(lambda p, at, t=t, s=s: on_two(*hawkes_value_and_slopes(full(p, at, s.mean()), t, s, horizon)), x0, 30, owned=True, slopes=True)[1]
                yield pd.DataFrame({"key": k, "n": values, "loglik": -value})

    at_fit = fits.select(F.col("key").alias("_key"), "mu", "beta")
    jobs = _packed_events(events, hot, key).join(at_fit, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
    out = jobs.repartition("key").mapInPandas(run, "key string, n double, loglik double")
    for batch in batches():
        wanted = spark.createDataFrame([(row["key"], i) for i, row in enumerate(batch)], "_hot string, k int")
        known = {row["k"]: row for row in at_fit.join(F.broadcast(wanted), F.col("_key").eqNullSafe(F.col("_hot"))).select("k", "mu", "beta").collect()}
        x0 = np.stack([np.log([known[i]["mu"], known[i]["beta"]]) for i in range(len(batch)) for _ in values])
        means = np.array([row["m"] for row in batch])
        whole = _hot_objective(_stretches(events, batch, key, "profile"), horizon, lambda own: own // len(values))
        value = minimise_many(lambda p, own: on_two(*whole(full(p, own % len(values), means[own // len(values)]), own)), x0, 30, owned=True, slopes=True)[1]  # noqa: B023
        out = out.unionByName(spark.createDataFrame([(row["key"], float(n), float(-value[i * len(values) + j])) for i, row in enumerate(batch) for j, n in enumerate(values)], "key string, n double, loglik double"))
    return out
