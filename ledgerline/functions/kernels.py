"""Sequential recursions in numpy, vectorised over many parameter sets at once: (sets, regimes) per step."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import lgamma, log, pi

import numpy as np

LOG_2PI = log(2 * pi)


@dataclass(frozen=True)
class Params:
    """A K-regime GJR-GARCH with constant or covariate-driven transitions. Arrays of K, or K by K."""

    mu: tuple
    v: tuple
    alpha: tuple
    gamma: tuple
    beta: tuple
    P: tuple
    nu: tuple | None = None
    d: tuple | None = None  # K x (K-1) intercepts of the transitions' softmax
    B: tuple | None = None  # K x (K-1) slopes on one lagged covariate
    omega: tuple = field(default=())

    def arrays(self) -> dict[str, np.ndarray]:
        a = {k: np.asarray(getattr(self, k), float) for k in ("mu", "v", "alpha", "gamma", "beta", "P")}
        a["omega"] = np.asarray(self.omega, float) if len(self.omega) else a["v"] * (1 - a["alpha"] - a["gamma"] / 2 - a["beta"])
        for k in ("nu", "d", "B"):
            if getattr(self, k) is not None:
                a[k] = np.asarray(getattr(self, k), float)
        return a


def stationary(P: np.ndarray) -> np.ndarray:
    """The distribution that P leaves as it is."""
    k = len(P)
    A = np.vstack([P.T - np.eye(k), np.ones(k)])
    x = np.linalg.lstsq(A, np.append(np.zeros(k), 1.0), rcond=None)[0].clip(0)
    return x / x.sum()


def gjr_variances(r: np.ndarray, mu, omega, alpha, gamma, beta, v) -> np.ndarray:
    """Variances (T, ..., K) of each regime's own recursion, started at the unconditional ones."""
    mu, omega, alpha, gamma, beta, v = (np.asarray(x, float) for x in (mu, omega, alpha, gamma, beta, v))
    out = np.empty((len(r), *v.shape))
    if not len(r):
        return out
    out[0] = v
    e = r[:-1].reshape(-1, *[1] * v.ndim) - mu
    out[1:] = omega + (alpha + gamma * (e < 0)) * e * e  # all that does not recur, at once
    for t in range(1, len(r)):
        out[t] += beta * out[t - 1]
    return out


def log_density(r: np.ndarray, mu: np.ndarray, s2: np.ndarray, nu: np.ndarray | None = None) -> np.ndarray:
    """Normal log density, or Student's t scaled to variance s2 for degrees of freedom nu > 2."""
    e = r.reshape(-1, *[1] * (s2.ndim - 1)) - mu
    if nu is None:
        return -0.5 * (LOG_2PI + np.log(s2) + e * e / s2)
    nu = np.asarray(nu, float)
    const = np.vectorize(lambda n: lgamma((n + 1) / 2) - lgamma(n / 2) - 0.5 * log(pi * (n - 2)))(nu)
    return const - 0.5 * np.log(s2) - (nu + 1) / 2 * np.log1p(e * e / (s2 * (nu - 2)))


def transitions(d: np.ndarray, B: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Transition matrices (T, K, K): each row a softmax of d + B x, the last column as reference."""
    z = d[None] + B[None] * x[:, None, None]
    z = np.concatenate([z, np.zeros((*z.shape[:2], 1))], 2)
    z = np.exp(z - z.max(2, keepdims=True))
    return z / z.sum(2, keepdims=True)


def hamilton(logf: np.ndarray, P: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted and filtered probabilities (T, ..., K) and log likelihood of each step.

    ``P`` is (..., K, K), or (T, K, K) with one matrix for each step (the first is not used).
    """
    moving = P.ndim == 3 and logf.ndim == 2
    predicted, filtered, ll = np.empty_like(logf), np.empty_like(logf), np.empty(logf.shape[:-1])
    xi = np.broadcast_to(start, logf.shape[1:])
    for t in range(len(logf)):
        if t:
            xi = (filtered[t - 1][..., :, None] * (P[t] if moving else P)).sum(-2)
        predicted[t] = xi
        top = logf[t].max(-1, keepdims=True)
        w = xi * np.exp(logf[t] - top)
        total = w.sum(-1, keepdims=True)
        filtered[t] = w / total
        ll[t] = (np.log(total) + top)[..., 0]
    return predicted, filtered, ll


def smooth(filtered: np.ndarray, predicted: np.ndarray, P: np.ndarray) -> np.ndarray:
    """Kim's smoother: uses the future, so for diagnosis only, never to be published."""
    out = filtered.copy()
    for t in range(len(filtered) - 2, -1, -1):
        out[t] = filtered[t] * (P @ (out[t + 1] / predicted[t + 1]))
    return out


def run_filter(r: np.ndarray, params: Params, x: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Variances, predicted and filtered probabilities and log likelihood of a series.

    A lagged covariate ``x`` is wanted exactly if the parameters have slopes.
    """
    a = params.arrays()
    if (params.B is not None) != (x is not None):
        raise ValueError("a lagged covariate goes with covariate-driven transitions, and only with them")
    s2 = gjr_variances(r, a["mu"], a["omega"], a["alpha"], a["gamma"], a["beta"], a["v"])
    logf = log_density(r, a["mu"], s2, a.get("nu"))
    P = transitions(a["d"], a["B"], x) if x is not None else a["P"]
    predicted, filtered, ll = hamilton(logf, P, stationary(a["P"]))
    return {"s2": s2, "predicted": predicted, "filtered": filtered, "ll": ll}


def filter_step(params: Params, r: float, state: tuple[float, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One day on, with constant transitions: variances, predicted and filtered probabilities, log likelihood.

    ``state`` is the day before's return, variances and filtered probabilities; without one the series starts.
    """
    a = params.arrays()
    if state is None:
        s2, predicted = a["v"].astype(float), stationary(a["P"])
    else:
        before, s2, filtered = state
        e = before - a["mu"]
        s2 = a["omega"] + (a["alpha"] + a["gamma"] * (e < 0)) * e * e + a["beta"] * s2
        predicted = filtered @ a["P"]
    logf = log_density(np.array([r]), a["mu"], s2[None], a.get("nu"))[0]
    top = logf.max()
    weight = predicted * np.exp(logf - top)
    return s2, predicted, weight / weight.sum(), float(np.log(weight.sum()) + top)


def garchx_variances(r: np.ndarray, x_lag: np.ndarray, mu: float, omega: float, alpha: float, beta: float, theta: float, floor: float = 1e-12) -> np.ndarray:
    """Variances with an exogenous lagged driver, started where the recursion rests at the driver's mean."""
    out = np.empty(len(r))
    out[0] = max((omega + theta * x_lag.mean()) / max(1 - alpha - beta, 1e-6), floor)
    for t in range(1, len(r)):
        e = r[t - 1] - mu
        out[t] = max(omega + alpha * e * e + beta * out[t - 1] + theta * x_lag[t], floor)
    return out


def decay_state(t: np.ndarray, s: np.ndarray, beta: float) -> np.ndarray:
    """A_i = sum over j < i of s_j exp(-beta (t_i - t_j)), one pass."""
    out = np.zeros(len(t))
    for i in range(1, len(t)):
        out[i] = (out[i - 1] + s[i - 1]) * np.exp(-beta * (t[i] - t[i - 1]))
    return out
