"""Quasi-Newton minimisation with finite-difference gradients, for many starts at once.

The objective takes a batch of parameter vectors (rows) and returns one value each, so that a gradient is one
call over all perturbed vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def gradient(objective: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    """Central differences of a batch objective at one point."""
    h = step * np.maximum(1.0, np.abs(x))
    shifted = np.concatenate([x + np.diag(h), x - np.diag(h)])
    f = objective(shifted)
    n = len(x)
    return (f[:n] - f[n:]) / (2 * h)


def minimise(objective: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 200, memory: int = 10, tolerance: float = 1e-9) -> tuple[np.ndarray, float, int]:
    """(point, value, rounds used) of L-BFGS with a backtracking line search from one start."""
    x = np.asarray(start, float)
    value = float(objective(x[None])[0])
    g = gradient(objective, x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(rounds):
        q, coefficients = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            coefficients.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(g).max())
        for (s, y), a in zip(pairs, reversed(coefficients), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        direction = -q if q @ g > 0 else -g / max(1.0, np.abs(g).max())
        steps = 0.5 ** np.arange(0, 24)
        trial = objective(x + steps[:, None] * direction)
        enough = np.flatnonzero(trial <= value + 1e-4 * steps * (direction @ g))
        if not len(enough):
            return x, value, k
        new = x + steps[enough[0]] * direction
        new_value = float(trial[enough[0]])
        new_g = gradient(objective, new)
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[-(memory - 1):], (s, y)]
        done = value - new_value <= tolerance * max(1.0, abs(value), abs(new_value)) or np.abs(new_g).max() < 1e-6
        x, value, g = new, new_value, new_g
        if done:
            return x, value, k + 1
    return x, value, rounds


def _directions(g: np.ndarray, pairs: list[list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """The two-loop recursion for each start, downhill in any case."""
    out = np.empty_like(g)
    for k, own in enumerate(pairs):
        q, coefficients = g[k].copy(), []
        for s, y in reversed(own):
            a = (s @ q) / (y @ s)
            coefficients.append(a)
            q -= a * y
        q *= (own[-1][0] @ own[-1][1]) / (own[-1][1] @ own[-1][1]) if own else 1 / max(1.0, np.abs(g[k]).max())
        for (s, y), a in zip(own, reversed(coefficients), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        out[k] = -q if q @ g[k] > 0 else -g[k] / max(1.0, np.abs(g[k]).max())
    return out


def minimise_many(objective: Callable[..., np.ndarray], starts: np.ndarray, rounds: int = 150, memory: int = 10, tolerance: float = 1e-9, step: float = 1e-5, owned: bool = False, slopes: bool = False, flat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, values, rounds used, converged) of L-BFGS from several starts in step, one objective call in most rounds.

    A start has converged when its value falls by no more than ``tolerance`` of itself, or its gradient vanishes; one
    whose line search finds nothing better after a fresh gradient step stops unconverged. With ``owned`` the objective
    also takes the number of each point's start, so that starts can be on different data. With ``slopes`` it gives values and gradients.
    With ``flat`` a gradient below 1e-6 of the value counts as none.
    """
    x = np.array(starts, float)
    m, n = x.shape

    def call(points: np.ndarray, own: np.ndarray):
        return objective(points, own) if owned else objective(points)

    def values_and_gradients(at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if slopes:
            return call(at, own)
        h = step * np.maximum(1.0, np.abs(at))
        shifts = h[:, None, :] * np.eye(n)
        each = np.repeat(own, n)
        f = call(np.concatenate([at, (at[:, None] + shifts).reshape(-1, n), (at[:, None] - shifts).reshape(-1, n)]), np.concatenate([own, each, each]))
        here, up, down = f[: len(at)], f[len(at) : len(at) * (n + 1)].reshape(-1, n), f[len(at) * (n + 1) :].reshape(-1, n)
        return here, (up - down) / (2 * h)

    def level(g: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.abs(g).max(1) < 1e-6 * (np.maximum(1.0, np.abs(value)) if flat else 1.0)

    value, g = values_and_gradients(x, np.arange(m))
    pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(m)]
    used, converged = np.zeros(m, int), level(g, value)
    live = ~converged
    steps = 0.4 ** np.arange(1, 10)
    for _ in range(rounds):
        at = np.flatnonzero(live)
        if not len(at):
            break
        direction = _directions(g[at], [pairs[k] for k in at])
        slope = (direction * g[at]).sum(1)
        # most starts take the whole step, so its gradient is asked for at once
        new = x[at] + direction
        new_value, new_g = values_and_gradients(new, at)
        whole = (new_value <= value[at] + 1e-4 * slope) & np.isfinite(new_g).all(1)
        short = np.flatnonzero(~whole)
        if len(short):
            trial = call((x[at[short], None] + steps[:, None] * direction[short, None]).reshape(-1, n), np.repeat(at[short], len(steps)))
            trial, trial_g = (trial[0], trial[1].reshape(len(short), len(steps), n)) if slopes else (trial, None)
            trial = trial.reshape(len(short), -1)
            enough = trial <= value[at[short], None] + 1e-4 * steps * slope[short, None]
            found = enough.any(1)
            for k in at[short[~found]]:
                live[k] = bool(pairs[k])  # once more from the plain gradient
                pairs[k] = []
            some = short[found]
            if len(some):
                first = enough[found].argmax(1)
                new[some] = x[at[some]] + steps[first, None] * direction[some]
                new_value[some], new_g[some] = (trial[found, first], trial_g[found, first]) if slopes else values_and_gradients(new[some], at[some])
                whole[some] = True
        at, new, new_value, new_g = at[whole], new[whole], new_value[whole], new_g[whole]
        if not len(at):
            continue
        for i, k in enumerate(at):
            s, y = new[i] - x[k], new_g[i] - g[k]
            if s @ y > 1e-12:
                pairs[k] = [*pairs[k][-(memory - 1):], (s, y)]
        done = (value[at] - new_value <= tolerance * np.maximum(1.0, np.abs(new_value))) | level(new_g, new_value)
        x[at], value[at], g[at] = new, new_value, new_g
        used[at] += 1
        converged[at[done]] = True
        live[at[done]] = False
    return x, value, used, converged


def hessian(objective: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Second differences of a batch objective, in one call."""
    n = len(x)
    h = step * np.maximum(1.0, np.abs(x))
    i, j = np.triu_indices(n)
    e = np.diag(h)
    points = np.concatenate([x + e[i] + e[j], x + e[i] - e[j], x - e[i] + e[j], x - e[i] - e[j]])
    f = objective(points).reshape(4, -1)
    out = np.zeros((n, n))
    out[i, j] = (f[0] - f[1] - f[2] + f[3]) / (4 * h[i] * h[j])
    return out + np.triu(out, 1).T


def minimise_by_gradient(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 200, memory: int = 10, tolerance: float = 1e-10) -> tuple[np.ndarray, float, int, bool]:
    """(point, value, rounds used, converged) of L-BFGS for an objective that gives its own gradient, one call a trial step."""
    x = np.asarray(start, float)
    value, g = objective(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(rounds):
        if np.abs(g).max() < 1e-6 * max(1.0, abs(value)):
            return x, value, k, True
        direction, step = _directions(g[None], [pairs])[0], 1.0
        slope = direction @ g
        while step > 1e-9:
            new = x + step * direction
            new_value, new_g = objective(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * step * slope:
                break
            step *= 0.4
        else:
            if not pairs:
                return x, value, k, False
            pairs = []  # once more from the plain gradient
            continue
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[-(memory - 1):], (s, y)]
        fall = value - new_value
        x, value, g = new, new_value, new_g
        if fall <= tolerance * max(1.0, abs(value)):
            return x, value, k + 1, True
    return x, value, rounds, False
