"""Self-exciting process with a power-law kernel, in time linear in the events.

The intensity is mu + alpha * sum of s_j / (t - t_j + c) ** (1 + theta) over strictly earlier events. The kernel has no finite
state, but a sum of exponentials comes as near to it as wanted. Events are cut into chunks of ``LENGTH``: inside a
chunk the kernel is summed exactly over pairs; what lies before the chunk is one number for each exponential's rate, carried from chunk
to chunk. The states depend on the rates alone, so one scan of the events serves every kernel, whatever its parameters.

The scan cuts (key, time) into ranges, so a hot key is many tasks, and carries one row a range of the few keys that span several.
Events at one time do not excite each other: what is at a chunk's first time but in the chunks before is kept as a mass of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.optimise import minimise_by_gradient, minimise_many
from ..sources.tables import materialise
from . import news
from .estimate import HOT_KEYS, hawkes_fit

LENGTH = 32
#: Chunks that are laid out at once, and events of a key that one task may fit; a key with more is fitted over its blocks of chunks.
SLICE, HOT_EVENTS = 256, 65_536
#: Up to theta = ``MOST_THETA`` kernels are matched to this error, relative to the kernel plus ``PEAK_SHARE`` of its peak.
ERROR, PEAK_SHARE, MOST_THETA = 1e-6, 1e-2, 3.0
FLOOR = 1e-300


def rates_for(least_c: float, span: float) -> np.ndarray:
    """Rates that hold kernels with c from ``least_c`` on over times up to ``span``: 0, and a geometric row of about three to each e-fold."""
    folds = math.log(15 / least_c) - math.log(0.3 / (span + least_c))
    return np.append(0.0, np.geomspace(0.3 / (span + least_c), 15 / least_c, max(8, math.ceil(2.6 * folds))))


def match(rates: np.ndarray, c: float, powers: list[float], span: float, with_log: bool = False) -> tuple[np.ndarray, float]:
    """(weights, error): the weights of the rates' exponentials that give (u + c) ** -p for each power, u from 0 to ``span``.

    With ``with_log`` a last row gives ln(u + c) (u + c) ** -p of the first power. The error is the worst of the first power's, relative to the kernel plus
    ``PEAK_SHARE`` of its peak, at places between those that were matched.
    """
    def places(n: int) -> np.ndarray:
        return c * np.expm1(np.linspace(0, np.log1p(span / c), n))

    u = places(600)
    first = (u + c) ** -powers[0]
    scale = first + PEAK_SHARE * first[0]
    targets = [(u + c) ** -p for p in powers] + ([np.log(u + c) * first] if with_log else [])
    useful = rates <= 20 / c  # faster ones would only bend the sum between the first places
    weights = np.zeros((len(targets), len(rates)))
    weights[:, useful] = np.linalg.lstsq(np.exp(-rates[useful] * u[:, None]) / scale[:, None], np.stack([x / scale for x in targets], 1), rcond=1e-14)[0].T
    v = places(1_001)
    exact = (v + c) ** -powers[0]
    return weights, float((np.abs(np.exp(-rates * v[:, None]) @ weights[0] - exact) / (exact + PEAK_SHARE * exact[0])).max())


def _advance(state: np.ndarray, tied: float, by: float, rates: np.ndarray) -> tuple[np.ndarray, float]:
    """State strictly before a time and mass at it, moved on."""
    return ((state + tied) * np.exp(-rates * by), 0.0) if by > 0 else (state, tied)


CHUNK = "_part int, no bigint, ids array<bigint>, t array<double>, s array<double>, t0 double, tied double, state array<double>"


def chunks(events: DataFrame, rates: np.ndarray, key: str = "key", length: int = LENGTH) -> DataFrame:
    """(key, ids, t, s, t0, tied, state): events (key, event_id, t, s) in order, with the exponential sums before each chunk's first time ``t0``.

    ``tied`` is the mass at t0 in the chunks before. Rows with null t or s are left out. Written once to the shared folder.
    """
    spark = events.sparkSession
    rows = events.select(F.col(key).alias("key"), "event_id", F.col("t").cast("double").alias("t"), F.col("s").cast("double").alias("s")).where("t is not null and s is not null")
    kind = dict(rows.dtypes)["key"]
    order = ["key", "t", "event_id"]
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, tied, at, no, part = None, None, 0.0, 0.0, 0, 0

        def take(block: pd.DataFrame) -> tuple:
            nonlocal state, tied, at, no
            t, s = block["t"].to_numpy(), block["s"].to_numpy()
            if no == 0:
                state, tied, at = np.zeros(len(rates)), 0.0, t[0]
            state, tied = _advance(state, tied, t[0] - at, rates)
            row = (block["key"].iloc[0], part, no, block["event_id"].to_numpy(), t, s, t[0], tied, state)
            last = t[-1]
            before, now = t < last, t == last
            state, tied = _advance(state, tied, last - t[0], rates)
            state = state + (s[before, None] * np.exp(-rates * (last - t[before])[:, None])).sum(0)
            tied, at, no = tied + s[now].sum(), last, no + 1
            return row

        def end() -> tuple:
            # what the key leaves behind in this part, as a row without events
            return (held["key"].iloc[0] if held is not None and len(held) else name, part, -1, [], [], [], at, tied, state)

        names = ["key", *[c.split()[0] for c in CHUNK.split(", ")]]
        name = None
        for frame in frames:
            out = []
            same = frame["key"].isna()
            starts = np.flatnonzero(np.append(True, (frame["key"].to_numpy()[1:] != frame["key"].to_numpy()[:-1]) & ~(same.to_numpy()[1:] & same.to_numpy()[:-1])))
            for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
                own = frame.iloc[a:b]
                first = own["key"].iloc[0]
                if held is not None and not (first == name or pd.isna(first) and pd.isna(name)):
                    if len(held):
                        out.append(take(held))
                    out.append(end())
                    held = None
                if held is None:
                    held, no, name, part = own.iloc[:0], 0, first, int(own["_part"].iloc[0])
                held = pd.concat([held, own]) if len(held) else own
                whole = len(held) // length * length
                out += [take(held.iloc[i : i + length]) for i in range(0, whole, length)]
                held = held.iloc[whole:]
            yield pd.DataFrame(out, columns=names)
        if held is not None:
            out = [take(held)] if len(held) else []
            yield pd.DataFrame([*out, end()], columns=names)

    local = materialise(placed.mapInPandas(cut, f"key {kind}, {CHUNK}"), "chunks")
    ends = local.where("no = -1").withColumn("_parts", F.count("*").over(Window.partitionBy("key"))).where("_parts > 1").select("key", "_part", "t0", "tied", "state")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        state, tied, at, out = None, 0.0, 0.0, []
        for row in part.sort_values("_part").itertuples(index=False):
            if state is not None:
                out.append((row.key, row._1, at, tied, state))  # _1: the column _part
                state, tied = _advance(state, tied, row.t0 - at, rates)
            state, tied, at = (0.0 if state is None else state) + np.asarray(row.state), tied + row.tied, row.t0
        return pd.DataFrame(out, columns=["ckey", "cpart", "ct", "ctied", "cstate"])

    carried = ends.groupBy("key").applyInPandas(fold, f"ckey {kind}, cpart int, ct double, ctied double, cstate array<double>")  # at most two rows a range
    both = local.where("no >= 0").join(F.broadcast(carried), F.col("key").eqNullSafe(F.col("ckey")) & (F.col("_part") == F.col("cpart")), "left").drop("ckey", "cpart")

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            state, tied = [], []
            for row in frame.itertuples(index=False):
                own, mass = np.asarray(row.state), row.tied
                if row.cstate is not None:
                    more, left = _advance(np.asarray(row.cstate), row.ctied, row.t0 - row.ct, rates)
                    own, mass = own + more, mass + left
                state.append(own)
                tied.append(mass)
            yield frame[["key", "ids", "t", "s", "t0"]].assign(tied=tied, state=state)

    return materialise(both.mapInPandas(join, f"key {kind}, ids array<bigint>, t array<double>, s array<double>, t0 double, tied double, state array<double>"), "chunks")


class Pairs:
    """Chunks of one key, laid out for sums over strictly earlier events: pairs inside a chunk, and exponentials of what lies before it."""

    def __init__(self, frame: pd.DataFrame, rates: np.ndarray) -> None:
        t, s = [np.asarray(x, float) for x in frame["t"]], [np.asarray(x, float) for x in frame["s"]]
        self.t, self.s = np.concatenate(t), np.concatenate(s)
        gaps, marks, counts = [], [], []
        for own, m, t0, tied in zip(t, s, frame["t0"], frame["tied"], strict=True):
            source, weight = np.append(t0, own), np.append(tied, m)  # the mass tied to the first time is a source of its own
            gap = own[:, None] - source[None, :]
            earlier = (gap > 0) & (weight != 0)
            gaps.append(gap[earlier])
            marks.append(np.broadcast_to(weight, gap.shape)[earlier])
            counts.append(earlier.sum(1))
        self.gap, self.mark = np.concatenate(gaps), np.concatenate(marks)
        self.row = np.repeat(np.arange(len(self.t)), np.concatenate(counts))
        size = np.array([len(x) for x in t])
        since = self.t - np.repeat(frame["t0"].to_numpy(float), size)
        self.far = np.exp(-rates * since[:, None]) * np.repeat(np.stack([np.asarray(x, float) for x in frame["state"]]), size, axis=0)

    def sums(self, near: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each event the sum over earlier ones: ``near`` is the kernel at each pair, ``weights`` its exponentials."""
        return np.bincount(self.row, self.mark * near, minlength=len(self.t)) + self.far @ weights


def _states(frame: pd.DataFrame, rates: np.ndarray, span: float) -> Iterator[pd.DataFrame]:
    """States of chunks with their kernels, up to ``SLICE`` chunks at once: pairs and exponentials take some hundred bytes an event."""
    for (mu, alpha, c, theta), whole in frame.groupby(["mu", "alpha", "c", "theta"]):
        (w, v), _ = match(rates, c, [1 + theta, theta], span)
        for own in (whole.iloc[i : i + SLICE] for i in range(0, len(whole), SLICE)):
            pairs = Pairs(own, rates)
            excess = pairs.sums((pairs.gap + c) ** -(1 + theta), w)
            reach = pairs.sums((pairs.gap + c) ** -theta, v)
            before = pairs.sums(np.ones(len(pairs.gap)), np.eye(len(rates))[0])  # the rate 0
            tau = mu * pairs.t + alpha / theta * (c**-theta * before - reach)
            sizes = [len(x) for x in own["t"]]
            yield pd.DataFrame({"key": np.repeat(own["key"].to_numpy(), sizes), "event_id": np.concatenate([np.asarray(x) for x in own["ids"]]), "t": pairs.t, "s": pairs.s, "excess": excess, "intensity": mu + alpha * excess, "tau": tau})


def power_law_states(parts: DataFrame, rates: np.ndarray, span: float) -> DataFrame:
    """(key, event_id, t, s, excess, intensity, tau) of ``chunks`` with the columns mu, alpha, c, theta of each row's key.

    tau is the rescaled time: the compensator up to the event.
    """
    kind = dict(parts.dtypes)["key"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _states(frame, rates, span)

    return parts.mapInPandas(run, f"key {kind}, event_id bigint, t double, s double, excess double, intensity double, tau double")


def with_kernel(parts: DataFrame, mu: float, alpha: float, c: float, theta: float) -> DataFrame:
    """``chunks`` with one kernel for all keys."""
    return parts.withColumns({n: F.lit(float(v)) for n, v in (("mu", mu), ("alpha", alpha), ("c", c), ("theta", theta))})


def power_law_compensator(events: DataFrame, mu: float, alpha: float, c: float, theta: float, horizon: float, key: str = "key") -> DataFrame:
    """(key, compensator) at the horizon: a plain aggregate."""
    mass = F.sum(F.col("s") * (F.lit(c**-theta) - F.pow(horizon - F.col("t") + c, F.lit(-theta))))
    return events.groupBy(key).agg((F.lit(mu * horizon) + alpha / theta * mass).alias("compensator"))


def power_law_loglik(events: DataFrame, mu: float, alpha: float, c: float, theta: float, horizon: float, key: str = "key") -> DataFrame:
    """(key, n, loglik), intensities floored at 1e-300."""
    rates = rates_for(c, horizon)
    states = power_law_states(with_kernel(chunks(events, rates, key), mu, alpha, c, theta), rates, horizon)
    logs = states.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.ln(F.greatest("intensity", F.lit(FLOOR)))).alias("logs"))
    whole = power_law_compensator(events, mu, alpha, c, theta, horizon, key).withColumnRenamed(key, "_key")
    return logs.join(whole, F.col("key").eqNullSafe(F.col("_key"))).select("key", "n", (F.col("logs") - F.col("compensator")).alias("loglik"))


def power_law_branching(events: DataFrame, alpha: float, c: float, theta: float, key: str = "key") -> DataFrame:
    """(key, events, n, cascade): the kernel's mass times the mean mark, and 1 / (1 - n), null from n = 1 on."""
    n = alpha * c**-theta / theta * F.avg("s")
    return events.groupBy(key).agg(F.count("*").alias("events"), n.alias("n")).withColumn("cascade", F.when(F.col("n") < 1, 1 / (1 - F.col("n"))))


def _value_and_slopes(parameters: tuple, sums: np.ndarray, horizon: float) -> tuple[float, np.ndarray]:
    """Value and gradient at log (mu, alpha, c, theta) of the natural parameters and the events' sums."""
    mu, alpha, c, theta = parameters
    whole, by_c, by_theta, logs, each, excess, less, slow = sums
    slopes = np.array([horizon - each, whole / theta - excess, alpha / theta * by_c + alpha * (1 + theta) * less, alpha / theta * by_theta - alpha / theta**2 * whole + alpha * slow])
    return float(mu * horizon + alpha / theta * whole - logs), slopes * np.array([mu, alpha, c, theta])


def _sums(parameters: tuple, t: np.ndarray, s: np.ndarray, real: np.ndarray, excess: np.ndarray, less: np.ndarray, slow: np.ndarray, horizon: float) -> np.ndarray:
    """What ``_value_and_slopes`` takes: sums over the events, where ``real`` is 1. ``excess``, ``less`` and ``slow`` are each event's sums of the kernel and its slopes on c and theta."""
    mu, alpha, c, theta = parameters
    rest = horizon - t + c
    log = np.log(rest)
    tail = np.exp(-theta * log)
    each = real / np.maximum(mu + alpha * excess, FLOOR)
    logs = real @ np.log(np.maximum(mu + alpha * excess, FLOOR))
    return np.array([s @ (c**-theta - tail), s @ (tail / rest - c ** -(theta + 1)) * theta, s @ (tail * log - c**-theta * math.log(c)), logs, each.sum(), excess @ each, less @ each, slow @ each])


def negative_loglik(psi: np.ndarray, pairs: Pairs, rates: np.ndarray, horizon: float) -> tuple[float, np.ndarray]:
    """Value and gradient at log (mu, alpha, c, theta), over the events of ``pairs``."""
    natural = tuple(np.exp(np.clip(psi, -40, 40)))
    c, q = natural[2], 1 + natural[3]
    (w0, w1, w2), _ = match(rates, c, [q, q + 1], horizon, with_log=True)
    log = np.log(pairs.gap + c)
    near = np.exp(-q * log)
    excess, less, slow = pairs.sums(near, w0), pairs.sums(near / (pairs.gap + c), w1), pairs.sums(near * log, w2)
    return _value_and_slopes(natural, _sums(natural, pairs.t, pairs.s, np.ones(len(pairs.t)), excess, less, slow, horizon), horizon)


BLOCK = "k int, t binary, s binary, size binary, tied binary, state binary"


def _blocks(parts: DataFrame, batch: list, tag: str = "blocks") -> DataFrame:
    """Chunks of a batch of keys (k: place in it), up to ``SLICE`` of a key in a row as the bytes of doubles; a chunk is filled up to LENGTH by its last time. Written to the shared folder."""
    known = parts.sparkSession.createDataFrame([(row["key"], i) for i, row in enumerate(batch)], "_hot string, k int")
    own = parts.join(F.broadcast(known), F.col("key").eqNullSafe(F.col("_hot"))).select("k", "t", "s", "tied", "state")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, rows in frame.groupby("k"):
                for some in (rows.iloc[i : i + SLICE] for i in range(0, len(rows), SLICE)):
                    size = np.array([len(x) for x in some["t"]], float)
                    filled = [np.array([np.pad(x, (0, LENGTH - len(x)), **how) for x in some[c]]) for c, how in (("t", {"mode": "edge"}), ("s", {}))]
                    yield pd.DataFrame({"k": [k], "t": [filled[0].tobytes()], "s": [filled[1].tobytes()], "size": [size.tobytes()], "tied": [some["tied"].to_numpy(float).tobytes()], "state": [np.stack(list(some["state"])).tobytes()]})

    return materialise(own.mapInPandas(pack, BLOCK), tag)


def _earlier(t: np.ndarray, s: np.ndarray, tied: np.ndarray, state: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """(LENGTH, m, rates): before each event of m chunks, the sum over strictly earlier ones of each rate's exponential. t and s are (LENGTH, m)."""
    out = np.empty((*t.shape, len(rates)))
    out[0], mass = state, tied + s[0]
    for i in range(1, len(t)):
        gap = t[i] - t[i - 1]
        np.multiply(out[i - 1] + np.where(gap > 0, mass, 0.0)[:, None], np.exp(-gap[:, None] * rates), out=out[i])
        mass = np.where(gap > 0, s[i], mass + s[i])
    return out


def _block_objective(blocks: DataFrame, rates: np.ndarray, horizon: float, key_of):
    """A batch objective (points, their starts) of log (mu, alpha, c, theta), one Spark job a call; ``key_of`` gives the k of starts.

    The exponentials' sums do not depend on the parameters, so all points of a key share them: a kernel is one product with its weights. Here
    the pairs inside a chunk are summed by exponentials, too (``ERROR``).
    """
    names = [f"x{i}" for i in range(8)]

    def objective(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ks, natural = key_of(starts), np.exp(np.clip(points, -40, 40))
        places = {int(k): np.flatnonzero(ks == k) for k in np.unique(ks)}

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weights, sums = {}, {}
            for frame in frames:
                for k, *bytes_ in zip(*(frame[c.split()[0]] for c in BLOCK.split(", ")), strict=True):
                    if k not in places:
                        continue
                    if k not in weights:
                        weights[k] = np.concatenate([match(rates, c, [1 + theta, 2 + theta], horizon, with_log=True)[0] for _, _, c, theta in natural[places[k]]]).T
                        sums[k] = np.zeros((len(places[k]), 8))
                    t, s, size, tied, state = (np.frombuffer(x) for x in bytes_)
                    t, s, state = t.reshape(-1, LENGTH).T, s.reshape(-1, LENGTH).T, state.reshape(-1, len(rates))
                    for i in range(0, len(size), 64):
                        cut = slice(i, i + 64)
                        real = (np.arange(LENGTH)[:, None] < size[cut]).astype(float).ravel()
                        with np.errstate(all="ignore"):
                            each = np.ascontiguousarray((_earlier(t[:, cut], s[:, cut], tied[cut], state[cut], rates).reshape(-1, len(rates)) @ weights[k]).T)
                            for j, parameters in enumerate(natural[places[k]]):
                                sums[k][j] += _sums(parameters, t[:, cut].ravel(), s[:, cut].ravel(), real, *each[3 * j : 3 * j + 3], horizon)
            for k, found in sums.items():
                yield pd.DataFrame(np.where(np.isnan(found), np.inf, found), columns=names).assign(place=places[k])  # NaN would be a null, which sums pass over

        each = blocks.mapInPandas(run, ", ".join([*[f"{n} double" for n in names], "place int"]))
        found = {row["place"]: np.array(row[1:]) for row in each.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).collect()}  # eight numbers a point
        with np.errstate(all="ignore"):
            both = [_value_and_slopes(tuple(natural[i]), found[i], horizon) for i in range(len(points))]
        value, slopes = np.array([v for v, _ in both]), np.array([g for _, g in both])
        fine = np.isfinite(value) & np.isfinite(slopes).all(1)
        return np.where(fine, value, np.inf), np.where(fine[:, None], slopes, 0.0)

    return objective


FIT = "key string, start int, n bigint, loglik double, mu double, alpha double, c double, theta double, se_mu double, se_alpha double, se_c double, se_theta double, branching double, converged boolean"


def _power_law_start(seed: int, start: int, n: int, gap: float, mean: float, horizon: float) -> np.ndarray:
    g = np.random.default_rng((seed, start))
    theta, c, share = math.exp(g.uniform(math.log(0.2), math.log(2))), gap * math.exp(g.uniform(math.log(0.1), math.log(5))), g.uniform(0.1, 0.8)
    return np.log([n / horizon * g.uniform(0.2, 1), share * theta * c**theta / max(mean, 1e-9), c, theta])


def _bounded(objective, low: np.ndarray, high: np.ndarray):
    """``objective`` of batches of points, held inside bounds by a penalty; a run-away trial step is infinite, and refused."""
    def held(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.clip(x, low, high)
        with np.errstate(over="ignore", invalid="ignore"):
            value, slope = objective(inside, own)
        return value + 1e3 * ((x - inside) ** 2).sum(1), np.where(x == inside, slope, 0) + 2e3 * (x - inside)

    return held


def _errors(objective, x: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray) -> list[list[float | None]]:
    """Standard errors of the natural parameters at points, by their curvature; none where that is not positive definite or at a bound."""
    steps = 1e-4 * np.concatenate([np.zeros((1, 4)), np.eye(4), -np.eye(4)])
    slopes = objective((x[:, None] + steps).reshape(-1, 4), np.repeat(own, len(steps)))[1].reshape(len(x), len(steps), 4)
    out = []
    for point, g in zip(x, slopes, strict=True):
        bend, est = (g[1:5] - g[5:]) / 2e-4, np.exp(point)  # bend: in the logarithms
        natural = ((bend + bend.T) / 2 - np.diag(g[0])) / np.outer(est, est)
        inner = bool((point > low).all() and (point < high).all() and np.isfinite(natural).all())
        out.append(np.sqrt(np.diag(np.linalg.inv(natural))).tolist() if inner and np.linalg.eigvalsh(natural).min() > 0 else [None] * 4)
    return out


def power_law_fit(events: DataFrame, horizon: float, starts: int = 8, seed: int = 7, rounds: int = 200, key: str = "key", most: int = HOT_EVENTS) -> DataFrame:
    """Best of several seeded starts per key: parameters, standard errors, log likelihood, AIC, branching ratio and cascade.

    Each (key, start) is a task over the key's chunks, linear in its events; gradients are exact. Keys of more than ``most`` events stay in blocks
    of chunks, and each step of all their starts is one Spark job over these. Errors come from the curvature in the natural
    parameters (null where it is not positive definite, as at a bound). c is sought between a hundredth of the mean gap and the horizon,
    theta up to ``MOST_THETA``: steeper kernels are next to exponential. Keys below ten events have no fit.
    """
    spark = events.sparkSession
    named = events.select(F.col(key).cast("string").alias("key"), "event_id", "t", "s").where("t is not null and s is not null")
    facts = materialise(named.groupBy("key").agg(F.count("*").alias("n"), ((F.max("t") - F.min("t")) / F.count("*")).alias("gap"), F.avg("s").alias("m")).where("n >= 10 and gap > 0"), "facts")
    least = facts.agg(F.min("gap")).first()[0]
    if least is None:
        return spark.createDataFrame([], FIT + ", aic double, cascade double, n_starts int, n_converged bigint")
    bottom = least / 100
    rates = rates_for(bottom, horizon)
    parts = chunks(named, rates)
    small = facts.where(F.col("n") <= most).withColumnRenamed("key", "_key")
    packed = parts.join(small, F.col("key").eqNullSafe(F.col("_key"))).groupBy("key", "n", "gap", "m").agg(F.array_sort(F.collect_list(F.struct("t0", "tied", "t", "s", "state"))).alias("parts"))  # fits in a task, see above
    jobs = packed.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).repartition("key", "start")
    low, high = np.array([-40, -40, math.log(bottom), math.log(0.01)]), np.array([40, 40, math.log(horizon), math.log(MOST_THETA)])
    columns = [c.split()[0] for c in FIT.split(", ")]

    def fitted(row, start: int, x: np.ndarray, value: float, se: list, sure: bool) -> tuple:
        est = [float(v) for v in np.exp(x)]
        return (row.key, int(start), int(row.n), -float(value), *est, *se, float(est[1] * est[2] ** -est[3] / est[3] * row.m), bool(sure))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                pairs = Pairs(pd.DataFrame([dict(x.asDict()) if hasattr(x, "asDict") else dict(x) for x in row.parts]), rates)

                def each(points: np.ndarray, own: np.ndarray, pairs=pairs) -> tuple[np.ndarray, np.ndarray]:
                    both = [negative_loglik(p, pairs, rates, horizon) for p in points]
                    return np.array([v for v, _ in both]), np.array([g for _, g in both])

                objective, own = _bounded(each, low, high), np.zeros(1, int)
                x, value, _, sure = minimise_by_gradient(lambda p, f=objective: tuple(a[0] for a in f(p[None], own)), _power_law_start(seed, int(row.start), row.n, row.gap, row.m, horizon), rounds)
                x = np.clip(x, low, high)
                out.append(fitted(row, row.start, x, value, _errors(objective, x[None], low, high, own)[0], sure))
            yield pd.DataFrame(out, columns=columns)

    fits, batch = jobs.mapInPandas(run, FIT), []

    def fit_hot(batch: list) -> DataFrame:
        objective = _bounded(_block_objective(_blocks(parts, batch), rates, horizon, lambda own: own // starts), low, high)
        x0 = np.stack([_power_law_start(seed, i, row["n"], row["gap"], row["m"], horizon) for row in batch for i in range(starts)])
        x, value, _, sure = minimise_many(objective, x0, rounds, tolerance=1e-10, owned=True, slopes=True, flat=True)
        x = np.clip(x, low, high)
        best = np.arange(len(batch)) * starts + value.reshape(-1, starts).argmin(1)
        se = dict(zip(best.tolist(), _errors(objective, x[best], low, high, best), strict=True))  # only these rows stay
        return spark.createDataFrame([fitted(row, i % starts, x[i], value[i], se.get(i, [None] * 4), sure[i]) for k, row in enumerate(batch) for i in range(k * starts, (k + 1) * starts)], FIT)

    for row in facts.where(F.col("n") > most).toLocalIterator():
        batch.append(row)
        if len(batch) == HOT_KEYS:
            fits, batch = fits.unionByName(fit_hot(batch)), []
    if batch:
        fits = fits.unionByName(fit_hot(batch))
    fits = materialise(fits, "powerlaw")
    best = fits.groupBy("key").agg(F.max_by(F.struct(*[c for c in fits.columns if c != "key"]), F.struct("loglik", -F.col("start"))).alias("b"), F.count("*").cast("int").alias("n_starts"), F.count(F.when(F.col("converged"), 1)).alias("n_converged"))
    out = best.select("key", "b.*", "n_starts", "n_converged")
    return out.withColumns({"aic": 8 - 2 * F.col("loglik"), "cascade": F.when(F.col("branching") < 1, 1 / (1 - F.col("branching")))})


def simulate_power_law(mu: float, alpha: float, c: float, theta: float, horizon: float, seed: int, marks=None) -> tuple[np.ndarray, np.ndarray]:
    """Times and marks by thinning; between events the intensity falls, so its value just now is a bound."""
    g = np.random.default_rng(seed)
    draw = marks or (lambda rng: rng.uniform())
    times, weights, t = [], [], 0.0

    def intensity(at: float) -> float:
        return mu + alpha * float((np.array(weights) * (at - np.array(times) + c) ** -(1 + theta)).sum()) if times else mu

    while True:
        top = intensity(t)
        t += g.exponential(1 / top)
        if t > horizon:
            return np.array(times), np.array(weights)
        if g.uniform() * top <= intensity(t):
            times.append(t)
            weights.append(float(draw(g)))


def compare_kernels(events: DataFrame, horizon: float, starts: int = 4, rounds: int = 200, key: str = "key") -> DataFrame:
    """(key, kernel, n, loglik, aic, branching, converged, ks, ks_p, preferred): the exponential and the power-law kernel on one window.

    Both are fitted to all of a key's events up to ``horizon``; waiting times are rescaled by each key's own fit and held against the unit
    exponential. The kernel with the lower AIC is preferred, whatever its test says.
    """
    named = events.select(F.col(key).cast("string").alias("key"), "event_id", "t", "s").where("t is not null and s is not null")
    short = materialise(hawkes_fit(named, horizon, starts=starts, rounds=rounds), "exponential")
    long = materialise(power_law_fit(named, horizon, starts=starts, rounds=rounds), "powerlaw")
    with_fit = named.join(short.select("key", "mu", "alpha", "beta"), "key")
    scanned = news.decay_scan(with_fit, F.col("beta"), ["t", "event_id"])
    exponential = scanned.withColumn("tau", F.col("mu") * F.col("t") + F.col("alpha") / F.col("beta") * (F.col("before") - F.col("a")))
    least = long.agg(F.min("c")).first()[0] or 1.0
    rates = rates_for(least, horizon)
    tailed = power_law_states(chunks(named, rates).join(long.select("key", "mu", "alpha", "c", "theta"), "key"), rates, horizon)

    def tested(states: DataFrame, fits: DataFrame, name: str, parameters: int) -> DataFrame:
        ks = news.ks_exponential(news.rescaled_gaps(states)).select("key", F.col("d").alias("ks"), F.col("p").alias("ks_p"))
        return fits.join(ks, "key", "left").select("key", F.lit(name).alias("kernel"), "n", "loglik", (2 * parameters - 2 * F.col("loglik")).alias("aic"), "branching", "converged", "ks", "ks_p")

    both = tested(exponential, short, "exponential", 3).unionByName(tested(tailed, long, "power law", 4))
    first = F.row_number().over(Window.partitionBy("key").orderBy("aic", "kernel"))  # two rows a key
    return both.withColumn("preferred", first == 1)
