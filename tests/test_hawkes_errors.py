"""Errors and intervals of Hawkes fits on simulated processes, whole and cut; ditherings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import estimate, hawkes_errors

MU, ALPHA, BETA, HORIZON = 15.0, 6.0, 8.0, 24.0  # n = 0.375 with marks that are uniform
SCHEMA = "key string, event_id bigint, t double, s double"


@pytest.fixture(scope="module")
def replicas(spark):
    rows = []
    for k in range(20):
        t, s = estimate.simulate_hawkes(MU, ALPHA, BETA, HORIZON, 100 + k)
        rows += [(f"k{k}", 10_000 * k + i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, s))]
    return spark.createDataFrame(rows, SCHEMA).repartition(8).cache()


def test_intervals_hold_the_truth(spark, replicas):
    fits = estimate.hawkes_fit(replicas, HORIZON, starts=2, rounds=80).cache()
    out = hawkes_errors.hawkes_intervals(replicas, HORIZON, fits).toPandas()
    truth = ALPHA * 0.5 / BETA
    assert len(out) == 20 and out["settled"].sum() >= 18
    assert ((out["low"] < truth) & (truth < out["high"])).sum() >= 18
    assert (out["low"] < out["n"]).all() and (out["n"] < out["high"]).all()
    assert ((np.abs(out["n"] - truth) / out["se_n"]) < 3.5).all() and out["se_mu"].between(0.5, 6).all()


def test_keys_in_stretches_have_the_same_interval(spark, replicas):
    one = replicas.where("key = 'k3'").withColumn("key", F.lit(None).cast("string"))
    fits = estimate.hawkes_fit(one, HORIZON, starts=1, rounds=60).cache()
    whole, cut = (hawkes_errors.hawkes_intervals(one, HORIZON, fits, most=m).first() for m in (10_000, 100))
    assert whole["key"] is None and cut["key"] is None and cut["settled"]
    for c in ("n", "se_mu", "se_n", "low", "high"):
        assert cut[c] == pytest.approx(whole[c], rel=2e-2), c
    value = lambda n: estimate.profile_branching(one, HORIZON, fits, [n]).first()["loglik"]
    assert fits.first()["loglik"] - value(whole["high"]) == pytest.approx(hawkes_errors.Z**2 / 2, abs=0.05)


def test_dithered_fits_are_pooled(spark, replicas):
    two = replicas.where("key in ('k1', 'k2')").withColumn("t", F.floor(F.col("t") * 96) / 96)
    drawn = hawkes_errors.dithered(two, 1 / 96, 3).toPandas()
    assert len(drawn) == 3 * two.count() and drawn.groupby("event_id")["t"].nunique().min() == 3
    start = np.floor(drawn["t"] * 96 + 1e-9)
    assert (start.groupby(drawn["event_id"]).nunique() == 1).all()
    out = {r["key"]: r for r in hawkes_errors.dither_sweep(two, 1 / 96, HORIZON, seeds=3, starts=2, rounds=60).collect()}
    assert set(out) == {"k1", "k2"}
    for r in out.values():
        assert r["seeds"] == 3 and r["total"] == pytest.approx(r["within"] + 4 / 3 * r["between"]) and r["low"] < r["pooled"] < r["high"] and 0.1 < r["pooled"] < 0.7
        assert r["between_starts"] < 0.2


@pytest.mark.parametrize("point", [(15.0, 6.0, 8.0), (2.0, 400.0, 9_000.0), (3.0, 0.05, 0.002), (20.0, 1e13, 3e13)])
def test_slopes_of_the_likelihood(point):
    """Against differences of a plain loop over the events; tied times and events beyond the horizon included."""
    g = np.random.default_rng(4)
    t, s = np.sort(np.round(g.uniform(0, 26, 700), 2)), g.uniform(0, 1, 700)

    def plain(theta):
        mu, alpha, beta = np.exp(theta)
        a, logs = 0.0, 0.0
        for i in range(len(t)):
            a = np.exp(-beta * (t[i] - t[i - 1])) * (a + s[i - 1]) if i else 0.0
            logs += np.log(mu + alpha * a)
        return mu * HORIZON - alpha / beta * (s * np.expm1(-beta * np.maximum(HORIZON - t, 0))).sum() - logs

    theta = np.log(point)
    value, slopes = estimate.hawkes_value_and_slopes(theta, t, s, HORIZON)
    assert value[0] == pytest.approx(plain(theta), rel=1e-12)
    assert np.allclose(slopes[0], [(plain(theta + e) - plain(theta - e)) / 2e-4 for e in 1e-4 * np.eye(3)], rtol=1e-4, atol=1e-3)
    # cut in two, the first half's sums carried on
    beta = np.array([point[2]])
    carry = np.exp(-beta * (t[300] - t[299])) * np.stack([(left := estimate._left_behind(t[:300], s[:300], beta))[0], left[1] + (t[300] - t[299]) * left[0]])
    none = np.zeros(1)
    halves = estimate._hawkes_stretch(theta[None], t[:300], s[:300], HORIZON, t[0], none, none) + estimate._hawkes_stretch(theta[None], t[300:], s[300:], HORIZON, t[300], *carry)
    assert np.allclose(halves, estimate._hawkes_stretch(theta[None], t, s, HORIZON, t[0], none, none), rtol=1e-9)


def test_errors_without_bounds_ask_for_the_curvature_alone(spark, replicas):
    t, s = (np.array(x) for x in zip(*replicas.where("key = 'k3'").orderBy("t").select("t", "s").collect()))
    theta, calls = np.log([[MU, ALPHA, BETA]]), []

    def objective(points, own):
        calls.append(len(points))
        return estimate.hawkes_value_and_slopes(points, t, s, HORIZON)

    mean, variance = np.array([s.mean()]), np.array([s.var() / len(s)])
    short = hawkes_errors.intervals(objective, theta, mean, variance, most=0).iloc[0]
    assert calls == [1, 6] and np.isnan(short["low"]) and not short["settled"]
    whole = hawkes_errors.intervals(objective, theta, mean, variance).iloc[0]
    assert short["se_n"] == whole["se_n"] and short["n"] == whole["n"]
