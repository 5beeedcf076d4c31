"""The half-life as a parameter: its covariate, and recovery from a simulated model."""

from datetime import date, timedelta

import numpy as np
import pytest

from ledgerline.functions.kernels import Params
from ledgerline.operators import decay_fit, estimate


def test_index_against_plain_sums():
    g = np.random.default_rng(1)
    days, at, c = np.sort(g.choice(200, 90, replace=False)).astype(float), np.sort(g.uniform(-5, 210, 30)), g.normal(size=30)
    rates = np.array([0.01, 0.5])
    want = np.array([[(c[at <= d] * np.exp(-k * (d - at[at <= d]))).sum() for k in rates] for d in days])
    assert np.allclose(decay_fit.decayed_index(days, at, c, rates), want)


def test_batches_of_half_lives_agree_with_one_covariate():
    shape, g = estimate.Shape(2, slopes=True), np.random.default_rng(2)
    r, days, at, c = g.normal(size=60), np.arange(60.0), np.arange(0.0, 60, 7), g.normal(size=9)
    points = np.stack([np.append(estimate.random_start(r, shape, s), np.log(h)) for s, h in enumerate((3.0, 40.0))])
    both = decay_fit.joint_objective(r, days, at, c, shape)(points)
    for k, h in enumerate((3.0, 40.0)):
        index = decay_fit.decayed_index(days, at, c, np.array([np.log(2) / h]))[:, 0]
        assert both[k] == pytest.approx(estimate.negative_loglik(points[k, :-1], r, shape, np.append(0.0, index[:-1]))[0])


def test_a_simulated_half_life_is_found(spark):
    g, n = np.random.default_rng(1), 2_600
    days = np.arange(n, dtype=float)
    at = days[::20]
    c = g.normal(size=len(at))
    index = decay_fit.decayed_index(days, at, c, np.array([np.log(2) / 20.0]))[:, 0]
    P = np.array([[0.88, 0.12], [0.12, 0.88]])
    truth = Params(mu=(0.0, 0.0), v=(1.0, 9.0), alpha=(0.03, 0.03), gamma=(0.02, 0.02), beta=(0.04, 0.04), P=tuple(map(tuple, P)), d=tuple((float(np.log(p[0] / p[1])),) for p in P), B=((-2.5,), (-2.5,)))
    r, _ = estimate.simulate(truth, n, 7, x=np.append(0.0, index[:-1]))
    first = date(2005, 1, 3)
    series = spark.createDataFrame([("a", first + timedelta(days=int(d)), float(x)) for d, x in zip(days, r)], "asset string, fecha date, r double")
    events = spark.createDataFrame([(first + timedelta(days=int(d)), float(x)) for d, x in zip(at, c)] + [(None, 1.0)], "day date, c double")
    out = decay_fit.fit_half_life(series, events, starts=4, rounds=45).first()
    assert out["half_life"] == pytest.approx(20.0, rel=0.5) and out["delta"] == pytest.approx(np.log(2) / out["half_life"])
    if out["se_half_life"] is not None:
        assert out["low"] < 20.0 < out["high"]
    with pytest.raises(ValueError, match="slopes"):
        decay_fit.fit_half_life(series, events, estimate.Shape(2))
