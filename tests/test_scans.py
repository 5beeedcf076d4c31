"""Running values over hot keys, and the power-law process, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import asof, powerlaw, prefix

SCHEMA = "key string, t double, id bigint, x double"


@pytest.fixture(scope="module")
def hot(spark):
    g = np.random.default_rng(8)
    rows = [("hot" if i % 10 else None, float(g.integers(0, 400)), i, None if i % 7 == 0 else float(g.normal(5, 2))) for i in range(2_000)] + [(f"k{i}", 1.0, 5_000 + i, 2.0) for i in range(50)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def test_scan_of_a_key_over_many_ranges_equals_windows(spark, hot):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = prefix.scan(hot, ["key"], ["t", "id"], sums={"total": F.col("x")}, lasts={"known": F.col("x")}, nexts={"coming": F.col("x")}, lags={"before": F.col("x")}, moments={"m": F.col("x")}, position="at", back=[F.col("t").desc(), F.col("id").desc()])
        assert got.where("key = 'hot'").count() == 1_800
        w = Window.partitionBy("key").orderBy("t", "id")
        rows, back = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("key").orderBy(F.col("t").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
        want = hot.select("*", F.sum(F.coalesce("x", F.lit(0.0))).over(rows).alias("total"), F.last("x", True).over(rows).alias("known"), F.last("x", True).over(back).alias("coming"),
                          F.lag("x").over(w).alias("before"), F.count("x").over(rows).alias("n"), F.stddev_samp("x").over(rows).alias("sd"), F.row_number().over(w).alias("at"))
        a = got.select("*", F.col("m.n").alias("n"), prefix.sample_deviation(F.col("m")).alias("sd")).toPandas().set_index("id").sort_index()
        b = want.toPandas().set_index("id").sort_index()
        assert len(a) == len(b) == 2_050
        for c in ("total", "known", "coming", "before", "n", "sd", "at"):
            assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scan_of_nothing_and_names_that_exist(spark, hot):
    assert prefix.scan(hot.where("false"), ["key"], ["t"], sums={"s": F.col("x")}).collect() == []
    out = prefix.scan(hot.where("key = 'k1'"), ["key"], ["t"], sums={"x": F.col("x") + 1})
    assert out.columns == ["key", "t", "id", "x"] and out.first()["x"] == 3.0


def test_asof_of_a_hot_key(spark):
    left = spark.createDataFrame([("a", float(i), i) for i in range(300)], "k string, on double, id bigint").repartition(5)
    right = spark.createDataFrame([("a", 50.5, 1.0), ("a", 200.0, 2.0), ("a", 201.0, None)], "k string, on double, v double")
    back = {r["id"]: r["v"] for r in asof.asof_backward(left, right, "on", ["k"], ["v"]).collect()}
    assert back[50] is None and back[51] == 1.0 and back[199] == 1.0 and back[200] == 2.0 and back[299] is None
    near = {r["id"]: (r["matched_on"], r["v"]) for r in asof.asof_nearest(left, right, "on", ["k"], "v", 3.0).collect()}
    assert near[47] == (None, None) and near[48] == (50.5, 1.0) and near[53] == (50.5, 1.0) and near[197] == (200.0, 2.0) and near[200] == (200.0, 2.0) and near[204] == (201.0, None)


def all_pairs(t, s, c, power):
    gap = t[:, None] - t[None, :]
    return np.where(gap > 0, s[None, :] * (np.maximum(gap, 0) + c) ** -power, 0.0).sum(1)


@pytest.fixture(scope="module")
def process(spark):
    g = np.random.default_rng(1)
    t, s = np.sort(np.round(g.uniform(0, 30, 900), 1)), g.uniform(0, 1, 900)  # some 300 times: many ties
    keys = ["a" if i % 9 else None for i in range(900)]
    return t, s, keys, spark.createDataFrame([(k, i, float(a), float(b)) for i, (k, a, b) in enumerate(zip(keys, t, s))], "key string, event_id bigint, t double, s double").repartition(5).cache()


@pytest.mark.parametrize("c, theta", [(0.01, 0.3), (0.5, 1.5)])
def test_power_law_states_agree_with_all_pairs(spark, process, c, theta):
    t, s, keys, events = process
    rates = powerlaw.rates_for(c, 31.0)
    assert powerlaw.match(rates, c, [1 + theta], 31.0)[1] < powerlaw.ERROR
    out = powerlaw.power_law_states(powerlaw.with_kernel(powerlaw.chunks(events, rates), 0.5, 0.2, c, theta), rates, 31.0).toPandas().set_index("event_id").sort_index()
    assert len(out) == 900
    for key in ("a", None):
        own = np.array([k == key for k in keys])
        assert np.allclose(out["excess"][own], all_pairs(t[own], s[own], c, 1 + theta), rtol=1e-6, atol=1e-9)
        before = all_pairs(t[own], s[own], 1.0, 0.0)
        assert np.allclose(out["tau"][own], 0.5 * t[own] + 0.2 / theta * (c**-theta * before - all_pairs(t[own], s[own], c, theta)), rtol=1e-6)


def test_power_law_gradient_and_likelihood(spark, process):
    t, s, keys, events = process
    own, rates = np.array([k == "a" for k in keys]), powerlaw.rates_for(0.001, 31.0)
    pairs = powerlaw.Pairs(powerlaw.chunks(events.where("key = 'a'"), rates).toPandas(), rates)
    psi = np.log([20, 0.3, 0.02, 0.4])
    value, slope = powerlaw.negative_loglik(psi, pairs, rates, 31.0)
    mu, alpha, c, theta = np.exp(psi)
    lam = mu + alpha * all_pairs(t[own], s[own], c, 1 + theta)
    assert value == pytest.approx(mu * 31 + alpha / theta * (s[own] * (c**-theta - (31 - t[own] + c) ** -theta)).sum() - np.log(lam).sum(), rel=1e-8)
    numeric = [(powerlaw.negative_loglik(psi + e, pairs, rates, 31.0)[0] - powerlaw.negative_loglik(psi - e, pairs, rates, 31.0)[0]) / 2e-5 for e in 1e-5 * np.eye(4)]
    assert np.allclose(slope, numeric, rtol=1e-4)
    table = {r["key"]: r["loglik"] for r in powerlaw.power_law_loglik(events, mu, alpha, c, theta, 31.0).collect()}
    assert table["a"] == pytest.approx(-value, rel=1e-8) and set(table) == {"a", None}


def test_power_law_fit_beats_the_truth_and_comparison_prefers_it(spark):
    t, s = powerlaw.simulate_power_law(5.0, 0.1, 0.05, 0.6, 60.0, 3)
    events = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, s))], "key string, event_id bigint, t double, s double")
    out = {r["kernel"]: r for r in powerlaw.compare_kernels(events, 60.0, starts=2).collect()}
    best = out["power law"]
    lam = 5.0 + 0.1 * all_pairs(t, s, 0.05, 1.6)
    truth = np.log(lam).sum() - 5.0 * 60 - 0.1 / 0.6 * (s * (0.05**-0.6 - (60 - t + 0.05) ** -0.6)).sum()
    assert best["converged"] and 0 <= best["loglik"] - truth < 12 and best["n"] == len(t)
    assert best["ks_p"] > 0.01 and sum(r["preferred"] for r in out.values()) == 1 and 0 < out["exponential"]["branching"] < 1


def test_power_law_fit_of_too_few_events(spark):
    few = spark.createDataFrame([("k", i, float(i), 1.0) for i in range(5)], "key string, event_id bigint, t double, s double")
    assert powerlaw.power_law_fit(few, 10.0).collect() == []


def test_power_law_states_come_in_slices(spark):
    """No more than ``SLICE`` chunks are laid out at once, with the states of all."""
    g = np.random.default_rng(2)
    n = powerlaw.SLICE * powerlaw.LENGTH + 500
    t, s = np.sort(g.uniform(0, 31, n)), g.uniform(0, 1, n)
    events = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(t, s))], "key string, event_id bigint, t double, s double")
    rates = powerlaw.rates_for(0.05, 31.0)
    frames = list(powerlaw._states(powerlaw.with_kernel(powerlaw.chunks(events, rates), 0.5, 0.2, 0.05, 0.6).toPandas(), rates, 31.0))
    assert len(frames) > 1 and max(map(len, frames)) <= powerlaw.SLICE * powerlaw.LENGTH and sum(map(len, frames)) == n
    some = np.concatenate([f["excess"].to_numpy()[np.argsort(f["event_id"])][-3:] for f in frames])
    at = np.concatenate([np.sort(f["event_id"])[-3:] for f in frames])
    assert np.allclose(some, [(s[:i] * (t[i] - t[:i] + 0.05) ** -1.6).sum() for i in at], rtol=1e-6)


def test_power_law_keys_in_blocks_have_the_same_fit(spark, process):
    """Keys beyond ``most`` events are fitted over blocks of chunks; null keys and tied times included."""
    t, s = powerlaw.simulate_power_law(5.0, 0.1, 0.05, 0.6, 30.0, 3)
    own = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, s))], "key string, event_id bigint, t double, s double")
    events = own.unionByName(process[3].where("key is null or key = 'a'"))
    whole, cut = ({r["key"]: r for r in powerlaw.power_law_fit(events, 31.0, starts=2, most=most).collect()} for most in (10_000, 50))
    assert set(cut) == set(whole) == {"a", "k", None}
    for k, r in whole.items():
        assert cut[k]["n"] == r["n"] and cut[k]["n_starts"] == 2 and cut[k]["loglik"] == pytest.approx(r["loglik"], abs=2e-3), k
    assert cut["k"]["branching"] == pytest.approx(whole["k"]["branching"], rel=2e-2) and cut["k"]["converged"]
    assert cut["k"]["se_mu"] == pytest.approx(whole["k"]["se_mu"], rel=5e-2)
