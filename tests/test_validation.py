"""Checks, alignment, capture helpers and the estimator on small and awkward inputs."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import cleaning, optimise
from ledgerline.functions.kernels import Params
from ledgerline.operators import asof, audit, bootstrap, calibration, coverage, economic, estimate, news, walkforward
from ledgerline.plans.regime import FIXED
from ledgerline.sources import snapshots


def test_reliability_takes_the_top_label(spark):
    rows = [(0.2, 0.8, 0.1, 0.9), (0.8, 0.2, 0.1, 0.9), (0.3, 0.7, 0.6, 0.4), (0.0, 1.0, 0.0, 1.0)]
    top = calibration.top_label(spark.createDataFrame(rows, "xi_p_0 double, xi_p_1 double, xi_f_0 double, xi_f_1 double"))
    got = {r["bin"]: (r["n"], r["accuracy"]) for r in calibration.top_label_reliability(top).collect()}
    assert got[8] == (2, 0.5) and got[9] == (1, 1.0) and got[7] == (1, 0.0) or got[6] == (1, 0.0)
    assert sum(n for n, _ in got.values()) == 4 and len(got) == 10
    assert calibration.top_label_error(top.where("false")).first()["ece"] is None


def test_filtered_probabilities_are_refused(spark):
    rows = spark.createDataFrame([(0.2, 0.8, 0.2, 0.8), (0.6, 0.4, 0.6, 0.4)], "xi_p_0 double, xi_p_1 double, xi_f_0 double, xi_f_1 double")
    assert calibration.calibration_bundle(rows).first()["refused"]
    assert not calibration.calibration_bundle(rows.withColumn("xi_f_1", F.lit(0.5))).first()["refused"]


def test_scores_of_three_classes(spark):
    g = np.random.default_rng(2)
    p, f = g.dirichlet([1, 1, 1], 50), g.dirichlet([1, 1, 1], 50)
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(p, f)], ", ".join(f"xi_{x}_{i} double" for x in "pf" for i in range(3)))
    y = np.eye(3)[f.argmax(1)]
    out = calibration.brier_logloss(df, 3).first()
    assert out["brier"] == pytest.approx(((p - y) ** 2).sum(1).mean()) and out["logloss"] == pytest.approx(-(y * np.log(p)).sum(1).mean())


@pytest.mark.parametrize("lags", [[1.0, 2.0, 3.0, 13.0], [5.0, 5.0], [0.0], []])
def test_lag_histogram_is_closed_above(spark, lags):
    import pandas as pd

    got = [r["n"] for r in coverage.lag_histogram(spark.createDataFrame([(x,) for x in lags], "lag double"), "lag").orderBy("bin").collect()]
    assert got == ([int(n) for n in pd.cut(pd.Series(lags), bins=12).value_counts(sort=False)] if lags else [])


@pytest.mark.parametrize(("raw", "want"), [("+3.8%", None), ("-1.5K", -1500.0), (" 2 b ", 2e9), ("3.8%", 3.8), (".", None), ("1,950B", 1.95e12), ("--1", None), ("1.", None), ("5X", None)])
def test_numbers_follow_the_stated_grammar(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(cleaning.human_number(F.col("r")).alias("x")).first()["x"] == want


def test_slugs_keys_and_normal_cdf(spark):
    from math import erf, sqrt

    row = spark.createDataFrame([("--Ab c!!", "\t x ", {"Key": "v"})], "a string, b string, m map<string,string>").select(cleaning.slug(F.col("a")).alias("a"), cleaning.slug(F.lit("!!")).alias("q"), (cleaning.title_key(F.col("b")) == cleaning.title_key(F.lit("X"))).alias("same"), cleaning.any_case(F.col("m"), "no", "kEY").alias("v")).first()
    assert tuple(row) == ("ab_c", "query", True, "v")
    zs = [-8.0, -5.0, -1.3, 0.0, 0.7, 4.2, 6.9, 9.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(cleaning.normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * (1 + erf(z / sqrt(2))) for z in zs], abs=1e-11)


def test_margin_of_no_day_and_a_stale_revision(spark):
    rows = [("s", date(2024, 1, 1), 100.0, date(2024, 2, 26)), ("s", date(2024, 2, 1), 103.0, date(2024, 3, 25)), ("s", date(2024, 1, 1), 99.0, date(2024, 3, 26))]
    out = asof.point_in_time(spark.createDataFrame(rows, "series_id string, obs_date date, value double, realtime_start date"), margin=0).orderBy("avail_date").collect()
    assert [(r["avail_date"], r["value"]) for r in out] == [(date(2024, 2, 26), 100.0), (date(2024, 3, 25), 103.0)]


def test_headlines_fall_through_to_the_next_indicator(spark):
    heads = spark.createDataFrame([(1, "CPI and jobs", 100.0), (2, "jobs", 100.0), (3, "weather", 100.0), (4, None, 100.0), (5, "cpi", 1000.0)], "id int, title string, t double")
    releases = spark.createDataFrame([("CPI", 5000.0), ("JOBS", 95.0), ("JOBS", 104.0)], "indicator string, t double")
    out = {r["id"]: (r["event_indicator"], r["event_at"]) for r in asof.match_events(heads, releases, [("CPI", "cpi"), ("JOBS", "jobs")], "t", "id", "title", 10.0).collect()}
    assert out == {1: ("JOBS", 104.0), 2: ("JOBS", 104.0), 3: (None, None), 4: (None, None), 5: (None, None)}


@pytest.mark.parametrize("beta", [0.5, 8.0, 300.0])
def test_decay_scan_against_a_loop(spark, beta):
    from ledgerline.functions.kernels import decay_state

    g = np.random.default_rng(3)
    t, s = np.sort(np.append(g.uniform(0, 40, 200), [100.0, 100.0])), g.uniform(size=202)
    rows = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, s))], "key string, event_id long, t double, s double").repartition(3)
    out = {r["event_id"]: r for r in news.decay_scan(rows, beta, ["t", "event_id"]).collect()}
    assert np.allclose([out[i]["a"] for i in range(202)], decay_state(t, s, beta), rtol=1e-9, atol=1e-12)
    assert np.allclose([out[i]["before"] for i in range(202)], np.cumsum(s) - s)


def test_conditional_statistics_are_suppressed(spark):
    g = np.random.default_rng(5)
    rows = [("a", i, float(g.normal(0, 1)), i % 2) for i in range(600)] + [("a", 1000 + i, float(g.normal()), 2) for i in range(20)]
    out = {(r["regime"], r["metric"]): r for r in bootstrap.conditional_stats(spark.createDataFrame(rows, "asset string, fecha int, r double, argmax_idx int"), [12.0, 1.3, 30.0], replicas=60).collect()}
    assert out[0, "sharpe"]["ci_low"] < out[0, "sharpe"]["value"] < out[0, "sharpe"]["ci_high"] and out[0, "maxdd"]["ci_low"] is None and out[0, "maxdd"]["value"] < 0
    for regime in (1, 2):  # short-lived; rarely seen
        assert out[regime, "mean_ann"]["value"] is None and out[regime, "vol_ann"]["value"] > 0 and out[regime, "vol_ann"]["ci_low"] is None


def test_economic_verdict_needs_an_interval_above_zero(spark):
    g = np.random.default_rng(6)
    bad = np.repeat(g.random(40) < 0.3, 20)
    rows = [("a", i, float(g.normal(-1.0 if b else 0.2, 0.5)), float(b)) for i, b in enumerate(bad)]
    frame = spark.createDataFrame(rows, "asset string, fecha int, r double, xi_f_1 double")
    assert economic.verdict(frame, "xi_f_1", replicas=99).first()["success"]
    assert not economic.verdict(frame.withColumn("xi_f_1", F.lit(0.0)), "xi_f_1", replicas=99).first()["success"]


def test_relevance_scores_each_title_once(spark, tmp_path):
    heads = spark.createDataFrame([("A",), (" a ",), ("b",), (None,)], "title string")
    cache = spark.createDataFrame([], "key string, s double")
    out = audit.score_missing(heads, cache, lambda titles: [0.25 for _ in titles])
    assert [r["s"] for r in out.collect()] == [0.75, 0.75]
    assert audit.score_missing(heads, out, lambda titles: 1 / 0).count() == 2
    assert audit.with_relevance(heads, out).where("s is null").count() == 1


def test_flags_and_scaler(spark):
    flat = Params(mu=(0, 0), v=(1.0, 2.0), alpha=(0.1, 0.1), gamma=(0.0, 0.0), beta=(0.8, 0.8), P=((0.5, 0.5), (0.48, 0.52)))
    rows = audit.degenerate(audit.params_table(spark, flat)).collect()
    assert all(r["near_rank_one"] for r in rows) and rows[0]["expected_duration"] == pytest.approx(2.0) and not rows[1]["degenerate"]
    assert audit.regime_labels(3) == ["low volatility", "medium volatility 1", "high volatility"]
    with pytest.raises(ValueError, match="spread"):
        audit.checked_scaler(spark.createDataFrame([(1.0,), (1.0,)], "x double"), ["x"])
    broken = audit.violations(spark.createDataFrame([(1,), (None,)], "x int"), {"positive": F.col("x") > 0}).first()
    assert (broken["n"], broken["broken"]) == (2, 1)


def test_slopes_against_priors(spark):
    rows = spark.createDataFrame([("up", 0, 0, 2.0, 0.5), ("up", 1, 0, -2.0, 0.5), ("other", 0, 0, 1.0, None)], "covariate string, origin int, target int, beta double, se double")
    out = {(r["covariate"], r["origin"]): (r["effect"], r["prior"], r["significant"]) for r in audit.slope_signs(rows, {"up": "-"}).collect()}
    assert out == {("up", 0): ("-", "agrees", True), ("up", 1): ("+", "contrary", True), ("other", 0): ("-", "no prior", False)}


def test_pages_by_cursor_and_bisected_windows():
    data = [{"t": i} for i in range(25)]
    assert list(snapshots.by_cursor(lambda start, size: [r for r in data if r["t"] >= start][:size], 0, 10, lambda r: r["t"] + 1)) == data
    with pytest.raises(ValueError, match="stays"):
        list(snapshots.by_cursor(lambda start, size: data[:size], 0, 10, lambda r: 0))
    begin, hour = datetime(2024, 1, 1), timedelta(hours=1)
    times = [begin + timedelta(minutes=m) for m in range(0, 300, 3)] + [begin + timedelta(minutes=61, seconds=k) for k in range(50)]
    found = list(snapshots.bisected(lambda a, b: [x for x in times if a <= x < b][:30], begin, begin + 8 * hour, 30, hour))
    assert found[0]["start"] == begin and found[-1]["end"] == begin + 8 * hour and all(x["end"] == y["start"] for x, y in zip(found, found[1:]))
    assert [s["start"] for s in found if s["cap_hit"]] == [begin + hour] and sum(len(s["rows"]) for s in found if not s["cap_hit"]) == 80

    def capped(a, b):
        if b - a > 3:
            raise snapshots.CapReached
        return [a, b]

    assert snapshots.in_chunks(capped, 1900, 1909) == [1900, 1903, 1904, 1907, 1908, 1909] and snapshots.in_chunks(capped, 1900, 1902) == [1900, 1902]


def test_capture_stops_at_walls_and_resumes(spark, tmp_path):
    written = []

    def fetch(day):
        if day in (7, 6, 5):
            raise snapshots.RateLimited
        return day

    assert snapshots.capture_days(range(10), fetch, lambda d, x: written.append(d), walls=3) == ([9, 8], True)
    days, got = (spark.createDataFrame([(x,) for x in v], "day int") for v in (range(10), written))
    assert [r["day"] for r in snapshots.missing_captures(days, got, 3).collect()] == [7, 6, 5]
    frame = spark.range(3)
    assert snapshots.write_once(frame, f"{tmp_path}/s_2024.parquet") and not snapshots.write_once(frame, f"{tmp_path}/s_2024.parquet")
    assert snapshots.cached(spark, f"{tmp_path}/c", lambda: frame).count() == 3 and snapshots.cached(spark, f"{tmp_path}/c", lambda: 1 / 0).count() == 3
    (tmp_path / "w").mkdir()
    for n in ("x_1.txt", "x_2.txt"):
        (tmp_path / "w" / n).write_text("1")
    assert snapshots.newest_snapshot(spark, f"{tmp_path}/w", "x_*").endswith("x_2.txt")
    sources = snapshots.Sources()
    sources.add("a", None)
    sources.add("b", None, "KEY")
    assert sources.available({}) == ["a"] and sources.available({"KEY": "k"}) == ["a", "b"]
    raw = spark.createDataFrame([("s", "2024-01-01", "2024-02-01", "."), ("s", "2024-01-01", "2024-02-02", "1.5"), ("s", "2024-01-01", "2024-02-02", "1.5")], "series_id string, obs_date string, realtime_start string, value string")
    assert snapshots.vintage_rows(raw).count() == 1
    bars = spark.createDataFrame([("x", 0, "1.0", 1), ("x", 0, "2.0", 2)], "asset string, open_time long, close string, ingested int")
    assert snapshots.candles(bars).first()["close"] == 2.0


@pytest.mark.parametrize("shape", [estimate.Shape(1), estimate.Shape(2, True, True), estimate.Shape(3, True)])
def test_shapes_pack_and_unpack(shape):
    theta = np.random.default_rng(1).normal(size=(2, shape.size))
    n = {k: v[1] for k, v in estimate.unpack(theta, shape).items()}
    back = estimate.pack(shape, n["mu"], n["v"], n["alpha"], n["gamma"], n["beta"], n["P"], n.get("nu"), n.get("B"))
    again = {k: v[0] for k, v in estimate.unpack(back, shape).items()}
    assert all(np.allclose(again[k], n[k]) for k in n)


def test_likelihood_agrees_with_the_filter_kernel():
    from ledgerline.functions import kernels

    moving = Params(mu=FIXED.mu, v=FIXED.v, alpha=FIXED.alpha, gamma=FIXED.gamma, beta=FIXED.beta, P=FIXED.P, nu=(5.0, 9.0), d=((2.9,), (-2.2,)), B=((-0.4,), (0.3,)))
    x = np.random.default_rng(2).normal(size=80)
    r, _ = estimate.simulate(moving, 80, 5, x=x)
    a, shape = moving.arrays(), estimate.Shape(2, True, True)
    theta = estimate.pack(shape, a["mu"], a["v"], a["alpha"], a["gamma"], a["beta"], a["P"], a["nu"], a["B"])
    theta[:2] = a["d"].ravel()
    P0 = kernels.transitions(a["d"], a["B"], np.zeros(1))[0]
    want = kernels.run_filter(r, Params(**{**moving.__dict__, "P": tuple(map(tuple, P0))}), x)["ll"]
    assert np.allclose(estimate.step_logliks(theta, r, shape, x)[:, 0], want)


def test_starts_in_step_find_the_minimum():
    rosenbrock = lambda t: 100 * (t[:, 1] - t[:, 0] ** 2) ** 2 + (1 - t[:, 0]) ** 2
    x, value, used, sure = optimise.minimise_many(rosenbrock, np.array([[-1.2, 1.0], [2.0, 2.0], [1.0, 1.0]]), 400)
    assert np.allclose(x, 1, atol=2e-3) and (value < 1e-5).all() and sure[2]


@pytest.fixture(scope="module")
def small(spark):
    r, _ = estimate.simulate(FIXED, 500, 3)
    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(500)]
    return spark.createDataFrame([("a", d, float(x), float(x) / 50) for d, x in zip(days, r)], "asset string, fecha date, r double, x double").cache()


def test_errors_penalties_and_decay(spark, small):
    shape = estimate.Shape(2)
    fit = estimate.best_fit(estimate.fit_starts(small, shape, starts=2, rounds=25))
    table = estimate.parameter_table(small, fit, shape).collect()
    assert {r["parameter"] for r in table} >= {"mu_0", "v_1", "P_00"} and sum(r["se"] is not None and r["se"] > 0 for r in table) >= len(table) // 2
    slopes = estimate.Shape(2, slopes=True)
    found = estimate.choose_penalty(small, slopes, [0.0, 50.0], "x", folds=2, starts=1, rounds=8).collect()
    assert len(found) == 2 and sum(r["chosen"] for r in found) == 1 and max(found, key=lambda r: r["score"])["chosen"]
    events = spark.createDataFrame([(date(2000, 1, 5), 1.0), (date(2000, 3, 1), -1.0)], "day date, c double")
    assert sum(r["chosen"] for r in estimate.fit_decay(small, events, [5.0, 50.0], slopes, starts=1, rounds=5).collect()) == 1
    with pytest.raises(ValueError, match="covariate"):
        estimate.fit_starts(small, slopes)


def test_bootstrap_ratio_of_a_small_series(spark, small):
    out = estimate.bootstrap_lr(small.limit(150), replicas=3, starts=1, rounds=5).first()
    assert 0 < out["p"] <= 1 and out["replicas"] == 3
