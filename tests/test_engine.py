"""Hand-made cases of the semantics that the queries' tables do not show, and recovery of known parameters."""

import json
from datetime import date, datetime
from math import lgamma

import numpy as np
import pytest

from ledgerline.functions import cleaning, kernels, optimise, specfun
from ledgerline.operators import asof, bootstrap, calibration, coverage, dedupe, economic, estimate, news, publish, rolling, walkforward
from ledgerline.plans.regime import FIXED
from ledgerline.sources import snapshots
from ledgerline.streaming import jobs

D = date.fromisoformat


def test_revised_vintages(spark):
    rows = [("s", D("2024-01-31"), 100.0, D("2024-02-26")), ("s", D("2024-01-31"), 101.5, D("2024-03-11")), ("s", D("2024-02-29"), 103.0, D("2024-03-25"))]
    out = asof.point_in_time(spark.createDataFrame(rows, "series_id string, obs_date date, value double, realtime_start date")).collect()
    assert sorted((str(r["avail_date"]), r["value"]) for r in out) == [("2024-02-27", 100.0), ("2024-03-12", 101.5), ("2024-03-26", 103.0)]


def test_stale_revision_is_ignored_and_weekends_move_on(spark):
    rows = [("s", D("2024-01-31"), 1.0, D("2024-02-26")), ("s", D("2024-02-29"), 2.0, D("2024-03-22")), ("s", D("2024-01-31"), 9.0, D("2024-03-25"))]
    out = asof.point_in_time(spark.createDataFrame(rows, "series_id string, obs_date date, value double, realtime_start date")).collect()
    assert sorted((str(r["avail_date"]), r["value"]) for r in out) == [("2024-02-27", 1.0), ("2024-03-25", 2.0)]  # Friday goes to Monday


def test_nearest_takes_the_past_on_a_tie_and_keeps_the_tolerance(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 16), (3, "k", 100), (4, "z", 10)], "id int, key string, t int")
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 15, 2.0), ("k", 17, 3.0)], "key string, t int, value double")
    out = {r["id"]: r["matched_on"] for r in asof.asof_nearest(left, right, "t", ["key"], "value", 5).collect()}
    assert out == {1: 5, 2: 15, 3: None, 4: None}  # rows without a match stay, with nulls


def test_first_non_null_is_never_overwritten(spark):
    rows = [("a", 1, None, 5.0), ("a", 2, 7.0, 6.0), ("a", 3, 8.0, None)]
    out = dedupe.first_non_null_by(spark.createDataFrame(rows, "k string, at int, x double, y double"), ["k"], cleaning.F.col("at"), ["x", "y"]).first()
    assert (out["x"], out["y"]) == (7.0, 5.0)


@pytest.mark.parametrize(("raw", "want"), [("3.8%", 3.8), ("150K", 150e3), ("1,950B", 1950e9), ("-2.5m", -2.5e6), ("n/a", None), ("", None), (None, None), ("12 T", 12e12)])
def test_human_numbers(spark, raw, want):
    out = spark.createDataFrame([(raw,)], "r string").select(cleaning.human_number(cleaning.F.col("r")).alias("x")).first()["x"]
    assert out == pytest.approx(want) if want is not None else out is None


def test_full_windows_only(spark):
    rows = [("a", k, float(k) if k != 7 else None) for k in range(12)]
    df = spark.createDataFrame(rows, "asset string, fecha int, x double")
    out = {r["fecha"]: r["z"] for r in df.select("fecha", rolling.rolling_z(rolling.F.col("x"), 3, rolling.series()).alias("z")).collect()}
    assert out[1] is None and out[2] == pytest.approx(1.0) and out[8] is None and out[9] is None and out[10] == pytest.approx(1.0)


def test_observed_time_stands_still_on_missing_days(spark):
    events = spark.createDataFrame([(0.5,), (1.25,), (1.75,), (2.5,)], "t double")
    spine = spark.createDataFrame([(0, False), (1, True), (2, False)], "day_no int, is_missing boolean")
    assert sorted(r["t_observed"] for r in coverage.observed_time(events, "t", spine).collect()) == [0.5, 1.0, 1.0, 1.5]


def test_windows_are_contiguous_and_months_are_cut_to_their_end():
    w = walkforward.windows(D("2000-08-31"), D("2008-01-01"), 2, 6, 6)
    assert w[0][2] == D("2002-08-31") and w[0][3] == D("2003-02-28") and all(a[3] == b[2] for a, b in zip(w, w[1:], strict=False))
    with pytest.raises(ValueError, match="at least 6"):
        walkforward.windows(D("2000-01-01"), D("2005-01-01"), 4, 6)


def test_strategy_starts_invested_at_no_cost(spark):
    rows = [("a", 1, 0.9, 1.0), ("a", 2, 0.5, 1.0), ("a", 3, 0.1, 1.0)]
    out = economic.derisk(spark.createDataFrame(rows, "asset string, fecha int, p double, r double"), "p").orderBy("fecha").collect()
    assert [r["w"] for r in out] == [1.0, 0.0, 1.0] and [r["r_strategy"] for r in out] == pytest.approx([1.0, -0.02, 0.98])


def test_degenerate_direction_has_no_statistic(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "a double, f double")
    assert calibration.pesaran_timmermann(df, "a", "f").first()["stat"] is None


def test_special_functions():
    assert specfun.norm_cdf(1.959963984540054) == pytest.approx(0.975)
    assert specfun.student_sf(2.2281388519649385, 10) == pytest.approx(0.025, rel=1e-9)
    assert specfun.student_sf(-1.0, 1) == pytest.approx(0.75)
    assert specfun.chi2_1_sf(3.841458820694124) == pytest.approx(0.05)
    assert specfun.kolmogorov_sf(0.2, 20) > specfun.kolmogorov_sf(0.4, 20)


def brute_filter(r, p):
    """Hamilton's filter by sums over all regime paths' last two states, written out."""
    a = p.arrays()
    k, xi, s2, out, ll = len(a["mu"]), kernels.stationary(a["P"]), a["v"].copy(), [], 0.0
    for t, x in enumerate(r):
        if t:
            e = r[t - 1] - a["mu"]
            s2 = a["omega"] + (a["alpha"] + a["gamma"] * (e < 0)) * e * e + a["beta"] * s2
            xi = np.array([sum(xi[i] * a["P"][i, j] for i in range(k)) for j in range(k)])
        f = np.exp(-0.5 * ((x - a["mu"]) ** 2 / s2)) / np.sqrt(2 * np.pi * s2)
        ll += np.log((xi * f).sum())
        xi = xi * f / (xi * f).sum()
        out.append(xi)
    return np.array(out), ll


def test_filter_against_plain_loops_and_smoother_against_paths():
    r, _ = estimate.simulate(FIXED, 60, 1)
    got = kernels.run_filter(r, FIXED)
    want, ll = brute_filter(r, FIXED)
    assert np.allclose(got["filtered"], want) and got["ll"].sum() == pytest.approx(ll)
    logf = kernels.log_density(r[:6], np.array(FIXED.mu), got["s2"][:6])
    P, start = np.array(FIXED.P), kernels.stationary(np.array(FIXED.P))
    weights = {}
    for path in np.ndindex(*[2] * 6):
        weights[path] = start[path[0]] * np.prod([P[a, b] for a, b in zip(path, path[1:], strict=False)]) * np.exp(sum(logf[t, s] for t, s in enumerate(path)))
    pred, filt, _ = kernels.hamilton(logf, P, start)
    smooth = kernels.smooth(filt, pred, P)
    total = sum(weights.values())
    for t in range(6):
        assert smooth[t, 1] == pytest.approx(sum(w for p, w in weights.items() if p[t]) / total)


def test_student_density_has_the_variance_asked_for():
    x = np.linspace(-400, 400, 400_001)
    f = np.exp(kernels.log_density(x, np.zeros(1), np.full((len(x), 1), 4.0), np.array([5.0])))[:, 0]
    assert f.sum() * 0.002 == pytest.approx(1, abs=1e-4) and (f * x * x).sum() * 0.002 == pytest.approx(4, rel=1e-2) and lgamma(1) == 0


def test_transitions_and_covariate_contract():
    P = kernels.transitions(np.array([[2.0], [-2.0]]), np.array([[1.0], [0.5]]), np.array([0.0, 1.0]))
    assert np.allclose(P.sum(2), 1) and P[1, 0, 0] == pytest.approx(1 / (1 + np.exp(-3.0)))
    with pytest.raises(ValueError, match="covariate"):
        kernels.run_filter(np.zeros(3), FIXED, np.zeros(3))


def test_pack_and_unpack_are_inverse_and_variances_rise():
    a = FIXED.arrays()
    p = a["alpha"] + a["gamma"] / 2 + a["beta"]
    n = estimate.unpack(estimate.pack(estimate.Shape(2), a["mu"], a["v"], a["alpha"], a["gamma"], a["beta"], a["P"]), estimate.Shape(2))
    assert all(np.allclose(n[k][0], a[k]) for k in ("mu", "v", "alpha", "gamma", "beta", "omega", "P"))
    assert (np.diff(estimate.unpack(np.random.default_rng(0).normal(size=(5, estimate.Shape(3).size)), estimate.Shape(3))["v"]) > 0).all()


def test_minimise_finds_a_known_minimum():
    rosenbrock = lambda t: 100 * (t[:, 1] - t[:, 0] ** 2) ** 2 + (1 - t[:, 0]) ** 2
    x, value, _ = optimise.minimise(rosenbrock, np.array([-1.2, 1.0]), 500)
    assert np.allclose(x, 1, atol=1e-3) and value < 1e-6
    assert np.allclose(optimise.hessian(lambda t: (t**2).sum(1), np.array([1.0, 2.0])), 2 * np.eye(2), atol=1e-3)


def test_fit_beats_the_truth_and_starts_are_repeatable(spark):
    r, _ = estimate.simulate(FIXED, 400, 3)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(r)], "asset string, fecha int, r double")
    fits = estimate.fit_starts(df, estimate.Shape(2), starts=3, rounds=40)
    best = estimate.best_fit(fits).first()
    a = FIXED.arrays()
    truth = estimate.pack(estimate.Shape(2), a["mu"], a["v"], a["alpha"], a["gamma"], a["beta"], a["P"])
    assert best["loglik"] >= -estimate.negative_loglik(truth, r, estimate.Shape(2))[0] - 1 and best["n_starts"] == 3
    assert best["loglik"] == estimate.best_fit(estimate.fit_starts(df.repartition(3), estimate.Shape(2), starts=3, rounds=40)).first()["loglik"]


def test_hawkes_recovery_and_diagnostics(spark):
    t, s = estimate.simulate_hawkes(20.0, 6.0, 8.0, 60.0, 5)
    events = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, s, strict=True))], "key string, event_id bigint, t double, s double")
    fit = estimate.hawkes_fit(events, 60.0, starts=2, rounds=60).first()
    assert fit["branching"] == pytest.approx(6.0 * 0.5 / 8.0, abs=0.12) and fit["mu"] == pytest.approx(20, rel=0.3)
    a = kernels.decay_state(t, s, 8.0)
    assert a[50] == pytest.approx(sum(s[j] * np.exp(-8.0 * (t[50] - t[j])) for j in range(50)))
    ks = news.ks_exponential(news.rescaled_gaps(news.hawkes_states(events, 20.0, 6.0, 8.0))).first()
    assert specfun.kolmogorov_sf(ks["d"], ks["n"]) > 0.01
    ll = news.hawkes_loglik(events, 20.0, 6.0, 8.0, 60.0).first()["loglik"]
    assert ll == pytest.approx(-estimate.hawkes_negative_loglik(np.log([20.0, 6.0, 8.0]), t, s, 60.0)[0])


def test_hot_hawkes_keys_are_fitted_in_stretches(spark):
    """Keys cut into stretches have the states, fits and profiles of whole ones; null keys and tied times included."""
    rows, brute = [], {}
    for name, seed in (("a", 3), (None, 4)):
        t, s = estimate.simulate_hawkes(20.0, 6.0, 8.0, 20.0, seed)
        t[5:8] = t[5]
        rows += [(name, float(x), float(y)) for x, y in zip(t, s, strict=True)]
        brute[name] = (t, s)
    t, s = brute["a"]
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    mu, alpha, beta = 20.0, 6.0, 8.0
    seen = [sum(s[j] * np.exp(-beta * (t[i] - t[j])) for j in range(i)) for i in range(len(t))]
    value = mu * 20 + alpha / beta * (s * (1 - np.exp(-beta * (20 - t)))).sum() - np.log(mu + alpha * np.array(seen)).sum()
    assert estimate.hawkes_negative_loglik(np.log([mu, alpha, beta]), t, s, 20.0)[0] == pytest.approx(value)
    blocks = [x for _, x, _ in estimate._decayed(t, s, np.array([beta]), t[0], np.zeros(1), rows=7)]
    assert np.allclose(np.concatenate(blocks)[:, 0], seen)

    events = spark.createDataFrame([*rows, ("a", None, 1.0)], "key string, t double, s double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        whole = {r["key"]: r for r in estimate.hawkes_fit(events, 20.0, 2, rounds=8).collect()}
        cut = estimate.hawkes_fit(events, 20.0, 2, rounds=8, most=100)
        cut_rows = {r["key"]: r for r in cut.collect()}
        profiles = [{(r["key"], r["n"]): r["loglik"] for r in estimate.profile_branching(events, 20.0, cut, [0.3, 0.6], most=most).collect()} for most in (100, 10_000)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(whole) == set(cut_rows) == {"a", None}
    for k, r in whole.items():
        assert cut_rows[k]["n"] == r["n"] and cut_rows[k]["loglik"] == pytest.approx(r["loglik"], abs=1e-3)
    assert profiles[0].keys() == profiles[1].keys() and len(profiles[0]) == 4
    assert all(profiles[0][k] == pytest.approx(v, abs=1e-2) for k, v in profiles[1].items())
    assert estimate.hawkes_fit(events.limit(0), 20.0, 2).count() == 0


def test_bootstrap_covers_and_suppresses(spark):
    rng = np.random.default_rng(0)
    rows = [("a", i, float(x)) for i, x in enumerate(rng.normal(0.05, 1, 400))] + [("few", i, float(i)) for i in range(10)]
    out = {r["key"]: r for r in bootstrap.sharpe_ci(spark.createDataFrame(rows, "asset string, fecha int, r double"), replicas=99).collect()}
    assert out["a"]["low"] < out["a"]["sharpe"] < out["a"]["high"] and out["few"]["low"] is None
    index = bootstrap.resample_index(1000, 20.0, rng)
    assert 0 <= index.min() and index.max() < 1000 and 30 < (np.diff(index) % 1000 != 1).sum() < 75


def test_snapshots(spark, tmp_path):
    art = lambda u, t, seen="20240102T030405Z": {"url": u, "title": t, "seendate": seen, "domain": "d", "sourcecountry": "US"}
    for day, articles in (("2024-01-02", [art("a", "first"), art("b", ""), art("c", "x", "bad")]), ("2024-01-01", [art("a", "earlier day"), art("d", "ok")])):
        (tmp_path / f"{day}.json").write_text(json.dumps({"day": day, "cap_hit_any": False, "segments": [{"start": "", "end": "", "n": 1, "cap_hit": True, "articles": articles}]}))
    (tmp_path / "_state.json").write_text("{}")
    out = {r["url"]: r for r in snapshots.read_headlines(spark, str(tmp_path)).collect()}
    assert set(out) == {"a", "d"} and out["a"]["title"] == "earlier day" and out["a"]["seen_at"] == datetime(2024, 1, 2, 3, 4, 5) and out["a"]["cap_hit_segment"]


def test_calendar_snapshots(spark, tmp_path):
    event = lambda **x: {"country": "US", "event": "CPI YoY", "date": "2024-01-11 13:30:00", **x}
    (tmp_path / "1.json").write_text(json.dumps({"captured_at": "2024-01-10", "data": [event(estimate="3.2%"), event(country="DE", estimate="9")]}))
    (tmp_path / "2.json").write_text(json.dumps({"captured_at": "2024-01-12", "result": [event(estimate="3.9%", actual="3.4%")]}))
    r = snapshots.read_calendar(spark, str(tmp_path), [("CPI", "cpi")]).collect()
    assert len(r) == 1 and (r[0]["consensus"], r[0]["actual"], r[0]["captured_at"]) == (3.2, 3.4, "2024-01-10")


def test_repaired_escapes():
    for bad in (r'{"a": "x\d"}', r'{"a": "ok \\ \n A"}', r'{"a": "\u12"}', '{"a": "end\\'):
        fixed = snapshots.repair_escapes(bad)
        if fixed.endswith("}"):
            json.loads(fixed)
    assert json.loads(snapshots.repair_escapes(r'{"a": "\\d"}'))["a"] == r"\d"


def fetch(window, page, size, query):
    """A service of 25 rows per window."""
    return [{"asset": query["asset"], "n": window * 100 + i} for i in range(page * size, min(25, (page + 1) * size))]


def test_paged_source(spark):
    spark.dataSource.register(snapshots.PagedSource)
    df = (spark.read.format("ledgerline_paged").option("columns", "asset string, n int").option("fetch", "tests.test_engine:fetch").option("windows", "3").option("pagesize", "10").option("query", '{"asset": "X"}').load())
    assert df.count() == 75 and df.agg({"n": "max"}).first()[0] == 224


def test_streams(spark, tmp_path):
    jobs.use_state_store(spark)
    for k, rows in enumerate(([("k", 0.0, 1.0), ("k", 0.5, 0.5)], [("k", 0.25, 1.0), ("k", 1.0, 0.2)])):
        spark.createDataFrame(rows, "key string, t double, s double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    got = []
    stream = spark.readStream.schema("key string, t double, s double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = jobs.decay_state(stream, 2.0).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
    query.awaitTermination()
    want = sum(s * np.exp(-2.0 * (1.0 - t)) for t, s in ((0.0, 1.0), (0.5, 0.5), (0.25, 1.0), (1.0, 0.2)))
    assert {r["t"]: r["a"] for r in got}[1.0] == pytest.approx(want)


def test_stream_keeps_the_earliest_capture(spark, tmp_path):
    jobs.use_state_store(spark)
    schema = "indicator string, captured_at double, actual double, consensus double"
    for k, rows in enumerate(([("CPI", 2.0, None, 3.0)], [("CPI", 3.0, 9.0, 8.0), ("CPI", 1.0, None, 2.5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    got = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    jobs.first_non_null_state(stream, ["indicator"], ["actual", "consensus"]).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()
    assert (got[-1]["actual"], got[-1]["consensus"]) == (9.0, 2.5)


def payload():
    return {"version": 1, "run_id": publish.run_id("c", "d", 1, 1), "asof": "2024-01-05", "generated": "2024-01-06T00:00:00Z", "model": "m", "n_starts": 20, "n_converged": 12,
            "regimes": [{"label": "low", "probability": 0.75, "expected_days": publish.expected_days(0.9), "n_obs": 10}, {"label": "high", "probability": 0.25, "expected_days": 2.0, "n_obs": 5}]}


def test_publishing_gate(tmp_path):
    assert publish.publish(payload(), str(tmp_path / "run")).exists()
    for change in ({"extra": 1}, {"asof": "2023-12-01"}, {"asof": "2024-02-01"}, {"n_starts": "20"}, {"regimes": payload()["regimes"][:1]}):
        with pytest.raises(ValueError, match="contract"):
            publish.publish(payload() | change, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="forbidden"):
        publish.publish(payload() | {"xi_smoothed": 1, "extra": 2}, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="finite"):
        bad = payload()
        bad["regimes"][0]["expected_days"] = float("nan")
        publish.publish(bad, str(tmp_path / "bad"))


def test_promotion_is_all_or_nothing(tmp_path):
    run, latest = tmp_path / "run", tmp_path / "latest"
    publish.publish(payload(), str(run))
    publish.write_manifest(str(run), "r", 1)
    publish.promote(str(run), str(latest))
    assert publish.verify_manifest(str(latest)) == []
    (run / "payload.json").write_text("changed")
    with pytest.raises(ValueError, match="manifest"):
        publish.promote(str(run), str(latest))
    assert publish.verify_manifest(str(latest)) == []


def test_asof_macro_takes_every_series(spark, tmp_path):
    import pandas as pd

    from ledgerline.plans import registry

    from .oracle import assert_equal

    n = 1200
    days = [datetime(1997, 1, 1), datetime(1997, 2, 3)]
    pd.DataFrame([(k, days[k], 10.0 + k) for k in (0, 1)], columns=["o_orderkey", "o_orderdate", "o_totalprice"]).to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    lines = [(k % 2, k, f"s{k:05}", float(k), datetime(1997, 3, 1)) for k in range(n)]
    pd.DataFrame(lines, columns=["l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_shipdate"]).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    frame = registry.queries()["asof_backward_macro"](spark, str(tmp_path)).toPandas()
    assert len(frame) == 2 * n and frame["series_id"].nunique() == n
    assert_equal(frame, registry.oracle_sql()["asof_backward_macro"], str(tmp_path))


def test_walk_forward_scores_test_rows(spark, tmp_path):
    import pandas as pd

    from ledgerline.plans import registry

    g = np.random.default_rng(4)
    days = pd.date_range("1995-01-01", periods=1150, freq="D")
    price = 1000 * np.exp(np.cumsum(g.normal(0, 0.01, len(days))))
    pd.DataFrame({"o_orderdate": days, "o_totalprice": price}).to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    rows = registry.queries()["walk_forward"](spark, str(tmp_path)).collect()
    close = np.round(price, 2)
    r, dates = 100 * np.diff(np.log(close)), days[1:]
    assert len(rows) == 2 and sorted(x["series"] for x in rows) == ["0", "1"]
    for x in rows:
        start, test, end = (pd.Timestamp(d) for d in (("1995-01-02", "1997-01-02", "1997-07-02") if x["series"] == "0" else ("1995-07-02", "1997-07-02", "1998-01-02")))
        inside, train = r[(dates >= start) & (dates < end)], r[(dates >= start) & (dates < test)]
        whole, first = (-estimate.negative_loglik(np.array(x["theta"]), y, estimate.Shape(2))[0] for y in (inside, train))
        assert x["n"] == len(train) and x["n_test"] == len(inside) - len(train) and x["test_loglik"] == pytest.approx(whole - first, abs=1e-6)


def test_fits_of_many_series_are_many_tasks(spark):
    """A few starts of many series do not share a task or two."""
    r, _ = estimate.simulate(FIXED, 200, 3)
    df = spark.createDataFrame([(f"s{k}", i, float(v)) for k in range(16) for i, v in enumerate(r)], "asset string, fecha int, r double")
    assert estimate.fit_starts(df, estimate.Shape(1), starts=1, rounds=1).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
