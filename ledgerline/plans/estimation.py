"""Queries on estimation, resampling and audits. SQL cannot express them; tests hold them against recovery and brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, bootstrap, committed, decay_fit, estimate, hawkes_errors, powerlaw, prefix, rolling, walkforward
from ..operators import calibration as cal
from ..sources import tables as src

TWO = estimate.Shape(2)
QUERIES: dict = {}
SQL: dict[str, str] = {}
WALK = ["series", "k", "n", "loglik", "n_starts", "n_converged", "n_stopped_by_rule", "theta"]


def query(f):
    """Registers a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


def _returns(spark: SparkSession, d: str, by_asset: bool = False) -> DataFrame:
    return rolling.log_returns(src.daily_close(spark, d, by_asset)).select("asset", "fecha", "r")


@query
def fit_msgarch(spark: SparkSession, d: str) -> DataFrame:
    """Two regimes fitted to all daily returns from 20 starts, to tolerance (or 200 rounds; n_stopped_by_rule tells how many got there)."""
    return estimate.best_fit(estimate.fit_starts(_returns(spark, d), TWO, rounds=200))


@query
def parameter_errors(spark: SparkSession, d: str) -> DataFrame:
    """Natural parameters of the two-regime fit with delta-method standard errors."""
    r = _returns(spark, d)
    return estimate.parameter_table(r, estimate.best_fit(estimate.fit_starts(r, TWO, starts=8, rounds=150)), TWO)


@query
def bic_table(spark: SparkSession, d: str) -> DataFrame:
    """BIC of one and two regimes with normal and Student's t shocks, and which is best."""
    from functools import reduce

    r = _returns(spark, d)
    specs = [(k, t) for k in (1, 2) for t in (False, True)]
    fits = [estimate.best_fit(estimate.fit_starts(r, estimate.Shape(k, t), starts=8, rounds=120)).withColumn("dist", F.lit("t" if t else "normal")) for k, t in specs]
    every = reduce(lambda a, b: a.unionByName(b), fits)
    w = Window.partitionBy("series").orderBy("bic", "k", "dist")
    return every.select("series", "k", "dist", "n", "loglik", "bic", "aic", "n_starts", "n_converged", "n_stopped_by_rule").withColumn("best", F.row_number().over(w) == 1)


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    """Daily returns by block and part: two years of train, half a year of test."""
    r = src.materialise(_returns(spark, d), "returns")  # a row a day; the orders are read once
    first, last = r.agg(F.min("fecha"), F.max("fecha")).first()
    blocks = walkforward.windows(first, last, train_years=2, least=0) if first else []
    return walkforward.assign(r, walkforward.windows_frame(spark, blocks)).withColumn("block", F.col("block_id").cast("string"))


@query
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Two regimes re-fitted from scratch on each block's train rows, a commit a block; log likelihood there, and of the test rows that follow."""
    assigned = _assigned(spark, d)
    rows, fits = committed.walk_forward(assigned, src.shared_path(spark, "walk"), TWO, starts=8, rounds=120)
    sums = rows.groupBy(F.col("block").alias("series")).agg(F.count("*").cast("int").alias("n_test"), F.sum("loglik").alias("test_loglik"))
    return fits.select(*WALK).join(sums, "series")


@query
def walk_forward_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every block's test rows under its own fit: predicted and filtered probabilities, log likelihood, predicted mean."""
    return committed.walk_forward(_assigned(spark, d), src.shared_path(spark, "walk"), TWO, starts=8, rounds=120)[0]


@query
def walk_forward_driven(spark: SparkSession, d: str) -> DataFrame:
    """Transitions driven by yesterday's return, scaled on each block's train rows, the slopes' penalty chosen there: fit, penalty, scaler and test likelihood a block."""
    rows = _returns(spark, d).withColumn("x", F.coalesce(F.lag("r").over(rolling.series()), F.lit(0.0)))
    assigned = _assigned(spark, d).join(rows.select("fecha", "x"), "fecha")
    out, fits = committed.walk_forward(assigned, src.shared_path(spark, "walk"), estimate.Shape(2, slopes=True), starts=4, rounds=100, covariate="x", penalties=[0.0, 10.0], cv_starts=2)
    sums = out.groupBy(F.col("block").alias("series")).agg(F.count("*").cast("int").alias("n_test"), F.sum("loglik").alias("test_loglik"))
    return fits.select(*WALK, "penalty", "scaler_mean", "scaler_std").join(sums, "series")


@query
def slope_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Penalty of the slopes on yesterday's return, by temporal cross-validation."""
    r = _returns(spark, d).withColumn("x", F.coalesce(F.lag("r").over(rolling.series()), F.lit(0.0)) / 50)
    return estimate.choose_penalty(r, estimate.Shape(2, slopes=True), [0.0, 1.0, 10.0], "x", starts=4, rounds=100)


@query
def slope_signs(spark: SparkSession, d: str) -> DataFrame:
    """Slopes on yesterday's return with errors, effect on the last regime and agreement with a prior."""
    shape = estimate.Shape(2, slopes=True)
    r = _returns(spark, d).withColumn("x", F.coalesce(F.lag("r").over(rolling.series()), F.lit(0.0)) / 50)
    table = estimate.parameter_table(r, estimate.best_fit(estimate.fit_starts(r, shape, starts=8, rounds=150, covariate="x")), shape, covariate="x")
    slopes = table.where("parameter like 'B%'").select("series", F.lit("x").alias("covariate"), F.substring("parameter", 3, 1).cast("int").alias("origin"), F.substring("parameter", 4, 1).cast("int").alias("target"), F.col("estimate").alias("beta"), "se")
    return audit.slope_signs(slopes, {"x": "-"})


@query
def surprise_decay(spark: SparkSession, d: str) -> DataFrame:
    """Profile likelihood of the half-life of release surprises (by shipping date) as a driver of the regimes."""
    v = src.one_per_vintage(src.vintages(spark, d)).groupBy(F.col("realtime_start").alias("day")).agg(((F.avg("value") - 38_000) / 10_000).alias("c"))
    return estimate.fit_decay(_returns(spark, d), v, [5.0, 20.0, 80.0], estimate.Shape(2, slopes=True), starts=4, rounds=100)


@query
def surprise_half_life(spark: SparkSession, d: str) -> DataFrame:
    """The half-life of release surprises fitted with the regimes' model, with its error and interval."""
    v = src.one_per_vintage(src.vintages(spark, d)).groupBy(F.col("realtime_start").alias("day")).agg(((F.avg("value") - 38_000) / 10_000).alias("c"))
    return decay_fit.fit_half_life(_returns(spark, d), v, starts=8, rounds=60)


@query
def block_reestimation(spark: SparkSession, d: str) -> DataFrame:
    """Per block, refitted with one regime: least L-infinity distance of its parameters to any other block's, and whether it is re-estimated. No rows without two blocks."""
    rows = _assigned(spark, d).where("part = 'train'")
    fits = estimate.best_fit(estimate.fit_starts(rows, estimate.Shape(1), starts=4, rounds=120, key="block")).select(F.col("series").cast("int").alias("block"), "theta")
    others = fits.select(F.col("block").alias("other"), F.col("theta").alias("theta_other"))  # some ten blocks
    pairs = fits.join(F.broadcast(others), F.col("block") != F.col("other"))
    gap = F.array_max(F.zip_with("theta", "theta_other", lambda a, b: F.abs(a - b)))
    return pairs.groupBy("block").agg(F.min(gap).alias("least")).withColumn("passed", F.col("least") > 1e-8)


@query
def hawkes_mle(spark: SparkSession, d: str) -> DataFrame:
    """Exponential kernel fitted to each event type."""
    return estimate.hawkes_fit(src.point_process(spark, d), 31.0, starts=4, rounds=100)


@query
def hawkes_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Each event type's branching ratio with standard errors by curvature and the likelihood-ratio interval."""
    e = src.point_process(spark, d)
    fits = src.materialise(estimate.hawkes_fit(e, 31.0, starts=4, rounds=100), "hawkes")
    return fits.select("key", "mu", "alpha", "beta", "loglik", "converged").join(hawkes_errors.hawkes_intervals(e, 31.0, fits), "key")


@query
def dithering_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Each event type's branching ratio under five ditherings of 15-minute bins and four starts each, pooled over the ditherings."""
    e = src.point_process(spark, d)
    bins = e.withColumn("t", F.floor(F.col("t") * 96) / 96)
    return hawkes_errors.dither_sweep(bins, 1 / 96, 31.0)


@query
def sharpe_ci(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of each asset's Sharpe ratio."""
    return bootstrap.sharpe_ci(_returns(spark, d, by_asset=True), replicas=199)


@query
def optimal_block_length(spark: SparkSession, d: str) -> DataFrame:
    """Automatic block length of each asset's returns."""
    return bootstrap.sharpe_ci(_returns(spark, d, by_asset=True), replicas=10).select("key", "n", "block")


@query
def powerlaw_mle(spark: SparkSession, d: str) -> DataFrame:
    """Power-law kernel fitted to all events of each type from eight starts, to tolerance, with standard errors and AIC."""
    return powerlaw.power_law_fit(src.point_process(spark, d), 31.0)


@query
def kernel_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The exponential and the power-law kernel fitted to each event type on one window: AIC, rescaled waiting times, which is preferred."""
    return powerlaw.compare_kernels(src.point_process(spark, d), 31.0)


@query
def garchx_fit(spark: SparkSession, d: str) -> DataFrame:
    """GARCH with yesterday's absolute return as driver, fitted to each asset, with standard errors; theta is the driver's weight."""
    import numpy as np

    r = _returns(spark, d, by_asset=True).withColumn("x", F.abs(F.coalesce(F.lag("r").over(rolling.series()), F.lit(0.0))))
    begin = lambda g, r, x: np.array([r.mean(), np.log(r.var() * 0.1), 2.0 + g.normal() * 0.3, -2.0, -1.0])
    fits = estimate.grid_fit(r, ["r", "x"], estimate.garchx_negative_loglik, begin, ["mu", "log_omega", "logit_persistence", "logit_share", "log_theta"], 6, rounds=120, key="asset", order="fecha")
    theta = F.exp("log_theta")
    return fits.withColumns({"theta": theta, "se_theta": theta * F.col("se_log_theta")})


@query
def bootstrap_lr(spark: SparkSession, d: str) -> DataFrame:
    """Two regimes against one on all daily returns, by parametric bootstrap: 49 replicas."""
    return estimate.bootstrap_lr(_returns(spark, d), replicas=49, starts=2, rounds=60)


@query
def branching_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile likelihood of each event type's branching ratio."""
    e = src.point_process(spark, d)
    return estimate.profile_branching(e, 31.0, src.materialise(estimate.hawkes_fit(e, 31.0, starts=4, rounds=100), "hawkes"), [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


@query
def ablation_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Rungs fitted per block and compared on its test rows: one regime, two, two with t shocks, two driven by yesterday's return; neighbours by Diebold-Mariano."""
    from functools import reduce

    rows = src.materialise(_assigned(spark, d), "ladder")  # the days, read by every rung
    rows = rows.withColumn("x", F.coalesce(F.lag("r").over(Window.partitionBy("block").orderBy("fecha")), F.lit(0.0)) / 50)
    specs = [("M0", estimate.Shape(1)), ("M1", TWO), ("M2", estimate.Shape(2, student=True)), ("M3", estimate.Shape(2, slopes=True))]
    losses = []
    for name, shape in specs:
        x = "x" if shape.slopes else None
        fits = estimate.best_fit(estimate.fit_starts(rows.where("part = 'train'"), shape, starts=4, rounds=100, key="block", covariate=x))
        losses.append(estimate.out_of_sample(rows, fits, shape, covariate=x).select("fecha", (-F.col("loglik")).alias(name)))
    wide = reduce(lambda a, b: a.join(b, "fecha"), losses).withColumn("asset", F.lit("ALL"))
    pairs = [(b, a) for a, b in zip([n for n, _ in specs], [n for n, _ in specs[1:]], strict=False)]
    rungs = [cal.diebold_mariano(wide, a, b).withColumns({"first": F.lit(a), "second": F.lit(b)}) for a, b in pairs]
    return reduce(lambda a, b: a.unionByName(b), rungs)


@query
def expanding_window_check(spark: SparkSession, d: str) -> DataFrame:
    """Expanding z scores of truncated calendars against the whole one's, at five cut-offs: no difference."""
    c = src.calendar(spark, d).withColumn("k", F.ntile(5).over(Window.partitionBy("indicator").orderBy("ts", "event_id")))
    whole = rolling.expanding_surprise_z(c).select("event_id", F.col("z").alias("z_all"))
    cut = c.withColumn("cut", F.explode(F.sequence("k", F.lit(5)))).withColumn("series", F.concat_ws("@", "indicator", "cut"))
    part = rolling.expanding_surprise_z(cut, key="series").select("event_id", "cut", "z")
    return part.join(whole, "event_id").groupBy("cut").agg(F.count("*").alias("n"), F.coalesce(F.max(F.abs(F.col("z") - F.col("z_all"))), F.lit(0.0)).alias("max_diff")).withColumn("passed", F.col("max_diff") < 1e-10)


@query
def rubin_by_dither(spark: SparkSession, d: str) -> DataFrame:
    """Mean waiting time per event type under five seeded ditherings of 15-minute bins, pooled."""
    e = src.table(spark, d, "events").select(F.col("event_type").alias("key"), "event_id", (F.floor(src.micros("ts") / 900_000_000) * 900.0).alias("bin"))
    seeds = e.withColumn("seed", F.explode(F.lit([1, 2, 3, 4, 5])))
    u = F.pmod(F.xxhash64("event_id", "seed"), F.lit(1_000_000)) / 1e6
    t = seeds.withColumn("t", F.col("bin") + u * 900)
    gap = prefix.scan(t, ["key", "seed"], ["t", "event_id"], lags={"_before": F.col("t")}).withColumn("gap", F.col("t") - F.col("_before"))
    rows = gap.groupBy("seed").agg(F.avg("gap").alias("estimate"), (F.var_samp("gap") / F.count("gap")).alias("variance"))
    return cal.rubin_pool(rows)
