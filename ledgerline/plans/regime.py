"""Queries on regime filters, calibration, forecast comparison and economics, with recursive SQL twins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import Params
from ..operators import calibration as cal, promotion, publish
from ..operators import economic, regimes, rolling, walkforward
from ..sources import tables as src
from .relational import DAILY, MULTI, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Fixed parameters of the registered filters, at the scale of the tables' daily returns.
FIXED = Params(mu=(0.5, -0.5), v=(600.0, 3000.0), alpha=(0.05, 0.08), gamma=(0.04, 0.06), beta=(0.85, 0.80), P=((0.95, 0.05), (0.10, 0.90)))
MOVING = Params(mu=FIXED.mu, v=FIXED.v, alpha=FIXED.alpha, gamma=FIXED.gamma, beta=FIXED.beta, P=FIXED.P, d=((2.9,), (-2.2,)), B=((-0.4,), (-0.3,)))
GARCHX = {"mu": 0.1, "omega": 40.0, "alpha": 0.06, "beta": 0.85, "theta": 2.0}
LN_2PI = 1.8378770664093453


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL if it has one."""
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql or ""
        return f
    return add


def _filter_sql(p: Params, moving: bool = False, daily: str = DAILY) -> str:
    """CTEs up to hist(asset, fecha, n, r, s0, s1, q0, q1, x0, x1, ll), one recursion step a day."""
    a = p.arrays()
    e = lambda k: f"(f.r - ({a['mu'][k]}))"
    var = lambda k: f"{a['omega'][k]} + ({a['alpha'][k]} + case when {e(k)} < 0 then {a['gamma'][k]} else 0 end) * {e(k)} * {e(k)} + {a['beta'][k]} * f.s{k}"
    p10 = 0.10 / 0.15
    stay = lambda i: f"1 / (1 + exp(-({p.d[i][0]} + ({p.B[i][0]}) * o.x)))" if moving else str(a["P"][i][0])
    lf = lambda k: f"-0.5 * ({LN_2PI} + ln(s{k}) + (r - ({a['mu'][k]})) * (r - ({a['mu'][k]})) / s{k})"
    update = lambda source: f"""select asset, fecha, n, r, s0, s1, q0, q1, q0 * exp(l0 - m) / den as x0, q1 * exp(l1 - m) / den as x1, ln(den) + m as ll from (
      select *, q0 * exp(l0 - m) + q1 * exp(l1 - m) as den from (select *, greatest(l0, l1) as m from (select *, {lf(0)} as l0, {lf(1)} as l1 from ({source}))))"""  # noqa: E731
    first = f"select asset, fecha, n, r, cast({a['v'][0]} as double) as s0, cast({a['v'][1]} as double) as s1, cast({p10!r} as double) as q0, cast({1 - p10!r} as double) as q1 from o where n = 1"
    then = f"""select o.asset, o.fecha, o.n, o.r, {var(0)} as s0, {var(1)} as s1, f.x0 * {stay(0)} + f.x1 * {stay(1)} as q0, f.x0 * (1 - {stay(0)}) + f.x1 * (1 - {stay(1)}) as q1
      from hist f join o on o.asset = f.asset and o.n = f.n + 1"""
    return f"""{daily},
o as (select asset, fecha, r, row_number() over (partition by asset order by fecha) as n, coalesce(lag(r) over (partition by asset order by fecha), 0) / 50 as x from ret),
hist as ({update(first)} union all {update(then)})"""


HIST = _filter_sql(FIXED)
HIST_MULTI = _filter_sql(FIXED, daily=MULTI)


def _history(spark: SparkSession, d: str, by_asset: bool = False, params: Params = FIXED, smoother: bool = False) -> DataFrame:
    returns = rolling.log_returns(src.daily_close(spark, d, by_asset))
    if params.B is not None:
        returns = returns.withColumn("x", F.coalesce(F.lag("r").over(rolling.series()), F.lit(0.0)) / 50)
        return regimes.hamilton_filter(returns, params, covariate="x", smoother=smoother)
    return regimes.hamilton_filter(returns, params, smoother=smoother)


_FILTER_OUT = "asset, cast(fecha as varchar) as fecha, round(r, 5) as r, round(q0, 6) as xi_p_0, round(q1, 6) as xi_p_1, round(x0, 6) as xi_f_0, round(x1, 6) as xi_f_1, round(ll, 6) as loglik"
_ENT = "(-(case when x0 > 0 then x0 * ln(x0) else 0 end) - (case when x1 > 0 then x1 * ln(x1) else 0 end))"


def _filter_out(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("r", F.round("r", 5)), "xi_p_0", "xi_p_1", "xi_f_0", "xi_f_1", "loglik").drop("s2_0", "s2_1")


@query(f"with recursive {HIST} select {_FILTER_OUT}, round({_ENT} / ln(2), 5) as entropy_norm, case when x1 > x0 then 1 else 0 end as argmax_idx from hist")
def hamilton_filter(spark: SparkSession, d: str) -> DataFrame:
    out = regimes.with_regime(_history(spark, d)).withColumn("entropy_norm", F.round("entropy_norm", 5)).drop("entropy")
    return _filter_out(out)


@query(f"with recursive {HIST_MULTI} select {_FILTER_OUT} from hist")
def hamilton_filter_by_asset(spark: SparkSession, d: str) -> DataFrame:
    return _filter_out(_history(spark, d, by_asset=True))


@query(f"with recursive {_filter_sql(MOVING, True)} select {_FILTER_OUT} from hist")
def hamilton_tvtp(spark: SparkSession, d: str) -> DataFrame:
    return _filter_out(_history(spark, d, params=MOVING))


@query(f"with recursive {HIST} select asset, cast(fecha as varchar) as fecha, round(s0, 4) as s2_0, round(s1, 4) as s2_1 from hist")
def garch_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_history(spark, d).select("asset", "fecha", "s2_0", "s2_1"), "s2_0", "s2_1", digits=4)


@query(f"with recursive {HIST} select asset, count(*) as n, round(sum(ll), 4) as loglik, round(avg(ll), 6) as per_obs from hist group by 1")
def predictive_loglik(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).groupBy("asset").agg(F.count("*").alias("n"), F.round(F.sum("loglik"), 4).alias("loglik"), F.round(F.avg("loglik"), 6).alias("per_obs"))


_P = FIXED.P


@query(f"""with recursive {HIST}, top as (select asset, max(n) as n from hist group by 1),
sm as (select h.asset, h.fecha, h.n, h.x0 as z0, h.x1 as z1 from hist h join top t on h.asset = t.asset and h.n = t.n
  union all select h.asset, h.fecha, h.n, h.x0 * ({_P[0][0]} * s.z0 / g.q0 + {_P[0][1]} * s.z1 / g.q1), h.x1 * ({_P[1][0]} * s.z0 / g.q0 + {_P[1][1]} * s.z1 / g.q1)
  from sm s join hist g on g.asset = s.asset and g.n = s.n join hist h on h.asset = s.asset and h.n = s.n - 1)
select asset, cast(fecha as varchar) as fecha, round(z0, 6) as diag_smooth_0, round(z1, 6) as diag_smooth_1 from sm""")
def kim_smoother_diag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_history(spark, d, smoother=True).select("asset", "fecha", "diag_smooth_0", "diag_smooth_1"), "diag_smooth_0", "diag_smooth_1")


@query(f"""with recursive {DAILY}, o as (select asset, fecha, r, row_number() over (partition by asset order by fecha) as n, abs(coalesce(lag(r) over (partition by asset order by fecha), 0)) as x from ret),
g as (select asset, fecha, n, r, ({GARCHX['omega']} + {GARCHX['theta']} * (select avg(x) from o)) / (1 - {GARCHX['alpha']} - {GARCHX['beta']}) as s2 from o where n = 1
  union all select o.asset, o.fecha, o.n, o.r, greatest({GARCHX['omega']} + {GARCHX['alpha']} * (g.r - {GARCHX['mu']}) * (g.r - {GARCHX['mu']}) + {GARCHX['beta']} * g.s2 + {GARCHX['theta']} * o.x, 1e-12) from g join o on o.asset = g.asset and o.n = g.n + 1)
select asset, cast(fecha as varchar) as fecha, round(s2, 4) as s2, round(-0.5 * ({LN_2PI} + ln(s2) + (r - {GARCHX['mu']}) * (r - {GARCHX['mu']}) / s2), 6) as loglik from g""")
def garchx_variance(spark: SparkSession, d: str) -> DataFrame:
    returns = rolling.log_returns(src.daily_close(spark, d)).withColumn("x", F.abs(F.coalesce(F.lag("r").over(rolling.series()), F.lit(0.0))))
    return rounded(regimes.garchx(returns, "x", GARCHX).withColumn("s2", F.round("s2", 4)).drop("r"), "loglik")


@query(f"with recursive {HIST} select asset, cast(fecha as varchar) as fecha, round(coalesce(x1 - lag(x1, 5) over (partition by asset order by fecha), 0), 6) as momentum from hist")
def regime_momentum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(economic.momentum(_history(spark, d), "xi_f_1").select("asset", "fecha", "momentum"), "momentum")


@query(f"""with recursive {HIST}, s as (select *, case when x1 > x0 then 1 else 0 end as argmax_idx from hist), c as (select *, case when argmax_idx is distinct from lag(argmax_idx) over (partition by asset order by fecha) then 1 else 0 end as ch from s),
g as (select *, sum(ch) over (partition by asset order by fecha rows unbounded preceding) as run_id from c)
select asset, cast(run_id as bigint) as run_id, argmax_idx, cast(min(fecha) as varchar) as first, cast(max(fecha) as varchar) as last, count(*) as n from g group by 1, 2, 3""")
def regime_runs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rolling.runs(regimes.with_regime(_history(spark, d)), "argmax_idx"))


@query(f"with {DAILY}, b as (select asset, fecha, year(fecha) as block_id from ret) select asset, cast(fecha as varchar) as fecha, block_id, block_id is distinct from lag(block_id) over (partition by asset order by fecha) as is_boundary from b")
def block_boundaries(spark: SparkSession, d: str) -> DataFrame:
    r = rolling.log_returns(src.daily_close(spark, d)).select("asset", "fecha", F.year("fecha").cast("bigint").alias("block_id"))
    return rounded(rolling.boundaries(r, "block_id"))


@query(f"""with recursive {HIST} select asset, case when x1 > x0 then 1 else 0 end as argmax_idx, count(*) as n_obs, round(avg(r) * 252, 4) as ann_mean, round(stddev_samp(r) * sqrt(252), 4) as ann_vol, round(avg(r) * 252 / nullif(stddev_samp(r) * sqrt(252), 0), 5) as sharpe from hist group by 1, 2""")
def conditional_stats(spark: SparkSession, d: str) -> DataFrame:
    s = rolling.annualised(F.col("r"))
    return regimes.with_regime(_history(spark, d)).groupBy("asset", "argmax_idx").agg(F.count("*").alias("n_obs"), F.round(s["ann_mean"], 4).alias("ann_mean"), F.round(s["ann_vol"], 4).alias("ann_vol"), F.round(s["sharpe"], 5).alias("sharpe"))


_PY = f"{HIST}, py as (select *, q1 as p, case when x1 > x0 then 1 else 0 end as y from hist)"


@query(f"""with recursive {_PY}, s as (select count(*) as n, avg(2 * (p - y) * (p - y)) as brier, avg(-ln(greatest(case when y = 1 then p else 1 - p end, 1e-15))) as logloss, avg(cast(y as double)) as f from py)
select n, round(brier, 6) as brier, round(logloss, 6) as logloss, round(2 * f * (1 - f), 6) as brier_base, round(-(f * ln(greatest(f, 1e-15)) + (1 - f) * ln(greatest(1 - f, 1e-15))), 6) as logloss_base from s""")
def brier_logloss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.brier_logloss(_history(spark, d)), "brier", "logloss", "brier_base", "logloss_base")


_REL = f"{_PY}, rel as (select least(cast(floor(p * 10) as integer), 9) as bin, count(*) as n, avg(p) as mean_p, avg(cast(y as double)) as observed from py group by 1)"
_EDGES = [0.0, *cal.bin_edges(10), 1.0]
_TOP = f"""{HIST}, tl as (select greatest(q0, q1) as c, case when (q1 > q0) = (x1 > x0) then 1.0 else 0.0 end as hit from hist),
edges(bin, bin_lo, bin_hi) as (values {", ".join(f"({i}, cast({_EDGES[i]!r} as double), cast({_EDGES[i + 1]!r} as double))" for i in range(10))}),
rl as (select bin, bin_lo, bin_hi, count(c) as n, avg(c) as mean_confidence, avg(hit) as accuracy from edges left join tl on c >= bin_lo and (c < bin_hi or bin = 9) group by 1, 2, 3)"""


@query(f"with recursive {_TOP} select cast(bin as integer) as bin, round(bin_lo, 6) as bin_lo, round(bin_hi, 6) as bin_hi, n, round(mean_confidence, 6) as mean_confidence, round(accuracy, 6) as accuracy from rl")
def reliability_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.top_label_reliability(cal.top_label(_history(spark, d))), "bin_lo", "bin_hi", "mean_confidence", "accuracy")


@query(f"with recursive {_TOP} select round(sum(n * abs(mean_confidence - accuracy)) / sum(n), 6) as ece from rl where n > 0")
def ece(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.top_label_error(cal.top_label(_history(spark, d))), "ece")


@query(f"with recursive {_REL}, f as (select avg(cast(y as double)) as f from py) select round(sum(n * (mean_p - observed) ** 2) / sum(n), 6) as reliability, round(sum(n * (observed - f) ** 2) / sum(n), 6) as resolution, round(max(f * (1 - f)), 6) as uncertainty from rel, f")
def murphy_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.murphy(cal.two_class(_history(spark, d))), "reliability", "resolution", "uncertainty")


@query(f"with recursive {_PY}, k as (select y, row_number() over (order by p, fecha) as rk from py) select round((sum(rk) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) as auc from k")
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.auc(cal.two_class(_history(spark, d)), "fecha"), "auc")


@query(f"""with {DAILY}, e as (select asset, r - avg(r) over (partition by asset) as e, row_number() over (partition by asset order by fecha) as n from ret), c as (select asset, count(*) as t from ret group by 1)
select e.asset, cast(l.lag as integer) as lag, round(sum(e.e * b.e) / max(c.t), 4) as gamma from e cross join (select unnest(range(11)) as lag) l join e b on b.asset = e.asset and b.n = e.n - l.lag join c on c.asset = e.asset group by 1, 2""")
def autocovariance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.autocovariance(rolling.log_returns(src.daily_close(spark, d)), "r", 10), "gamma", digits=4)


_DM = _filter_sql(MOVING, True).replace("hist", "histb").split(",\no as")[1]


@query(f"""with recursive {HIST}, o2 as{_DM.replace('from o where', 'from o2 where').replace('join o on o.', 'join o2 o on o.')},
d as (select h.asset, h.n, -h.ll - -b.ll as d from hist h join histb b on h.asset = b.asset and h.n = b.n), t as (select asset, count(*) as t, avg(d) as m from d group by 1),
c as (select d.asset, d.n, d.d - t.m as e, t.t, t.m, cast(floor(1.5 * power(t.t, 1.0 / 3)) as integer) as k from d join t on d.asset = t.asset),
g as (select a.asset, l.lag, sum(a.e * b.e) / max(a.t) as gamma, max(a.k) as k, max(a.t) as t, max(a.m) as m from c a cross join (select unnest(range(60)) as lag) l join c b on b.asset = a.asset and b.n = a.n - l.lag where l.lag <= a.k group by 1, 2),
v as (select asset, any_value(t) as n, any_value(m) as mean_diff, sum(case when lag = 0 then gamma else 2 * (1 - cast(lag as double) / (k + 1)) * gamma end) as hac_var from g group by 1)
select asset, n, round(mean_diff, 7) as mean_diff, round(hac_var, 6) as hac_var, round(mean_diff / sqrt(hac_var / n) * sqrt((n + 1 - 2) / cast(n as double)), 5) as stat from v""")
def diebold_mariano(spark: SparkSession, d: str) -> DataFrame:
    a = _history(spark, d).select("asset", "fecha", (-F.col("loglik")).alias("a"))
    b = _history(spark, d, params=MOVING).select("asset", "fecha", (-F.col("loglik")).alias("b"))
    out = cal.diebold_mariano(a.join(b, ["asset", "fecha"]), "a", "b")
    return rounded(out.withColumns({"mean_diff": F.round("mean_diff", 7), "stat": F.round("stat", 5)}), "hac_var")


@query(f"""with recursive {HIST}, s as (select count(*) as n, avg(case when (r > 0) = (q0 * 0.5 - q1 * 0.5 > 0) then 1.0 else 0.0 end) as hit, avg(case when r > 0 then 1.0 else 0.0 end) as py, avg(case when q0 * 0.5 - q1 * 0.5 > 0 then 1.0 else 0.0 end) as px from hist),
e as (select *, py * px + (1 - py) * (1 - px) as star from s),
v as (select *, star * (1 - star) / n as vh, ((2 * py - 1) ** 2 * px * (1 - px) + (2 * px - 1) ** 2 * py * (1 - py)) / n + 4 * py * px * (1 - py) * (1 - px) / (cast(n as double) * n) as vs from e)
select n, round(hit, 6) as hit, round(star, 6) as expected, round(case when vh - vs > 1e-15 then (hit - star) / sqrt(vh - vs) end, 5) as stat from v""")
def pesaran_timmermann(spark: SparkSession, d: str) -> DataFrame:
    h = _history(spark, d).withColumn("mean", F.col("xi_p_0") * FIXED.mu[0] + F.col("xi_p_1") * FIXED.mu[1])
    return rounded(cal.pesaran_timmermann(h, "r", "mean").withColumn("stat", F.round("stat", 5)), "hit", "expected")


_STRAT = f"""{HIST}, w as (select *, case when coalesce(lag(x1) over (partition by asset order by fecha), 0) <= 0.5 then 1.0 else 0.0 end as w from hist),
st as (select *, abs(w - coalesce(lag(w) over (partition by asset order by fecha), 1)) as turnover from w), strat as (select *, w * r - turnover * 2 * 0.01 as r_strategy from st)"""
_ECON = "count(*) as n, round(avg(r_strategy) * 252 / nullif(stddev_samp(r_strategy) * sqrt(252), 0), 5) as sharpe_rule, round(avg(r) * 252 / nullif(stddev_samp(r) * sqrt(252), 0), 5) as sharpe_hold, round(avg(w), 6) as exposure, count(*) filter (where turnover > 0) as n_changes"


def _strategy(spark: SparkSession, d: str) -> DataFrame:
    return economic.derisk(_history(spark, d), "xi_f_1")


def _econ(df: DataFrame) -> DataFrame:
    return df.withColumns({"sharpe_rule": F.round("sharpe_rule", 5), "sharpe_hold": F.round("sharpe_hold", 5), "exposure": F.round("exposure", 6)})


@query(f"with recursive {_STRAT} select asset, cast(fecha as varchar) as fecha, cast(w as double) as w, cast(turnover as double) as turnover, round(r_strategy, 5) as r_strategy from strat")
def derisk_strategy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_strategy(spark, d).select("asset", "fecha", "w", "turnover", "r_strategy"), "r_strategy", digits=5)


@query(f"with recursive {_STRAT} select asset, {_ECON} from strat group by 1")
def economic_summary(spark: SparkSession, d: str) -> DataFrame:
    return _econ(economic.summary(_strategy(spark, d), ["asset"]))


@query(f"with recursive {_STRAT} select asset, year(fecha) as block_id, {_ECON} from strat group by 1, 2")
def economic_per_block(spark: SparkSession, d: str) -> DataFrame:
    return _econ(economic.summary(_strategy(spark, d).withColumn("block_id", F.year("fecha").cast("bigint")), ["asset", "block_id"]))


_BLOCKS = f"""{DAILY}, lim as (select min(fecha) as a, max(fecha) as b from ret),
blocks as (select 0 as block_id, a as train_start, cast(a + interval 2 year as date) as test_start, cast(a + interval 30 month as date) as test_end, b from lim
  union all select block_id + 1, cast(test_end - interval 2 year as date), test_end, cast(test_end + interval 6 month as date), b from blocks where cast(test_end + interval 6 month as date) <= b)"""


def _blocks(spark: SparkSession, returns: DataFrame) -> DataFrame:
    first, last = returns.agg(F.min("fecha"), F.max("fecha")).first()
    return walkforward.windows_frame(spark, walkforward.windows(first or date(2000, 1, 1), last or date(2000, 1, 1), train_years=2, least=0))


@query(f"with recursive {_BLOCKS} select block_id, cast(train_start as varchar) as train_start, cast(test_start as varchar) as test_start, cast(test_end as varchar) as test_end from blocks where test_end <= b")
def walkforward_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_blocks(spark, rolling.log_returns(src.daily_close(spark, d))))


@query(f"with recursive {_BLOCKS} select block_id, count(*) as n, round(avg(r), 6) as mean, round(stddev_samp(r), 6) as std from blocks join ret on fecha >= train_start and fecha < test_start where test_end <= b group by 1")
def train_scaler_by_block(spark: SparkSession, d: str) -> DataFrame:
    returns = rolling.log_returns(src.daily_close(spark, d))
    return rounded(walkforward.train_scaler(walkforward.assign(returns, _blocks(spark, returns)), "r"), "mean", "std")


@query("select cast(m as bigint) as m, round(pooled, 6) as pooled, round(within, 6) as within, round(between_, 6) as \"between\", round(within + (1 + 1.0 / m) * between_, 6) as total, round((1 + 1.0 / m) * between_ / within, 6) as relative_increase from (select count(*) as m, avg(e) as pooled, avg(v) as within, var_samp(e) as between_ from (select event_type, avg(value) as e, var_samp(value) / count(*) as v from events group by 1))")
def rubin_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = src.table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("estimate"), (F.var_samp("value") / F.count("*")).alias("variance"))
    return rounded(cal.rubin_pool(rows), "pooled", "within", "between", "total", "relative_increase")


@query(None)
def prefix_invariance(spark: SparkSession, d: str) -> DataFrame:
    """Largest difference between filtering a prefix and filtering all, for ten cut-offs: 0 up to rounding."""
    returns = rolling.log_returns(src.daily_close(spark, d)).withColumn("k", F.ntile(10).over(Window.partitionBy("asset").orderBy("fecha")))
    prefixes = returns.withColumn("cut", F.explode(F.sequence("k", F.lit(10)))).withColumn("series", F.concat_ws("@", "asset", F.lpad(F.col("cut").cast("string"), 2, "0")))
    part = regimes.hamilton_filter(prefixes, FIXED, key="series").select(F.split("series", "@").alias("s"), "fecha", F.col("xi_f_1").alias("cut_value"))
    part = part.select(F.col("s")[0].alias("asset"), F.col("s")[1].cast("int").alias("cut"), "fecha", "cut_value")
    whole = regimes.hamilton_filter(returns, FIXED).select("asset", "fecha", "xi_f_1")
    return part.join(whole, ["asset", "fecha"]).groupBy("asset", "cut").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("cut_value") - F.col("xi_f_1"))), 10).alias("max_diff")).withColumn("passed", F.col("max_diff") < 1e-10)


@query(f"with recursive {HIST} select asset, cast(fecha as varchar) as fecha, round(x0, 6) as xi_f_0, round(x1, 6) as xi_f_1 from hist")
def promoted_history(spark: SparkSession, d: str) -> DataFrame:
    """The filter's history written as a run's artifact, held against the contract, promoted, and read again through the pointer."""
    history = regimes.with_regime(_history(spark, d))
    art = promotion.Artifacts(spark, src.shared_path(spark, "artifacts"))
    days = history.agg(F.count("*").alias("n"), F.max("fecha").alias("last")).first()
    run = publish.run_id("fixed", "tables", 0, 1)
    head = {"version": "V1", "run_id": run, "asof": str(days["last"]), "generated_at": str(days["last"]), "n_starts": 20, "commit": run, "model": {"covariates": [], "moving": False}}
    art.write("first", {"history": history}, {"summary.json": head, "audit.json": {"run_id": run, "days": days["n"]}, "walkforward.json": {"blocks": 0}})
    art.promote("first", "query")
    kept = spark.read.parquet(f"{art.store.root}/runs/{art.latest()['run']}/history")
    return rounded(kept.select("asset", "fecha", "xi_f_0", "xi_f_1"), "xi_f_0", "xi_f_1")
