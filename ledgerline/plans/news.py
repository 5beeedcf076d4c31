"""Queries on surprises and point processes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import news, powerlaw, rolling
from ..sources import tables as src
from .relational import DAILY, SURPRISE, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}

MU, ALPHA, BETA, HORIZON, DECAY = 20.0, 150.0, 8.0, 31.0, 0.027725887222397813


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL if it has one."""
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql or ""
        return f
    return add


def _moves(spark: SparkSession, d: str) -> DataFrame:
    """z scores with the move of the indicator's next event."""
    z = rolling.expanding_surprise_z(src.calendar(spark, d))
    return z.withColumn("move", F.lead("actual").over(Window.partitionBy("indicator").orderBy("ts", "event_id")) - F.col("actual"))


_MOVES = f"{SURPRISE}, mv as (select *, lead(actual) over (partition by indicator order by ts, event_id) - actual as move from z)"
_WEIGHTS = f"""{_MOVES}, reg as (select indicator, count(*) as n, regr_sxx(abs(move), abs(z)) as sxx, regr_syy(abs(move), abs(z)) as syy, regr_sxy(abs(move), abs(z)) as sxy from mv where z is not null and move is not null group by 1),
wt as (select indicator, n, sxy / sxx as weight, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) as se from reg)"""


@query(f"with {_WEIGHTS} select indicator, n, round(weight, 6) as weight, round(se, 6) as se, round(weight / se, 5) as t, abs(weight / se) >= 2 as significant from wt")
def impact_weights_ols(spark: SparkSession, d: str) -> DataFrame:
    return rounded(news.impact_weights(_moves(spark, d)).withColumn("t", F.round("t", 5)), "weight", "se")


_EVENTS = f"{_WEIGHTS}, we as (select cast(ts as date) as day, sum(weight * z) as c from mv join wt on mv.indicator = wt.indicator where z is not null group by 1)"


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    moves = _moves(spark, d)
    return news.weighted_events(moves.withColumn("day", F.col("ts").cast("date")), news.impact_weights(moves))


@query(f"with {_EVENTS} select cast(day as varchar) as day, round(c, 5) as c from we")
def weighted_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_weighted(spark, d), "c", digits=5)


_INDEX = f"{_EVENTS}, days as (select cast(unnest(generate_series(min(day), cast(max(day) + interval 5 day as date), interval 1 day)) as date) as day from we), idx as (select d.day, coalesce(sum(c * exp(-{DECAY} * date_diff('day', we.day, d.day))), 0) as value from days d left join we on we.day <= d.day group by 1)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    events = _weighted(spark, d)
    days = events.agg(F.min("day").alias("a"), F.date_add(F.max("day"), 5).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return news.surprise_index(events, days, DECAY)


@query(f"with {_INDEX} select cast(day as varchar) as day, round(value, 5) as value from idx")
def surprise_index(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_index(spark, d), "value", digits=5)


@query(f"with {_INDEX} select cast(day as varchar) as day, round(lag(value) over (order by day), 5) as feature from idx")
def surprise_feature(spark: SparkSession, d: str) -> DataFrame:
    out = _index(spark, d).withColumn("feature", F.lag("value").over(Window.partitionBy(F.lit(0)).orderBy("day")))
    return rounded(out.select("day", "feature"), "feature", digits=5)


_EV = "ev as (select event_type as key, event_id, cast(epoch_us(ts) - epoch_us(timestamp '2024-01-01') as double) / 86400000000 as t, value / 1000 as s from events)"
_STATE = f"""{_EV}, st as (select *, coalesce(sum(s * exp({BETA} * t)) over (partition by key order by t, event_id rows between unbounded preceding and 1 preceding), 0) * exp(-{BETA} * t) as a,
  coalesce(sum(s) over (partition by key order by t, event_id rows between unbounded preceding and 1 preceding), 0) as before from ev),
hs as (select *, {MU} + {ALPHA} * a as intensity, {MU} * t + {ALPHA} / {BETA} * (before - a) as tau from st)"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    return news.hawkes_states(src.point_process(spark, d), MU, ALPHA, BETA)


@query(f"with {_STATE} select key, event_id, round(a, 6) as a from hs")
def hawkes_decay_state(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_states(spark, d).select("key", "event_id", "a"), "a")


@query(f"with {_STATE} select key, event_id, round(intensity, 5) as intensity from hs")
def hawkes_intensity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_states(spark, d).select("key", "event_id", "intensity"), "intensity", digits=5)


@query(f"with {_EV} select key, round({MU * HORIZON} + {ALPHA / BETA} * sum(s * (1 - exp(-{BETA} * ({HORIZON} - t)))), 4) as compensator from ev group by 1")
def hawkes_compensator(spark: SparkSession, d: str) -> DataFrame:
    return rounded(news.hawkes_compensator(src.point_process(spark, d), MU, ALPHA, BETA, HORIZON), "compensator", digits=4)


@query(f"with {_STATE} select key, count(*) as n, round(sum(ln(greatest(intensity, 1e-300))) - ({MU * HORIZON} + {ALPHA / BETA} * sum(s * (1 - exp(-{BETA} * ({HORIZON} - t))))), 3) as loglik from hs group by 1")
def hawkes_loglik(spark: SparkSession, d: str) -> DataFrame:
    return rounded(news.hawkes_loglik(src.point_process(spark, d), MU, ALPHA, BETA, HORIZON), "loglik", digits=3)


_GAPS = f"{_STATE}, gp as (select * from (select key, event_id, tau - lag(tau) over (partition by key order by t, event_id) as gap from hs) where gap is not null)"


@query(f"with {_GAPS} select key, event_id, round(gap, 6) as gap from gp")
def hawkes_rescaled_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(news.rescaled_gaps(_states(spark, d)).select("key", "event_id", "gap"), "gap")


@query(f"with {_GAPS}, rk as (select key, row_number() over (partition by key order by gap) as i, count(*) over (partition by key) as n, 1 - exp(-gap) as f from gp) select key, max(n) as n, round(max(greatest(cast(i as double) / n - f, f - (cast(i as double) - 1) / n)), 6) as d from rk group by 1")
def hawkes_ks_stat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(news.ks_exponential(news.rescaled_gaps(_states(spark, d))).drop("p"), "d")


@query(f"""with {_GAPS}, rk as (select key, row_number() over (partition by key order by gap) as i, count(*) over (partition by key) as n, 1 - exp(-gap) as f from gp),
k as (select key, max(n) as n, max(greatest(cast(i as double) / n - f, f - (cast(i as double) - 1) / n)) as d from rk group by 1)
select key, round(case when n * d * d < 0.04 then 1.0 else least(1.0, greatest(0.0, (select sum(case when j % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * j * j * n * d * d)) from (select unnest(range(1, 101)) as j)))) end, 6) as p from k""")
def hawkes_ks_p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(news.ks_exponential(news.rescaled_gaps(_states(spark, d))).select("key", "p"), "p")


@query(f"""with {_EV}, g as (select key, cast(h as double) / 4 as t from (select distinct key from ev), (select unnest(range(125)) as h))
select g.key, g.t, round({MU} + {ALPHA} * coalesce(sum(s * exp(-{BETA} * (g.t - ev.t))), 0), 5) as lam from g left join ev on ev.key = g.key and ev.t < g.t group by 1, 2""")
def hawkes_lambda_grid(spark: SparkSession, d: str) -> DataFrame:
    e = src.point_process(spark, d)
    grid = e.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(124))).alias("h")).select("key", (F.col("h") / 4).alias("t"))
    return rounded(news.lambda_on_grid(e, grid, MU, ALPHA, BETA, inclusive=False), "lam", digits=5)


_LAM = f"""{_EV}, b as (select key, floor(min(t)) as lo, floor(max(t)) as hi from ev group by 1), g as (select key, cast(d as bigint) as day_no, d >= lo and d <= hi as covered from b cross join (select unnest(range(32)) as d)),
lam as (select g.key, g.day_no, case when any_value(covered) then {MU} + {ALPHA} * coalesce(sum(s * exp(-{BETA} * (g.day_no + 1 - t))), 0) end as lam from g left join ev on ev.key = g.key and ev.t <= g.day_no + 1 group by g.key, g.day_no)"""


def _lam(spark: SparkSession, d: str) -> DataFrame:
    return news.lambda_daily(src.point_process(spark, d), MU, ALPHA, BETA, spark.range(32).withColumnRenamed("id", "day_no"))


@query(f"with {_LAM} select key, day_no, round(lam, 5) as lam from lam")
def hawkes_lambda_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_lam(spark, d), "lam", digits=5)


@query(f"""with {_LAM}, z as (select key, day_no, case when count(lam) over w = 10 then (lam - avg(lam) over w) / nullif(stddev_samp(lam) over w, 0) end as z from lam window w as (partition by key order by day_no rows between 9 preceding and current row))
select key, day_no, round(lag(z) over (partition by key order by day_no), 5) as lambda_z from z""")
def lambda_z(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy("day_no")
    z = _lam(spark, d).withColumn("z", rolling.rolling_z(F.col("lam"), 10, w))
    return z.select("key", "day_no", F.round(F.lag("z").over(w), 5).alias("lambda_z"))


C, THETA = 0.01, 0.3  # of the fixed power-law kernel
_USERS = f"""{_EV}, u as (select cast(user_id as varchar) as key, e.event_id, t, s from ev e join events x on e.event_id = x.event_id),
pw as (select a.key, a.event_id, a.t, a.s, coalesce(sum(b.s / power(a.t - b.t + {C}, {1 + THETA})), 0) as excess, coalesce(sum(b.s * (power({C}, -{THETA}) - power(a.t - b.t + {C}, -{THETA}))), 0) as reach
  from u a left join u b on a.key = b.key and b.t < a.t group by 1, 2, 3, 4)"""


def _by_user(spark: SparkSession, d: str) -> DataFrame:
    return src.point_process(spark, d).select(F.col("user_id").cast("string").alias("key"), "event_id", "t", "s")


def _power_law(spark: SparkSession, d: str) -> DataFrame:
    rates = powerlaw.rates_for(C, HORIZON)
    return powerlaw.power_law_states(powerlaw.with_kernel(powerlaw.chunks(_by_user(spark, d), rates), MU, ALPHA / 100, C, THETA), rates, HORIZON)


@query(f"with {_USERS} select key, event_id, round(excess, 6) as excess from pw")
def powerlaw_excess(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_power_law(spark, d).select("key", "event_id", "excess"), "excess")


@query(f"with {_USERS} select key, event_id, round({MU} + {ALPHA / 100} * excess, 5) as intensity, round({MU} * t + {ALPHA / 100 / THETA} * reach, 5) as tau from pw")
def powerlaw_rescaling(spark: SparkSession, d: str) -> DataFrame:
    """Intensity and rescaled time of each user's events under a fixed power-law kernel."""
    return rounded(_power_law(spark, d).select("key", "event_id", "intensity", "tau"), "intensity", "tau", digits=5)


@query(f"""with {_USERS} select key, count(*) as n, round(sum(ln(greatest({MU} + {ALPHA / 100} * excess, 1e-300))) - ({MU * HORIZON} + {ALPHA / 100 / THETA} * sum(s * (power({C}, -{THETA}) - power({HORIZON} - t + {C}, -{THETA})))), 4) as loglik from pw group by 1""")
def powerlaw_loglik(spark: SparkSession, d: str) -> DataFrame:
    """Log likelihood of each user's events under a fixed power-law kernel."""
    return rounded(powerlaw.power_law_loglik(_by_user(spark, d), MU, ALPHA / 100, C, THETA, HORIZON), "loglik", digits=4)


@query(f"""with {_EV}, b as (select key, count(*) as events, {ALPHA / 1000} * power({C}, -{THETA}) / {THETA} * avg(s) as n from ev group by 1) select key, events, round(n, 6) as n, round(case when n < 1 then 1 / (1 - n) end, 6) as cascade from b""")
def powerlaw_branching(spark: SparkSession, d: str) -> DataFrame:
    """Branching ratio of each event type under a fixed power-law kernel."""
    return rounded(powerlaw.power_law_branching(src.point_process(spark, d), ALPHA / 1000, C, THETA), "n", "cascade")


@query(f"""with {_EV}, m as (select key, count(*) as events, avg(s) as m, var_samp(s) / count(*) as vm from ev group by 1),
n as (select key, events, m * {ALPHA} / {BETA} as n, sqrt((m / {BETA}) ** 2 * 25.0 + (m * {ALPHA} / {BETA} ** 2) ** 2 * 0.04 - 2 * m ** 2 * {ALPHA} / {BETA} ** 3 * 0.1 + vm * ({ALPHA} / {BETA}) ** 2) as se from m),
c as (select *, n - 1.959963984540054 * se as low, n + 1.959963984540054 * se as high from n)
select key, events, round(n, 6) as n, round(se, 6) as se, round(low, 6) as low, round(high, 6) as high, high < 0.95 as bounded, round(case when high < 0.95 and n < 1 then 1 / (1 - n) end, 6) as cascade from c""")
def branching_ratio_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(news.branching(src.point_process(spark, d), ALPHA, BETA, 25.0, 0.04, 0.1), "n", "se", "low", "high", "cascade")


@query(f"""with {DAILY}, f as (select asset, fecha, r, coalesce(lag(r) over (partition by asset order by fecha), 0) as news, coalesce(lag(r, 2) over (partition by asset order by fecha), 0) as macro from ret)
select asset, cast(fecha as varchar) as fecha, round(abs(0.5 * r) / (abs(0.5 * r) + abs(0.3 * news)), 6) as share_price, round(abs(0.3 * news) / (abs(0.5 * r) + abs(0.3 * news)), 6) as share_news, cast(0 as double) as share_macro from f""")
def attribution_nway(spark: SparkSession, d: str) -> DataFrame:
    w = rolling.series()
    f = rolling.log_returns(src.daily_close(spark, d)).withColumns({"news": F.coalesce(F.lag("r").over(w), F.lit(0.0)), "macro": F.coalesce(F.lag("r", 2).over(w), F.lit(0.0))})
    out = news.attribution(f, {"price": ("r", 0.5), "news": ("news", 0.3), "macro": ("macro", 0.2)}, {"price", "news"})
    return rounded(out.select("asset", "fecha", "share_price", "share_news", "share_macro"), "share_price", "share_news")
