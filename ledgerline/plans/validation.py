"""Queries on checks, flags, alignment and economics, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as fn
from ..operators import asof, audit, bootstrap, coverage, economic, regimes, rolling
from ..operators import calibration as cal
from ..sources import tables as src
from .news import _INDEX, _index
from .regime import _STRAT, _TOP, FIXED, HIST, HIST_MULTI, _history
from .relational import CALENDAR, DAILY, KEYWORDS, PIT, VINTAGES, _tech, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL if it has one."""
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql or ""
        return f
    return add


def _cdf(z: str) -> str:
    return f"case when {z} > 7 then 1.0 when {z} < -7 then 0.0 else 0.5 + exp(-{z} * {z} / 2) * 0.3989422804014327 * {z} * list_reduce(list_prepend(cast(1 as double), [cast(91 - i as double) for i in range(1, 91)]), lambda a, k: 1 + {z} * {z} / (2 * k + 1) * a) end"


@query(f"with recursive {HIST}, z as (select asset, fecha, q0, q1, (r - ({FIXED.mu[0]})) / sqrt(s0) as z0, (r - ({FIXED.mu[1]})) / sqrt(s1) as z1 from hist) select asset, cast(fecha as varchar) as fecha, round(q0 * ({_cdf('z0')}) + q1 * ({_cdf('z1')}), 6) as pit from z")
def pit_uniform(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.pit_returns(_history(spark, d), FIXED.mu).select("asset", "fecha", "pit"), "pit")


@query(f"""with recursive {_TOP}, py as (select *, case when x1 > x0 then 1 else 0 end as y from hist),
s as (select count(*) as n, avg(2 * (q1 - y) * (q1 - y)) as brier, avg(-ln(greatest(case when y = 1 then q1 else 1 - q1 end, 1e-15))) as logloss, avg(cast(y as double)) as f, max(greatest(abs(q0 - x0), abs(q1 - x1))) as max_gap from py),
e as (select sum(n * abs(mean_confidence - accuracy)) / sum(n) as ece from rl where n > 0)
select n, round(brier, 6) as brier, round(logloss, 6) as logloss, round(2 * f * (1 - f), 6) as brier_base, round(-(f * ln(greatest(f, 1e-15)) + (1 - f) * ln(greatest(1 - f, 1e-15))), 6) as logloss_base, round(ece, 6) as ece, round(max_gap, 6) as max_gap, max_gap < 1e-12 as refused from s, e""")
def calibration_bundle(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.calibration_bundle(_history(spark, d)), "brier", "logloss", "brier_base", "logloss_base", "ece", "max_gap")


_A = FIXED.arrays()
_MODEL = "model(regime, label, kappa, p_stay) as (values " + ", ".join(f"({i}, '{audit.regime_labels(2)[i]}', {float(_A['alpha'][i] + _A['gamma'][i] / 2 + _A['beta'][i])!r}::double, {float(_A['P'][i, i])!r}::double)" for i in range(2)) + ")"


@query(f"""with recursive {HIST}, {_MODEL}, own as (select case when x1 > x0 then 1 else 0 end as regime, count(*) as days, stddev_pop(r) * sqrt(252) / 100 as vol_ann from hist group by 1)
select cast(m.regime as integer) as regime, label, round(kappa, 6) as kappa, round(1 / (1 - p_stay), 6) as expected_duration, 1 / (1 - p_stay) < 2 as degenerate, coalesce(days, 0) as days, round(100.0 * coalesce(days, 0) / (select count(*) from hist), 6) as pct_days, round(vol_ann, 6) as vol_ann
from model m left join own on own.regime = m.regime""")
def regime_table(spark: SparkSession, d: str) -> DataFrame:
    table = audit.degenerate(audit.params_table(spark, FIXED)).drop("near_rank_one", "p_stay")
    return rounded(audit.regime_table(regimes.with_regime(_history(spark, d)), table), "kappa", "expected_duration", "pct_days", "vol_ann")


_P = FIXED.P


_TRANSITIONS = f"""{HIST_MULTI}, y as (select asset, fecha, case when x1 > x0 then 1 else 0 end as y from hist), nx as (select asset, y, lead(y) over (partition by asset order by fecha) as ny from y),
tr as (select asset, y as regime, count(*) as n, avg(case when ny = 0 then 1.0 else 0 end) as p_0, avg(case when ny = 1 then 1.0 else 0 end) as p_1 from nx where ny is not null group by 1, 2)"""


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    return audit.empirical_transitions(regimes.with_regime(_history(spark, d, by_asset=True)))


@query(f"""with recursive {_TRANSITIONS}, st as (select *, case when regime = 0 then p_0 else p_1 end as p_stay, max(p_0) over w - min(p_0) over w < 0.05 and max(p_1) over w - min(p_1) over w < 0.05 and count(*) over w > 1 as near_rank_one from tr window w as (partition by asset))
select asset, cast(regime as integer) as regime, n, round(1 / (1 - least(p_stay, 1 - 1e-12)), 6) as expected_duration, 1 / (1 - least(p_stay, 1 - 1e-12)) < 2 as degenerate, near_rank_one from st""")
def transition_flags(spark: SparkSession, d: str) -> DataFrame:
    """How long each asset's regimes last as filtered, which are degenerate, and whether tomorrow depends on today at all."""
    rows = audit.transition_rows(_transitions(spark, d))
    return rounded(rows.select("asset", "regime", "n", "expected_duration", "degenerate", "near_rank_one"), "expected_duration")


@query(f"""with {DAILY}, {PIT}, g as (
  select p.fecha, s.series_id, (select arg_max(series.value, series.avail_date) from series where series.series_id = s.series_id and series.avail_date <= p.fecha) as value from daily p, (select distinct series_id from series) s),
w as (select fecha, max(case when series_id = 'A' then value end) - max(case when series_id = 'R' then value end) as slope, max(case when series_id = 'N' then value end) as oas from g group by 1)
select cast(fecha as varchar) as fecha, round(slope, 6) as slope, round(case when count(oas) over v = 20 then (oas - avg(oas) over v) / nullif(stddev_samp(oas) over v, 0) end, 5) as oas_z from w window v as (order by fecha rows between 19 preceding and current row)""")
def macro_features(spark: SparkSession, d: str) -> DataFrame:
    """Slope between two series and z score of a third, as of what was published; no further lag."""
    known = asof.point_in_time(src.one_per_vintage(src.vintages(spark, d))).withColumnRenamed("avail_date", "fecha")
    grid = src.daily_close(spark, d).select("fecha", F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("series_id"))
    at = asof.asof_backward(grid, known, "fecha", ["series_id"], ["value"])
    wide = at.groupBy("fecha").agg(*[F.max(F.when(F.col("series_id") == x, F.col("value"))).alias(x) for x in "ANR"]).withColumn("asset", F.lit("ALL"))
    out = wide.select("fecha", F.round(F.col("A") - F.col("R"), 6).alias("slope"), F.round(rolling.rolling_z(F.col("N"), 20, rolling.series()), 5).alias("oas_z"))
    return rounded(out)


_FEATURES = ("sma_gap", "bb_width", "bb_width_z")


@query(f"""with t as ({_tech(DAILY)}), l as (unpivot (select * from t) on sma_gap, bb_width, bb_width_z into name feature value v),
e as (select n.asset, n.feature, min(l.fecha) as a, max(l.fecha) as z from (select distinct asset, f.feature from t, (select unnest(['sma_gap', 'bb_width', 'bb_width_z']) as feature) f) n left join l on l.asset = n.asset and l.feature = n.feature group by 1, 2)
select e.asset, e.feature, count(*) as n, count(*) filter (where miss and (a is null or t.fecha < a)) as warm_up, count(*) filter (where miss and t.fecha > a and t.fecha < z) as internal, count(*) filter (where miss and t.fecha > z) as trailing
from e join (select asset, fecha, f.feature, case f.feature when 'sma_gap' then sma_gap is null when 'bb_width' then bb_width is null else bb_width_z is null end as miss from t, (select unnest(['sma_gap', 'bb_width', 'bb_width_z']) as feature) f) t on t.asset = e.asset and t.feature = e.feature group by 1, 2""")
def internal_gaps(spark: SparkSession, d: str) -> DataFrame:
    return audit.gap_report(rolling.technical_features(src.daily_close(spark, d)), _FEATURES)


_ENT = "(-(case when x0 > 0 then x0 * ln(x0) else 0 end) - (case when x1 > 0 then x1 * ln(x1) else 0 end))"


@query(f"""with recursive {HIST}, s as (select asset, fecha, {_ENT} > 0.5 * ln(2) as high from hist), c as (select *, case when high is distinct from lag(high) over (partition by asset order by fecha) then 1 else 0 end as ch from s),
g as (select *, sum(ch) over (partition by asset order by fecha rows unbounded preceding) as run_id from c)
select asset, cast(min(fecha) as varchar) as first, cast(max(fecha) as varchar) as last, count(*) as n from g where high group by asset, run_id""")
def high_entropy_runs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.high_entropy_runs(regimes.with_regime(_history(spark, d))))


@query(f"with {DAILY} select asset, cast(fecha as varchar) as fecha, round(r, 6) as r from ret where fecha > (select max(fecha) from ret) - interval 365 day")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.recent(rolling.log_returns(src.daily_close(spark, d)).select("asset", "fecha", "r"), 365), "r")


@query(f"with {VINTAGES}, f as (select series_id, obs_date, arg_min(value, realtime_start) as first_print from v group by 1, 2) select series_id, cast(obs_date as varchar) as obs_date, first_print from f qualify row_number() over (partition by series_id order by obs_date desc) <= 6")
def last_observations(spark: SparkSession, d: str) -> DataFrame:
    prints = asof.first_print_last_vintage(src.one_per_vintage(src.vintages(spark, d))).select("series_id", "obs_date", "first_print")
    return rounded(audit.last_rows(prints, 6, "series_id", "obs_date"))


@query(f"with {CALENDAR}, w as (select indicator, round(avg(actual - consensus), 6) as w from cal group by 1 union all select 'absent', null) select indicator, w, row_number() over (order by abs(w) desc nulls last, indicator) as place from w")
def weights_by_size(spark: SparkSession, d: str) -> DataFrame:
    w = src.calendar(spark, d).groupBy("indicator").agg(F.round(F.avg(F.col("actual") - F.col("consensus")), 6).alias("w"))
    w = w.unionByName(spark.createDataFrame([("absent", None)], "indicator string, w double"))
    return audit.by_size(w, "w", "indicator").withColumn("place", F.col("place").cast("bigint"))


@query(f"with {_INDEX}, m as (select event_id, cast(ts as date) + 3 as day from events where event_type = 'error') select event_id, cast(m.day as varchar) as day, round(coalesce(idx.value, 0), 5) as value from m left join idx on idx.day = m.day")
def surprise_markers(spark: SparkSession, d: str) -> DataFrame:
    m = src.table(spark, d, "events").where("event_type = 'error'").select("event_id", F.date_add(F.col("ts").cast("timestamp_ntz").cast("date"), 3).alias("day"))
    return rounded(audit.looked_up(m, _index(spark, d), "day", "value").select("event_id", "day", "value"), "value", digits=5)


_KEY = "sha1(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')))"


@query(f"with c as (select {_KEY.format('d.text')} as key, cast(max(l.quality) as double) as s from documents d join labels l on d.doc_id = l.doc_id where d.text is not null group by 1) select doc_id, {_KEY.format('text')} as key, s from documents left join c on c.key = {_KEY.format('text')}")
def relevance_join(spark: SparkSession, d: str) -> DataFrame:
    docs = src.table(spark, d, "documents").select("doc_id", F.col("text").alias("title"))
    cache = docs.where("title is not null").join(src.table(spark, d, "labels"), "doc_id").groupBy(fn.title_key(F.col("title")).alias("key")).agg(F.max("quality").cast("double").alias("s"))
    return audit.with_relevance(docs, cache).select("doc_id", "key", "s")


@query(f"with {DAILY}, t as ({_tech(DAILY)}) select ret.asset, cast(ret.fecha as varchar) as fecha, round(r, 6) as r, sma_gap, bb_width, bb_width_z from ret join t on t.asset = ret.asset and t.fecha = cast(ret.fecha as varchar) where ret.fecha >= date '1993-06-01' and sma_gap is not null and bb_width is not null and bb_width_z is not null")
def aligned_sample(spark: SparkSession, d: str) -> DataFrame:
    prices = src.daily_close(spark, d)
    out = audit.aligned_sample(rolling.log_returns(prices).select("asset", "fecha", "r"), rolling.technical_features(prices), _FEATURES, "1993-06-01")
    return rounded(out.withColumn("bb_width_z", F.round("bb_width_z", 5)), "r", "sma_gap", "bb_width")


@query(f"with {DAILY}, s as (select avg(r) as m, stddev_samp(r) as sd from ret where fecha < date '1996-01-01') select asset, cast(fecha as varchar) as fecha, round((r - m) / sd, 6) as r from ret, s")
def standardised_returns(spark: SparkSession, d: str) -> DataFrame:
    r = rolling.log_returns(src.daily_close(spark, d)).select("asset", "fecha", "r")
    return rounded(audit.standardise_with(r, audit.checked_scaler(r.where("fecha < date '1996-01-01'"), ["r"])), "r")


@query("with m as (select max(cast(ts as date)) as top from events) select event_type as source, cast(max(cast(ts as date)) as varchar) as last_day, cast(date_diff('day', max(cast(ts as date)), date_add(any_value(top), interval 3 day)::date) as integer) as gap_days, date_diff('day', max(cast(ts as date)), date_add(any_value(top), interval 3 day)::date) > 2 as stale from events, m group by 1")
def source_freshness(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    asof_day = F.date_add(F.lit(e.agg(F.max(F.col("ts").cast("date"))).first()[0]), 3)
    return rounded(audit.freshness(e, "source", "ts", asof_day, 2))


_RULES = {"has_text": "coalesce(trim(text), '') <> ''", "known_lang": "coalesce(lang in ('en', 'de', 'fr', 'es'), false)", "length_agrees": "coalesce(n_chars = length(text), false)", "score_in_range": "coalesce(quality between 0 and 1, false)"}


@query("with j as (select d.*, l.quality from documents d left join labels l on d.doc_id = l.doc_id) " + " union all ".join(f"select '{k}' as rule, count(*) as n, count(*) filter (where not ({v})) as broken from j" for k, v in _RULES.items()))
def record_violations(spark: SparkSession, d: str) -> DataFrame:
    joined = src.table(spark, d, "documents").join(src.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return audit.violations(joined, {"has_text": F.trim("text") != "", "known_lang": F.col("lang").isin("en", "de", "fr", "es"), "length_agrees": F.col("n_chars") == F.length("text"), "score_in_range": F.col("quality").between(0, 1)})


@query("select page_id as id, url as link, length(html) as size from pages where url is not null and trim(url) <> '' and html is not null and trim(html) <> ''")
def mapped_records(spark: SparkSession, d: str) -> DataFrame:
    pages = src.table(spark, d, "pages")
    out = audit.mapped(pages, {"id": F.col("page_id"), "link": F.col("url"), "body": F.col("html")}, ["link", "body"])
    return out.select("id", "link", F.length("body").cast("bigint").alias("size"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def props_any_case(spark: SparkSession, d: str) -> DataFrame:
    fields = F.from_json("props", "map<string,string>")
    return src.table(spark, d, "events").select("event_id", fn.any_case(fields, "absent", "K").alias("k"))


_DIFF = "avg(r_s - r) * 252 / nullif(stddev_samp(r_s - r) * sqrt(252), 0)"


@query(f"""with recursive {_STRAT}, k as (select unnest([0.0, 2.0, 5.0, 10.0])::double as cost_bp), x as (select asset, cost_bp, r, w, turnover, w * r - turnover * cost_bp * 0.01 as r_s from strat, k)
select asset, cost_bp, count(*) as n, round(avg(r_s) * 252 / nullif(stddev_samp(r_s) * sqrt(252), 0), 5) as sharpe_rule, round(avg(r) * 252 / nullif(stddev_samp(r) * sqrt(252), 0), 5) as sharpe_hold, round({_DIFF}, 5) as sharpe_diff,
round(avg(r_s) * 252, 3) as ann_rule, round(avg(r) * 252, 3) as ann_hold, round(stddev_samp(r_s) * sqrt(252), 3) as vol_rule, round(stddev_samp(r) * sqrt(252), 3) as vol_hold, round(avg(case when w > 0 then 1.0 else 0.0 end), 6) as exposure, count(*) filter (where turnover > 0) as n_changes, cast(sum(turnover) as double) as turnover from x group by 1, 2""")
def cost_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    out = economic.cost_sensitivity(_history(spark, d), "xi_f_1", [0.0, 2.0, 5.0, 10.0])
    return out.withColumns({c: F.round(c, 5) for c in ("sharpe_rule", "sharpe_hold", "sharpe_diff")} | {c: F.round(c, 3) for c in ("ann_rule", "ann_hold", "vol_rule", "vol_hold")} | {"exposure": F.round("exposure", 6)})


@query(None)
def economic_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the Sharpe ratio of rule less holding; success only if it lies above zero."""
    return economic.verdict(_history(spark, d), "xi_f_1")


@query(None)
def conditional_stats_ci(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each regime's days with bootstrap intervals and suppressed cells."""
    durations = [1 / (1 - FIXED.P[i][i]) for i in range(2)]
    return bootstrap.conditional_stats(regimes.with_regime(_history(spark, d)), durations)


@query(f"""with recursive {HIST}, r(rule, ok) as (select 'predicted_sum', abs(q0 + q1 - 1) <= 1e-9 from hist union all select 'filtered_sum', abs(x0 + x1 - 1) <= 1e-9 from hist union all select 'predicted_range', least(q0, q1) >= -1e-9 from hist
union all select 'filtered_range', least(x0, x1) >= -1e-9 from hist union all select 'variance_positive', least(s0, s1) > 0 from hist union all select 'loglik_finite', isfinite(ll) from hist) select rule, count(*) as n, count(*) filter (where not ok) as broken from r group by 1""")
def history_checks(spark: SparkSession, d: str) -> DataFrame:
    return audit.history_checks(_history(spark, d))


@query(f"""with recursive {_TRANSITIONS}, f as (select asset, bool_and(abs(p_0 + p_1 - 1) < 1e-9) as a, bool_and(least(p_0, p_1) >= 0 and greatest(p_0, p_1) <= 1) as b, bool_and(case when regime = 0 then p_0 else p_1 end < 1) as c, count(*) = 2 as e from tr group by 1)
select asset, unnest(['rows_sum_to_one', 'entries_in_range', 'every_regime_is_left', 'all_regimes_seen']) as rule, unnest([a, b, c, e]) as passed from f""")
def transition_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rules that each asset's filtered transitions keep or break."""
    return audit.transition_rules(_transitions(spark, d))


@query(f"""with {CALENDAR}, want as (select unnest(['click', 'view', 'absent']) as indicator), c as (select w.indicator, count(c.event_id) as n, count(c.consensus) as n_with_consensus from want w left join cal c on c.indicator = w.indicator group by 1)
select indicator, n, n_with_consensus, n >= 24 and n_with_consensus >= 12 as ready from c""")
def reopen_status(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([(x,) for x in ("click", "view", "absent")], "indicator string")
    return audit.reopen_status(coverage.coverage_summary(src.calendar(spark, d), want).select("indicator", "n", "n_with_consensus"), {"n": 24, "n_with_consensus": 12})


@query(f"with {DAILY}, {VINTAGES}, f as (select series_id, obs_date, min(realtime_start) as published from v group by 1, 2) select series_id, cast(obs_date as varchar) as obs_date, cast(ret.fecha as varchar) as fecha, round(abs(r), 6) as move from f join ret on ret.fecha = f.published")
def release_day_moves(spark: SparkSession, d: str) -> DataFrame:
    first = src.vintages(spark, d).groupBy("series_id", "obs_date").agg(F.min("realtime_start").alias("published"))
    out = audit.release_moves(first, rolling.log_returns(src.daily_close(spark, d)), "published")
    return rounded(out.select("series_id", "obs_date", "fecha", "move"), "move")


_NAMES = ["click", "view", "error"]
_WORDS = [(n, p) for n, (_, p) in zip(_NAMES, KEYWORDS, strict=False)]


@query("""with h as (select doc_id, lower(text) as text, cast((doc_id * 7919) % 2592000 * 1000000 as bigint) as t from documents), k(rank, indicator, pattern) as (values """ + ", ".join(f"({i}, '{n}', '{p}')" for i, (n, p) in enumerate(_WORDS)) + """),
r as (select event_type as indicator, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as t from events where event_id % 5 = 0),
a as (select h.doc_id, h.t, k.rank, k.indicator from h join k on regexp_matches(h.text, k.pattern)),
p as (select a.*, r.t as rt from a asof left join r on a.indicator = r.indicator and a.t >= r.t), n as (select a.doc_id, a.rank, r.t as rt from a asof left join r on a.indicator = r.indicator and a.t <= r.t),
m as (select p.doc_id, p.t, p.rank, p.indicator, case when n.rt is null or (p.rt is not null and p.t - p.rt <= n.rt - p.t) then p.rt else n.rt end as hit_t from p join n on p.doc_id = n.doc_id and p.rank = n.rank),
f as (select doc_id, arg_min(indicator, rank) as indicator, arg_min(hit_t, rank) as hit_t from m where abs(t - hit_t) <= 900000000 group by 1)
select h.doc_id, f.indicator as event_indicator, cast(f.hit_t as double) as event_at from h left join f on h.doc_id = f.doc_id""")
def headline_event_match(spark: SparkSession, d: str) -> DataFrame:
    heads = src.table(spark, d, "documents").select("doc_id", "text", ((F.col("doc_id") * 7919) % 2_592_000 * 1_000_000).cast("bigint").alias("t"))
    releases = src.table(spark, d, "events").where("event_id % 5 = 0").select(F.col("event_type").alias("indicator"), src.micros("ts").alias("t"))
    out = asof.match_events(heads, releases, _WORDS, "t", "doc_id", "text", 900_000_000)
    return out.select("doc_id", "event_indicator", F.col("event_at").cast("double").alias("event_at"))
