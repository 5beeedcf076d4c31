"""Queries on cleaning, de-duplication, as-of joins, windows and aggregates, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as fn
from ..operators import asof, audit, coverage, dedupe, rolling
from ..sources import tables as src

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Keyword patterns in order of priority.
KEYWORDS = [("CPI", "th.*ing"), ("NFP", "on"), ("FOMC", "eau"), ("PMI", "en"), ("RETAIL_SALES", "er")]

DAILY = """daily as (
  select asset, fecha, cast(sum(p) as double) / count(p) as close from (
    select 'ALL' as asset, cast(o_orderdate as date) as fecha, cast(o_totalprice as decimal(18,2)) as p from orders)
  group by 1, 2),
ret as (
  select * from (
    select asset, fecha, close, 100 * ln(close / lag(close) over (partition by asset order by fecha)) as r from daily)
  where r is not null)"""
MULTI = DAILY.replace("'ALL' as asset", "o_orderpriority as asset")
VINTAGES = """v as (
  select l_returnflag as series_id, cast(o_orderdate as date) as obs_date, max(l_extendedprice) as value, cast(l_shipdate as date) as realtime_start
  from lineitem join orders on l_orderkey = o_orderkey
  where cast(l_shipdate as date) > cast(o_orderdate as date) group by 1, 2, 4)"""
CALENDAR = """cal as (
  select event_type as indicator, event_id, ts, value as actual,
         lag(value) over (partition by event_type order by ts, event_id) as consensus from events)"""


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text: stable between engines."""
    fixed = {c: F.round(c, digits) for c in columns}
    fixed |= {c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"}
    return df.withColumns(fixed)


@query(f"with {DAILY} select asset, cast(fecha as varchar) fecha, round(close, 6) as close from daily")
def daily_close(spark: SparkSession, d: str) -> DataFrame:
    return rounded(src.daily_close(spark, d), "close")


@query(f"with {DAILY} select asset, cast(fecha as varchar) fecha, round(close, 6) as close, round(r, 6) as r from ret")
def log_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rolling.log_returns(src.daily_close(spark, d)), "close", "r")


@query(f"with {MULTI} select asset, cast(fecha as varchar) fecha, round(close, 6) as close, round(r, 6) as r from ret")
def multi_asset_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rolling.log_returns(src.daily_close(spark, d, by_asset=True)), "close", "r")


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = src.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return dedupe.keep_first(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    rows = src.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return dedupe.keep_last(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""select key, source_rank, id from (
  select sha1(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) as key, 0 as source_rank, doc_id as id from documents
  union all select sha1(lower(regexp_replace(url, '^\\s+|\\s+$', '', 'g'))), 1, page_id from pages
  union all select sha1(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), 2, item_id from benchmark)
qualify row_number() over (partition by key order by source_rank, id) = 1""")
def multi_source_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = src.table(spark, d, "documents").select(fn.title_key(F.col("text")).alias("key"), F.col("doc_id").alias("id"))
    pages = src.table(spark, d, "pages").select(fn.title_key(F.col("url")).alias("key"), F.col("page_id").alias("id"))
    items = src.table(spark, d, "benchmark").select(fn.title_key(F.col("text")).alias("key"), F.col("item_id").alias("id"))
    return dedupe.union_dedupe([docs, pages, items], "key", ["id"])


@query("""select user_id, hour, min_by(click, n) filter (where click is not null) as click, min_by(view, n) filter (where view is not null) as view, min_by(error, n) filter (where error is not null) as error from (
  select user_id, cast(date_trunc('day', ts) as varchar)[:10] as hour, cast(epoch_us(ts) as hugeint) * 1000000 + event_id as n,
    case when event_type = 'click' then value end as click, case when event_type = 'view' then value end as view, case when event_type = 'error' then value end as error from events)
group by 1, 2""")
def first_non_null_by_capture(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events")
    wide = e.select("user_id", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd").alias("hour"), "ts", "event_id", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("click", "view", "error")])
    return dedupe.first_non_null_by(wide, ["user_id", "hour"], F.struct("ts", "event_id"), ["click", "view", "error"])


@query("""select event_id, raw, round(case suffix when 'K' then 1e3 when 'M' then 1e6 when 'B' then 1e9 else 1.0 end * try_cast(nullif(number, '') as double), 6) as parsed from (
  select event_id, raw, regexp_extract(up, '^(-?\\d+(?:\\.\\d+)?)\\s*([KMBT%]?)$', 1) as number, regexp_extract(up, '^(-?\\d+(?:\\.\\d+)?)\\s*([KMBT%]?)$', 2) as suffix from (
    select *, upper(trim(replace(raw, ',', ''))) as up from (
      select event_id, case event_id % 5 when 0 then case when event_id % 2 = 0 then '-' else '+' end || cast(event_id as varchar) || '.5%' when 1 then cast(event_id as varchar) || 'K' when 2 then '1,' || lpad(cast(event_id % 1000 as varchar), 3, '0') || 'B' when 3 then 'n/a' else ' ' || cast(event_id as varchar) || ' m ' end as raw from events)))""")
def parse_human_numbers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    s = i.cast("string")
    raw = (F.when(i % 5 == 0, F.concat(F.when(i % 2 == 0, "-").otherwise("+"), s, F.lit(".5%"))).when(i % 5 == 1, F.concat(s, F.lit("K"))).when(i % 5 == 2, F.concat(F.lit("1,"), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("B")))
           .when(i % 5 == 3, "n/a").otherwise(F.concat(F.lit(" "), s, F.lit(" m "))))
    rows = src.table(spark, d, "events").select("event_id", raw.alias("raw"))
    return rows.withColumn("parsed", F.round(fn.human_number(F.col("raw")), 6))


@query("select doc_id, case " + " ".join(f"when regexp_matches(lower(title), '{p}') then '{n}'" for n, p in KEYWORDS) + " end as indicator from (select doc_id, text as title from documents)")
def keyword_indicator(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "documents").select("doc_id", fn.first_keyword(F.col("text"), KEYWORDS).alias("indicator"))


@query(r"select page_id, sha1(lower(regexp_replace(url, '^\s+|\s+$', '', 'g'))) as key from pages")
def title_key(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "pages").select("page_id", fn.title_key(F.col("url")).alias("key"))


@query("select page_id, case when trim(s, '_') = '' then 'query' else substr(trim(s, '_'), 1, 60) end as slug from (select page_id, regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g') as s from pages)")
def file_slug(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "pages").select("page_id", fn.slug(F.col("url")).alias("slug"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""select user_id, count(*) as n, round(case when count(*) filter (where event_type in ('click', 'error')) = 0 then null else
  cast(count(*) filter (where event_type = 'click') - count(*) filter (where event_type = 'error') as double) / count(*) filter (where event_type in ('click', 'error')) end, 6) as score from events group by 1""")
def vote_score(spark: SparkSession, d: str) -> DataFrame:
    up, down = (F.count(F.when(F.col("event_type") == k, 1)).cast("double") for k in ("click", "error"))
    return src.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(fn.vote_score(up, down), 6).alias("score"))


@query("select event_id, round(greatest(-1.0, least(1.0, (value - 10) / 20)), 6) as score from events")
def clamped_score(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "events").select("event_id", F.round(fn.clamp((F.col("value") - 10) / 20), 6).alias("score"))


@query("""select d.doc_id, case when l.quality - l.toxic is not null then cast(greatest(-1, least(1, l.quality - l.toxic)) as double) end as score, l.doc_id is not null as scored from documents d left join labels l on d.doc_id = l.doc_id where d.text is not null""")
def validated_sentiment(spark: SparkSession, d: str) -> DataFrame:
    labels = src.table(spark, d, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("s"))
    return (src.table(spark, d, "documents").where("text is not null").select("doc_id").join(labels, "doc_id", "left")
            .select("doc_id", fn.clamp(F.col("s")).alias("score"), F.col("s").isNotNull().alias("scored")))


@query(f"""with {CALENDAR}, want as (select unnest(['click', 'view', 'error', 'absent']) as indicator)
select w.indicator, count(c.event_id) as n, count(c.consensus) as n_with_consensus, cast(min(c.ts) as date)::varchar as first_day, cast(max(c.ts) as date)::varchar as last_day
from want w left join cal c on c.indicator = w.indicator group by 1""")
def calendar_coverage(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([(x,) for x in ("click", "view", "error", "absent")], "indicator string")
    out = coverage.coverage_summary(src.calendar(spark, d), want)
    return out.select("indicator", "n", "n_with_consensus", F.col("first_ts").cast("date").cast("string").alias("first_day"), F.col("last_ts").cast("date").cast("string").alias("last_day"))


@query("""with days as (select distinct cast(o_orderdate as date) as fecha from orders),
spine as (select cast(unnest(generate_series(min(fecha), max(fecha), interval 1 day)) as date) as fecha from days)
select cast(fecha as varchar) as fecha from spine where fecha not in (select fecha from days)""")
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    days = src.table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").cast("date").alias("fecha"))
    return coverage.missing_days(days, "fecha").select(F.col("fecha").cast("string").alias("fecha"))


@query("select cast(cast(o_orderdate as date) as varchar) as fecha, count(*) as n from orders group by 1 having count(*) >= 10")
def censored_days(spark: SparkSession, d: str) -> DataFrame:
    days = src.table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").cast("date").alias("fecha"))
    return rounded(coverage.censored_days(days, "fecha", 10))


@query("""select count(*) as n_rows, count(distinct page_id) as n_ids, count(*) filter (where url is null or url = '') as no_url, count(*) filter (where html is null or html = '') as no_html,
  count(*) - count(distinct url) as repeated_urls from pages""")
def snapshot_integrity(spark: SparkSession, d: str) -> DataFrame:
    empty = lambda c: F.count(F.when(F.col(c).isNull() | (F.col(c) == ""), 1))
    return src.table(spark, d, "pages").agg(F.count("*").alias("n_rows"), F.count_distinct("page_id").alias("n_ids"), empty("url").alias("no_url"), empty("html").alias("no_html"), (F.count("*") - F.count_distinct("url")).alias("repeated_urls"))


@query("""with h as (select hour(ts) as hour, count(*) as n, count(*) filter (where minute(ts) = 0 and second(ts) = 0) as on_the_hour from events group by 1)
select hour, n, on_the_hour, round(cast(n as double) / sum(n) over (), 6) as share from h""")
def timestamp_audit_hours(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    rows = src.table(spark, d, "events").select(F.hour(ts).cast("bigint").alias("hour"), ((F.minute(ts) == 0) & (F.second(ts) == 0)).alias("sharp"))
    out = rows.groupBy("hour").agg(F.count("*").alias("n"), F.count(F.when(F.col("sharp"), 1)).alias("on_the_hour"))
    total = out.agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(total), F.lit(True)).select("hour", "n", "on_the_hour", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""select l_returnflag, count(*) as n, min(lag) as lag_min, quantile_cont(lag, 0.5) as lag_median, max(lag) as lag_max, round(avg(case when lag < 0 then 1.0 else 0.0 end), 6) as negative_mass
from (select l_returnflag, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as lag from lineitem join orders on l_orderkey = o_orderkey) group by 1""")
def timestamp_audit_lags(spark: SparkSession, d: str) -> DataFrame:
    return _lags(spark, d).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("lag").cast("bigint").alias("lag_min"), F.percentile("lag", F.lit(0.5)).alias("lag_median"), F.max("lag").cast("bigint").alias("lag_max"), F.round(F.avg(F.when(F.col("lag") < 0, 1.0).otherwise(0.0)), 6).alias("negative_mass"))


def _lags(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.col(c).cast("timestamp_ntz").cast("date")
    orders = src.table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("o"))
    line = src.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", day("l_shipdate").alias("s"))
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select("l_returnflag", F.datediff("s", "o").alias("lag"))


@query("""with l as (select cast(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as double) as lag from lineitem join orders on l_orderkey = o_orderkey), b as (select min(lag) as a, max(lag) as z from l),
w as (select case when a = z then a - coalesce(nullif(0.001 * abs(a), 0), 0.001) else a end as lo, case when a = z then z + coalesce(nullif(0.001 * abs(z), 0), 0.001) else z end as hi, a, z from b where a is not null),
e as (select cast(i as integer) as bin, lo + i * ((hi - lo) / 12) - case when i = 0 and a <> z then 0.001 * (hi - lo) else 0 end as edge_lo, lo + (i + 1) * ((hi - lo) / 12) as edge_hi from w, (select unnest(range(12)) as i))
select bin, round(edge_lo, 6) as edge_lo, round(edge_hi, 6) as edge_hi, count(lag) as n from e left join l on lag > edge_lo and (lag <= edge_hi or bin = 11) group by 1, 2, 3""")
def lag_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(coverage.lag_histogram(_lags(spark, d).select(F.col("lag").cast("double").alias("lag")), "lag", 12), "edge_lo", "edge_hi")


_Z = "case when count(close) over w20 = 20 then (close - avg(close) over w20) / nullif(stddev_samp(close) over w20, 0) end"


@query(f"with {DAILY} select asset, cast(fecha as varchar) fecha, round({_Z}, 6) as z from daily window w20 as (partition by asset order by fecha rows between 19 preceding and current row)")
def rolling_zscore(spark: SparkSession, d: str) -> DataFrame:
    prices = src.daily_close(spark, d)
    return rounded(prices.select("asset", "fecha", rolling.rolling_z(F.col("close"), 20, rolling.series()).alias("z")), "z")


def _full(f: str, c: str, n: int) -> str:
    return f"case when count({c}) over w{n} = {n} then {f}({c}) over w{n} end"


_WINDOWS = ", ".join(f"w{n} as (partition by asset order by fecha rows between {n - 1} preceding and current row)" for n in (20, 200, 250))
_TECH = """with {daily}, a as (
  select asset, fecha, ({m20} - {m200}) / nullif({s20}, 0) as gap, 4 * {s20} / nullif({m20}, 0) as width from daily window {w}),
b as (select *, (width - {mz}) / nullif({sz}, 0) as z from a window {w}),
t as (select asset, fecha, lag(gap) over (partition by asset order by fecha) as sma_gap, lag(width) over (partition by asset order by fecha) as bb_width, lag(z) over (partition by asset order by fecha) as bb_width_z from b)
select asset, cast(fecha as varchar) fecha, round(sma_gap, 6) as sma_gap, round(bb_width, 6) as bb_width, round(bb_width_z, 5) as bb_width_z from t"""
_tech = lambda daily: _TECH.format(daily=daily, m20=_full("avg", "close", 20), m200=_full("avg", "close", 200), s20=_full("stddev_samp", "close", 20), mz=_full("avg", "width", 250), sz=_full("stddev_samp", "width", 250), w=_WINDOWS)


@query(_tech(DAILY))
def technical_features(spark: SparkSession, d: str) -> DataFrame:
    out = rolling.technical_features(src.daily_close(spark, d))
    return rounded(out.withColumn("bb_width_z", F.round("bb_width_z", 5)), "sma_gap", "bb_width").drop("close")


@query(_tech(MULTI))
def technical_features_by_asset(spark: SparkSession, d: str) -> DataFrame:
    out = rolling.technical_features(src.daily_close(spark, d, by_asset=True))
    return rounded(out.withColumn("bb_width_z", F.round("bb_width_z", 5)), "sma_gap", "bb_width").drop("close")


SURPRISE = f"""{CALENDAR}, sur as (
  select *, count(*) over w as n_seen, stddev_samp(surprise) over w as sigma from (select *, actual - consensus as surprise from cal where actual is not null and consensus is not null)
  window w as (partition by indicator order by ts, event_id rows between unbounded preceding and current row)),
z as (select *, case when n_seen >= 12 then surprise / nullif(sigma, 0) end as z from sur)"""


@query(f"with {SURPRISE} select indicator, event_id, round(surprise, 6) as surprise, n_seen, round(z, 6) as z from z")
def expanding_surprise_z(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rolling.expanding_surprise_z(src.calendar(spark, d)).select("indicator", "event_id", "surprise", "n_seen", "z"), "surprise", "z")


@query(f"with {SURPRISE} select c.indicator, count(*) as n, count(z.event_id) as n_valid, count(z.z) as n_scored from cal c left join z on c.event_id = z.event_id group by 1")
def surprise_coverage(spark: SparkSession, d: str) -> DataFrame:
    cal = src.calendar(spark, d)
    z = rolling.expanding_surprise_z(cal).select("event_id", F.lit(1).alias("valid"), "z")
    return cal.join(z, "event_id", "left").groupBy("indicator").agg(F.count("*").alias("n"), F.count("valid").alias("n_valid"), F.count("z").alias("n_scored"))


@query(f"""with {DAILY} select asset, cast(fecha as varchar) fecha, round(exp(sum(r / 10000) over (partition by asset order by fecha rows unbounded preceding)), 6) as equity from ret""")
def equity_curve(spark: SparkSession, d: str) -> DataFrame:
    small = rolling.log_returns(src.daily_close(spark, d)).withColumn("r", F.col("r") / 100)
    return rounded(rolling.equity(small).select("asset", "fecha", "equity"), "equity")


@query(f"""with {MULTI}, e as (select asset, fecha, exp(sum(r / 10000) over (partition by asset order by fecha rows unbounded preceding)) as equity from ret),
p as (select asset, equity / max(equity) over (partition by asset order by fecha rows unbounded preceding) - 1 as fall from e)
select asset, round(min(fall), 6) as drawdown_negative, round(max(-fall), 6) as drawdown_positive from p group by 1""")
def max_drawdown(spark: SparkSession, d: str) -> DataFrame:
    small = rolling.log_returns(src.daily_close(spark, d, by_asset=True)).withColumn("r", F.col("r") / 100)
    return rounded(rolling.max_drawdown(small), "drawdown_negative", "drawdown_positive")


@query(f"with {MULTI} select asset, round(avg(r) * 252, 6) as ann_mean, round(stddev_samp(r) * sqrt(252), 5) as ann_vol, round(avg(r) * 252 / nullif(stddev_samp(r) * sqrt(252), 0), 6) as sharpe from ret group by 1")
def annualised_stats(spark: SparkSession, d: str) -> DataFrame:
    out = rolling.log_returns(src.daily_close(spark, d, by_asset=True)).groupBy("asset").agg(*[c.alias(n) for n, c in rolling.annualised(F.col("r")).items()])
    return rounded(out.withColumn("ann_vol", F.round("ann_vol", 5)), "ann_mean", "sharpe")


@query(f"""with {DAILY}, s as (select *, r > 0 as up, case when (r > 0) is distinct from lag(r > 0) over (order by fecha) then 1 else 0 end as c from ret),
g as (select *, sum(c) over (order by fecha rows unbounded preceding) as run_id from s)
select asset, cast(run_id as bigint) as run_id, up, cast(min(fecha) as varchar) as first, cast(max(fecha) as varchar) as last, count(*) as n from g group by 1, 2, 3""")
def sign_runs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rolling.runs(rolling.log_returns(src.daily_close(spark, d)).withColumn("up", F.col("r") > 0), "up"))


@query(f"""with {DAILY}, {VINTAGES}, m as (select obs_date as fecha, series_id, max(value) as value from v group by 1, 2)
select cast(p.fecha as varchar) as fecha, s.series_id, (select arg_max(m.value, m.fecha) from m where m.series_id = s.series_id and m.fecha <= p.fecha) as value
from (select distinct fecha from daily) p, (select distinct series_id from m) s""")
def asof_backward_macro(spark: SparkSession, d: str) -> DataFrame:
    macro = src.vintages(spark, d).groupBy(F.col("obs_date").alias("fecha"), "series_id").agg(F.max("value").alias("value"))
    days = src.daily_close(spark, d).select("fecha").distinct()
    grid = days.crossJoin(macro.select("series_id").distinct())
    return rounded(asof.asof_backward(grid, macro, "fecha", ["series_id"], ["value"]))


@query("""with h as (select event_id, event_type as key, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as t from events where event_id % 2 = 1),
r as (select event_type as key, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as t, max(value) as value from events where event_id % 2 = 0 group by 1, 2),
p as (select h.event_id, h.key, h.t, r.t as rt, r.value from h asof left join r on h.key = r.key and h.t >= r.t),
n as (select h.event_id, r.t as rt, r.value from h asof left join r on h.key = r.key and h.t <= r.t),
m as (select p.event_id, p.key, p.t, case when n.rt is null or (p.rt is not null and p.t - p.rt <= n.rt - p.t) then p.rt else n.rt end as matched_on,
  case when n.rt is null or (p.rt is not null and p.t - p.rt <= n.rt - p.t) then p.value else n.value end as value from p join n on p.event_id = n.event_id)
select event_id, key, t, cast(case when abs(t - matched_on) <= 600000000 then matched_on end as double) as matched_on, case when abs(t - matched_on) <= 600000000 then value end as value from m""")
def asof_nearest_release(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events").select("event_id", F.col("event_type").alias("key"), src.micros("ts").alias("t"), "value")
    left = e.where("event_id % 2 = 1").select("event_id", "key", "t")
    return asof.asof_nearest(left, e.where("event_id % 2 = 0").select("key", "t", "value"), "t", ["key"], "value", 600_000_000).withColumn("matched_on", F.col("matched_on").cast("double"))


PIT = f"""{VINTAGES}, live as (
  select *, max(obs_date) over (partition by series_id order by realtime_start, obs_date rows unbounded preceding) as seen from v),
pit as (select series_id, cast(realtime_start + case isodow(realtime_start) when 5 then 3 when 6 then 2 else 1 end * interval 1 day as date) as avail_date, value, realtime_start, obs_date from live where obs_date >= seen),
series as (select series_id, avail_date, arg_max(value, epoch(realtime_start) * 100000 + epoch(obs_date) / 86400) as value from pit group by 1, 2)"""


@query(f"with {PIT} select series_id, cast(avail_date as varchar) as avail_date, value from series")
def pit_vintage_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(asof.point_in_time(src.one_per_vintage(src.vintages(spark, d))))


@query(f"""with {VINTAGES}, main as (select * from v where obs_date >= date '1997-01-01'), pre as (select * from v where obs_date < date '1997-03-01'),
f as (select series_id, obs_date, min(realtime_start) as p from main group by 1, 2),
facts as (select series_id, min(obs_date) as start, cast(trunc(quantile_cont(date_diff('day', obs_date, p), 0.5)) as integer) as lag from f group by 1)
select series_id, cast(obs_date as varchar) as obs_date, value, cast(realtime_start as varchar) as realtime_start from main
union all select pre.series_id, cast(obs_date as varchar), value, cast(cast(obs_date + lag * interval 1 day as date) as varchar) from pre join facts on pre.series_id = facts.series_id where obs_date < start""")
def splice_prefix(spark: SparkSession, d: str) -> DataFrame:
    v = src.one_per_vintage(src.vintages(spark, d))
    return rounded(asof.splice_prefix(v.where("obs_date < date '1997-03-01'"), v.where("obs_date >= date '1997-01-01'")))


@query(f"""with {VINTAGES}, lags as (select series_id, obs_date, date_diff('day', obs_date, min(realtime_start)) as lag from v group by 1, 2),
l as (select series_id, quantile_cont(lag, 0.5) as lag_median, round(quantile_cont(lag, 0.95), 6) as lag_p95, max(lag) as lag_max from lags group by 1)
select v.series_id, count(distinct obs_date) as n_obs, count(*) as n_rows, cast(min(obs_date) as varchar) as first_obs, cast(max(obs_date) as varchar) as last_obs, any_value(lag_median) as lag_median, any_value(lag_p95) as lag_p95, any_value(lag_max) as lag_max
from v join l on v.series_id = l.series_id group by 1""")
def vintage_ledger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(asof.vintage_ledger(src.one_per_vintage(src.vintages(spark, d))).withColumn("lag_max", F.col("lag_max").cast("bigint")), "lag_p95")


@query(f"with {VINTAGES} select series_id, cast(obs_date as varchar) as obs_date, arg_min(value, realtime_start) as first_print, arg_max(value, realtime_start) as last_vintage from v group by 1, 2")
def first_print_last_vintage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(asof.first_print_last_vintage(src.one_per_vintage(src.vintages(spark, d))))


@query(f"""with {CALENDAR}, c as (select *, lag(ts) over (partition by indicator order by ts, event_id) as captured from cal)
select indicator, count(*) as n, count(captured) as n_captured, count(*) filter (where captured <= ts) as n_known, coalesce(bool_and(captured <= ts), true) as passed, count(captured) = 0 as vacuous from c group by 1""")
def consensus_vintage_ledger(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = src.calendar(spark, d).withColumn("captured", F.lag("ts").over(Window.partitionBy("indicator").orderBy("ts", "event_id")))
    known = asof.availability(F.col("captured"), F.col("ts"))
    return c.groupBy("indicator").agg(F.count("*").alias("n"), F.count("captured").alias("n_captured"), F.count(F.when(known, 1)).alias("n_known"), F.coalesce(F.bool_and(known), F.lit(True)).alias("passed"), (F.count("captured") == 0).alias("vacuous"))


@query("select event_id, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as t_us, round(value / 1000, 9) as s from events")
def event_times(spark: SparkSession, d: str) -> DataFrame:
    return rounded(src.point_process(spark, d).select("event_id", F.round(F.col("t") * 86_400_000_000).cast("bigint").alias("t_us"), "s"), "s", digits=9)


@query("""with e as (select event_id, cast(epoch_us(ts) - epoch_us(timestamp '2024-01-01') as double) / 86400000000 as t from events where event_type = 'click'),
n as (select cast(floor(t) as integer) as day_no, count(*) as c from e group by 1), b as (select unnest(range(0, (select max(day_no) + 1 from n))) as day_no),
s as (select b.day_no, day_no % 7 = 3 as is_missing from b), g as (select *, coalesce(sum(cast(is_missing as integer)) over (order by day_no rows between unbounded preceding and 1 preceding), 0) as gone from s)
select event_id, round(t - gone - case when is_missing then t - day_no else 0 end, 8) as t_observed from e join g on cast(floor(t) as integer) = day_no""")
def observed_time_compression(spark: SparkSession, d: str) -> DataFrame:
    e = src.point_process(spark, d).where("key = 'click'").select("event_id", "t")
    last = e.agg(F.max(F.floor("t")).cast("int").alias("hi"))
    spine = last.select(F.explode(F.sequence(F.lit(0), "hi")).alias("day_no")).withColumn("is_missing", F.col("day_no") % 7 == 3)
    return rounded(coverage.observed_time(e, "t", spine).select("event_id", "t_observed"), "t_observed", digits=8)


@query("select event_type as key, count(*) as n, round(1 - cast(count(distinct floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 900000000)) as double) / count(*), 6) as tie_share from events group by 1")
def quantized_tie_share(spark: SparkSession, d: str) -> DataFrame:
    bins = src.table(spark, d, "events").select(F.col("event_type").alias("key"), F.floor(src.micros("ts") / 900_000_000).alias("b"))
    return bins.groupBy("key").agg(F.count("*").alias("n"), F.round(1 - F.count_distinct("b") / F.count("*"), 6).alias("tie_share"))


@query("""with d as (select distinct cast(o_orderdate as date) as fecha from orders), s as (select cast(unnest(generate_series(min(fecha), max(fecha), interval 1 day)) as date) as fecha from d)
select cast(fecha as varchar) as fecha from s where fecha not in (select fecha from d) order by fecha desc limit 10""")
def recent_missing_days(spark: SparkSession, d: str) -> DataFrame:
    days = src.table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").cast("date").alias("fecha"))
    return coverage.missing_days(days, "fecha").orderBy(F.desc("fecha")).limit(10).select(F.col("fecha").cast("string").alias("fecha"))


@query(f"""with {DAILY}, f as (select asset, fecha, close, count(close) over s = 20 as ok, avg(close) over s as m, avg(close) over l as ml, count(close) over l = 200 as okl, stddev_samp(close) over s as sd from daily
  window s as (partition by asset order by fecha rows between 19 preceding and current row), l as (partition by asset order by fecha rows between 199 preceding and current row)),
n as (select count(*) filter (where gap is not null) as gaps, count(*) filter (where width is not null) as widths from (select lag(case when okl and sd <> 0 then (m - ml) / sd end) over (partition by asset order by fecha) as gap, lag(case when ok and m <> 0 then 4 * sd / m end) over (partition by asset order by fecha) as width from f))
select 'bb_width' as name, 'covariate' as role, widths as n, case when widths > 0 then 1 end as shift, widths > 0 as passed from n union all select 'r', 'observation', (select count(*) from ret), 0, true union all select 'sma_gap', 'covariate', gaps, case when gaps > 0 then 1 end, gaps > 0 from n""")
def lag_ledger(spark: SparkSession, d: str) -> DataFrame:
    """By how many days each feature, as built, lags behind what it is made of: covariates by one at least, observations by none."""
    prices = src.daily_close(spark, d)
    w, c = rolling.series(), F.col("close")
    mean, wide, dev = (rolling.full_window(c, f, n, w) for f, n in ((F.avg, 20), (F.avg, 200), (F.stddev_samp, 20)))
    built = rolling.technical_features(prices).withColumns({"raw_gap": F.try_divide(mean - wide, dev), "raw_width": F.try_divide(4.0 * dev, mean)})
    returns = rolling.log_returns(prices)
    previous = prices.withColumn("raw", F.ln(c / F.lag("close").over(w)) * 100).select("asset", "fecha", "raw")
    observed = returns.join(previous, ["asset", "fecha"])
    parts = [("sma_gap", "covariate", audit.measured_lag(built, "sma_gap", "raw_gap")), ("bb_width", "covariate", audit.measured_lag(built, "bb_width", "raw_width")), ("r", "observation", audit.measured_lag(observed, "r", "raw"))]
    rows = reduce(DataFrame.unionByName, [f.select(F.lit(name).alias("name"), F.lit(role).alias("role"), "n", "shift") for name, role, f in parts])
    return rows.withColumn("passed", F.coalesce(F.when(F.col("role") == "covariate", F.col("shift") >= 1).otherwise(F.col("shift") == 0), F.lit(False)))


@query(f"""with {VINTAGES}, f as (select series_id, obs_date, arg_min(value, realtime_start) as first_print, arg_max(value, realtime_start) as last_vintage from v group by 1, 2),
ref as (select l_returnflag as series_id, cast(o_orderdate as date) as obs_date, max(l_extendedprice) as value from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)
select ref.series_id, count(*) as n, count(f.first_print) as matched, count(*) filter (where abs(ref.value - f.first_print) < 0.005) as equal_first, count(*) filter (where abs(ref.value - f.last_vintage) < 0.005) as equal_last from ref left join f on f.series_id = ref.series_id and f.obs_date = ref.obs_date group by 1""")
def vintage_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    """An independent source's values against first prints and last vintages."""
    prints = asof.first_print_last_vintage(src.one_per_vintage(src.vintages(spark, d)))
    line = src.table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("series_id"), "l_extendedprice")
    orders = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp_ntz").cast("date").alias("obs_date"))
    ref = line.join(orders, "l_orderkey").groupBy("series_id", "obs_date").agg(F.max("l_extendedprice").alias("value"))
    near = lambda c: F.count(F.when(F.abs(F.col("value") - F.col(c)) < 0.005, 1))
    return ref.join(prints, ["series_id", "obs_date"], "left").groupBy("series_id").agg(F.count("*").alias("n"), F.count("first_print").alias("matched"), near("first_print").alias("equal_first"), near("last_vintage").alias("equal_last"))
