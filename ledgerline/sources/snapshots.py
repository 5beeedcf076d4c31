"""Immutable daily JSON snapshots of headlines and of release calendars, and a paged data source.

Snapshots are read with fixed schemas, exploded to rows, and de-duplicated by their place in the files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import timedelta
from time import sleep

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.cleaning import first_keyword, human_number
from ..operators.dedupe import keep_first

ARTICLE = "struct<url:string,title:string,seendate:string,domain:string,sourcecountry:string>"
SNAPSHOT = f"day string, cap_hit_any boolean, segments array<struct<start:string,end:string,n:int,cap_hit:boolean,articles:array<{ARTICLE}>>>"
EVENT = "struct<country:string,event:string,date:string,actual:string,estimate:string,previous:string,unit:string>"


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    """(seen_at, title, url, domain, sourcecountry, cap_hit_segment): articles with a time, a url and a title.

    Files whose names start with an underscore are bookkeeping and left out; unreadable ones give no rows. Of
    articles with one url the first by day, segment and place stays.
    """
    raw = spark.read.schema(SNAPSHOT).option("multiLine", True).option("pathGlobFilter", "[!_]*.json").json(path)
    segment = raw.select("day", F.posexplode("segments").alias("seg", "s"))
    article = segment.select("day", "seg", F.col("s.cap_hit").alias("cap_hit_segment"), F.posexplode("s.articles").alias("pos", "a"))
    rows = article.select("day", "seg", "pos", "cap_hit_segment", "a.title", "a.url", "a.domain", "a.sourcecountry", F.try_to_timestamp("a.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).cast("timestamp_ntz").alias("seen_at"))
    rows = rows.where("seen_at is not null and url is not null and url <> '' and title is not null and title <> ''")
    return keep_first(rows, ["url"], ["day", "seg", "pos"]).select("seen_at", "title", "url", "domain", "sourcecountry", "cap_hit_segment")


def read_calendar(spark: SparkSession, path: str, keywords: list[tuple[str, str]]) -> DataFrame:
    """(indicator, event_at, actual, consensus, previous, unit, captured_at) of calendar snapshots.

    A snapshot has captured_at and its events. For each indicator and time the earliest capture of each field
    that is not null wins; later captures never rewrite it.
    """
    raw = spark.read.schema(f"captured_at string, data array<{EVENT}>, result array<{EVENT}>, calendar array<{EVENT}>").option("multiLine", True).json(path)
    events = raw.select("captured_at", F.posexplode(F.coalesce("data", "result", "calendar")).alias("pos", "e")).where("upper(e.country) = 'US'")
    rows = events.select(first_keyword(F.col("e.event"), keywords).alias("indicator"), F.to_timestamp_ntz("e.date").alias("event_at"), F.struct("captured_at", "pos").alias("at"),
                         *[human_number(F.col(f"e.{c}")).alias(n) for c, n in (("actual", "actual"), ("estimate", "consensus"), ("previous", "previous"))], F.col("e.unit").alias("unit"), "captured_at")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return rows.where("indicator is not null").groupBy("indicator", "event_at").agg(*[first(c) for c in ("actual", "consensus", "previous", "unit")], F.min("captured_at").alias("captured_at"))


def repair_escapes(text: str) -> str:
    """JSON text with every backslash that starts no valid escape doubled; pairs of backslashes stay."""
    out, k = [], 0
    while k < len(text):
        if text[k] == "\\":
            following = text[k + 1 : k + 2]
            valid = following in '"\\/bfnrt' and following != "" or following == "u" and all(c in "0123456789abcdefABCDEF" for c in text[k + 2 : k + 6]) and len(text[k + 2 : k + 6]) == 4
            out.append(text[k : k + 2] if valid else "\\\\")
            k += 2 if valid else 1
        else:
            out.append(text[k])
            k += 1
    return "".join(out)


class Window(InputPartition):
    """One window of a paged source."""

    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    """Reads each window's pages until a short one, asking again after a failed page."""

    def __init__(self, schema, options: dict) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [Window(k) for k in range(int(self.options.get("windows", "1")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from importlib import import_module

        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(import_module(module), name)
        size, retries, page = int(self.options.get("pagesize", "1000")), int(self.options.get("retries", "3")), 0
        names = self.schema.names
        while True:
            for attempt in range(retries + 1):
                try:
                    rows = fetch(partition.number, page, size, json.loads(self.options.get("query", "{}")))
                    break
                except OSError:
                    if attempt == retries:
                        raise
                    sleep(float(self.options.get("wait", "0")))
            yield from (tuple(r.get(c) for c in names) for r in rows)
            if len(rows) < size:
                return
            page += 1


class PagedSource(DataSource):
    """``spark.read.format("ledgerline_paged")`` over a function ``fetch(window, page, size, query)`` named by ``module:name``.

    The function talks to the service (prices, vintages, headlines, sentiment, rates); windows are read in
    parallel. Options: fetch, windows, pagesize, retries, wait (seconds before asking again), query (JSON).
    """

    @classmethod
    def name(cls) -> str:
        return "ledgerline_paged"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(schema, self.options)


class RateLimited(OSError):
    """The service asks to wait: worth asking again, unlike a refused query."""


class CapReached(Exception):
    """The service says that a window holds more than it gives at once."""


def by_cursor(fetch: Callable, start, size: int, cursor: Callable) -> Iterator[dict]:
    """Rows of ``fetch(start, size)`` page by page, the next from ``cursor(last row)`` on, until a short page.

    A cursor that does not move on is an error, not an endless loop.
    """
    while True:
        rows = fetch(start, size)
        yield from rows
        if len(rows) < size:
            return
        following = cursor(rows[-1])
        if following <= start:
            raise ValueError(f"the cursor stays at {following}")
        start = following


def bisected(fetch: Callable, start, end, cap: int, least: timedelta) -> Iterator[dict]:
    """Segments (start, end, rows, cap_hit) that cover [start, end): a window that returns ``cap`` rows is split in two.

    A window of at most ``least`` is kept as it is, marked cap_hit: what it lacks is then known to be censored.
    """
    waiting = [(start, end)]
    while waiting:
        a, b = waiting.pop()
        rows = fetch(a, b)
        full = len(rows) >= cap
        if full and b - a > least:
            middle = a + (b - a) / 2
            waiting += [(middle, b), (a, middle)]
        else:
            yield {"start": a, "end": b, "rows": rows, "cap_hit": full}


def in_chunks(fetch: Callable, first_year: int, last_year: int, years: int = 4) -> list[dict]:
    """All rows of ``fetch(first_year, last_year)``; where it raises ``CapReached``, by chunks of ``years`` years."""
    try:
        return list(fetch(first_year, last_year))
    except CapReached:
        return [r for y in range(first_year, last_year + 1, years) for r in fetch(y, min(y + years - 1, last_year))]


def vintage_rows(raw: DataFrame) -> DataFrame:
    """Downloaded vintages with numbers: a value of '.' or other text is none and goes, as do repeats of (obs_date, realtime_start)."""
    typed = raw.select("series_id", F.to_date("obs_date").alias("obs_date"), F.to_date("realtime_start").alias("realtime_start"), F.expr("try_cast(value as double)").alias("value"))
    return typed.dropna().groupBy("series_id", "obs_date", "realtime_start").agg(F.max("value").alias("value"))


def candles(raw: DataFrame, column: str = "close") -> DataFrame:
    """(asset, fecha, ``column``) of downloaded candles (asset, open_time in ms, ``column``, ingested): the last capture of a day counts."""
    day = F.timestamp_millis("open_time").cast("timestamp_ntz").cast("date")
    return raw.groupBy("asset", day.alias("fecha")).agg(F.max_by(F.col(column).cast("double"), "ingested").alias(column))


def missing_captures(days: DataFrame, captured: DataFrame, most: int | None = None) -> DataFrame:
    """Days (``day``) of ``days`` without a capture, the newest ``most`` of them: what a resumed run still has to fetch."""
    left = days.select("day").distinct().join(captured.select("day").distinct(), "day", "left_anti")
    return left.orderBy(F.col("day").desc()).limit(most) if most else left


def capture_days(days: list, fetch: Callable, write: Callable, walls: int = 5) -> tuple[list, bool]:
    """Fetches and writes day by day, newest first: (days written, stopped). Stops after ``walls`` rate limits in a row."""
    done, hit = [], 0
    for day in sorted(days, reverse=True):
        try:
            write(day, fetch(day))
        except RateLimited:
            hit += 1
            if hit >= walls:
                return done, True
            continue
        hit = 0
        done.append(day)
    return done, False


def write_once(df: DataFrame, path: str) -> bool:
    """Appends an immutable snapshot folder: False, and nothing is written, if it is there already."""
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            return False
        raise
    return True


def newest_snapshot(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The file below ``folder`` that matches ``pattern`` and has the greatest name; None without one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.agg(F.max_by("path", F.regexp_extract("path", "[^/]+$", 0))).first()[0]


def is_fresh(spark: SparkSession, path: str, days: int = 7) -> bool:
    """Whether the newest file of a cached table is at most ``days`` old."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("modificationTime")
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.max("modificationTime"))
    return bool(files.agg(F.coalesce(age <= days * 86_400, F.lit(False))).first()[0])


def cached(spark: SparkSession, path: str, load: Callable[[], DataFrame], days: int = 7) -> DataFrame:
    """The table at ``path`` while it is fresh, else what ``load`` gives, written there first."""
    try:
        fresh = is_fresh(spark, path, days)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = False
    if not fresh:
        load().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Sources:
    """Sources by name, each with the key it needs, if any."""

    def __init__(self) -> None:
        self.loaders: dict[str, tuple[Callable, str | None]] = {}

    def add(self, name: str, load: Callable, key: str | None = None) -> None:
        self.loaders[name] = load, key

    def available(self, keys: dict[str, str]) -> list[str]:
        """Names whose key is not wanted or not blank."""
        return [n for n, (_, key) in self.loaders.items() if key is None or keys.get(key, "").strip()]
