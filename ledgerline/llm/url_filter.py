"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

Everything here is DataFrame functions; no Python runs on the executors.

A *listed* entry is ``host/path``: it covers its host and all subdomains, where the URL's path starts with
the entry's path. An entry's path is ``/``, a directory (``/de/``) or a whole path. Each URL is expanded into
its host suffixes times its path prefixes, no deeper than the deepest entry. The expansions probe a Bloom
filter of fixed maximum size (broadcast, ``max_filter_mb``); the few that pass meet the exact list in a hash
join, which removes the filter's false positives.

Defined results: null URL or no ``://``: host and path empty, no entry fits. A URL without a path has the
empty path, which starts with no entry's path. Of several rules that fit the longest wins. Repeated rows each
get their own result. An empty list or empty input gives rows without matches, or no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, table

WORDS = 8  # 32-bit words in a block: 256 bits, one cache line's half
BROADCAST_ENTRIES = 100_000

#: The contract's rules, as (action, entry).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: Hosts of the listed canonical URLs of the query.
LISTED_HOSTS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_DOMAINS = ["example.com", "example.net", "example.org"]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The key's block, and the one bit it has in each of the block's words."""
    second = F.xxhash64(key, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(second, 5 * i).bitwiseAND(F.lit(31)).cast("int"))
             for i in range(WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), masks


def blocked_bloom(keys: DataFrame, key: str, n_keys: int, bits_per_key: int = 12, max_filter_mb: int = 8) -> tuple[DataFrame, int]:
    """The Bloom filter as rows (block, w0..w7) and its number of blocks.

    32 bytes a block; never more than ``max_filter_mb``, whatever the list's size, so that it may be broadcast.
    Beyond that bound the filter lets more through, and the exact join has more to do.
    """
    wanted = max(1, n_keys * bits_per_key // (32 * WORDS))
    blocks = min(1 << (wanted - 1).bit_length() if wanted > 1 else 1, max_filter_mb * 1024 * 1024 // (4 * WORDS))
    block, masks = _bits(F.col(key), blocks)
    marked = keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def probe(df: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``df`` whose key may be in the filter."""
    block, masks = _bits(F.col(key), blocks)
    held = reduce(lambda x, y: x & y, [F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(masks)])
    return (df.withColumn("block", block).join(F.broadcast(bloom), "block").where(held)
            .drop("block", *[f"w{i}" for i in range(WORDS)]))


def match_entries(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """Exact matches (host, path, entry, and the entry's other columns) of distinct or repeated host/path rows.

    ``entries`` has a column ``entry`` (``host/path``). All matches are returned, one row per URL row and entry.
    """
    entries = entries.where("entry is not null")
    depth = F.size(F.split(F.substring_index("entry", "/", 1), "\\."))
    slashes = F.length("entry") - F.length(F.translate("entry", "/", ""))
    n, labels, segments = entries.agg(F.count("*"), F.max(depth), F.max(slashes)).first()
    bloom, blocks = blocked_bloom(entries, "entry", n)
    host, path = F.split("host", "\\."), F.split("path", "/")
    size = F.size("labels")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(size, F.lit(labels or 1))),
                           lambda k: F.array_join(F.slice("labels", size - k + 1, k), "."))
    parts = F.size("parts")
    directories = F.transform(
        F.filter(F.sequence(F.lit(1), F.least(parts, F.lit((segments or 1) + 1))), lambda k: k < parts),
        lambda k: F.concat(F.array_join(F.slice("parts", 1, k), "/"), F.lit("/")))
    prefixes = F.array_distinct(F.concat(directories, F.array("path")))
    expanded = (urls.where("host <> '' and path <> ''")
                .select("host", "path", host.alias("labels"), path.alias("parts"))
                .select("host", "path", prefixes.alias("prefixes"), F.explode(suffixes).alias("suffix"))
                .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
                .select("host", "path", F.concat("suffix", "prefix").alias("entry")))
    hits = probe(expanded, "entry", bloom, blocks)
    exact = F.broadcast(entries) if n <= BROADCAST_ENTRIES else entries.hint("shuffle_hash")
    return hits.join(exact, "entry")


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and listed (the longest listed entry that fits, else null), which replace columns of those names.

    ``rules`` has (action, entry), ``listed`` has (entry). The verdict is the longest fitting rule's action;
    without one it is ``block`` for a listed URL and ``allow`` otherwise. URLs without host or path, which no entry fits,
    get a join key of their own each, so that however many there are they do not meet in one task.
    """
    entries = (rules.select("entry", "action").unionByName(listed.select("entry", F.lit("listed").alias("action")))
               .where("entry is not null").distinct())
    host, path = host_path(F.col(f"`{url}`"))
    found = match_entries(pages.select(host.alias("host"), path.alias("path")), entries)
    longest = F.struct(F.length("entry").alias("n"), F.col("entry"), F.col("action"))
    is_rule = F.col("action") != "listed"
    best = (found.groupBy("host", "path")
            .agg(F.max(F.when(is_rule, longest)).alias("r"), F.max(F.when(~is_rule, longest)).alias("l"))
            .select(F.concat("host", "path").alias("_k"), F.struct("r", "l").alias("_best")))
    # one struct keeps the input's columns apart, whatever their names
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "listed") or c == url]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)]) if kept else F.struct(F.lit(0).alias("c"))
    judged = pages.select(row.alias("_row"), host.alias("host"), path.alias("path"))
    # a path starts with a slash and a host holds none, so the key tells both
    alone = F.concat(F.lit(" "), F.monotonically_increasing_id().cast("string"))
    judged = judged.withColumn("_k", F.when((F.col("host") != "") & (F.col("path") != ""), F.concat("host", "path")).otherwise(alone))
    out = judged.join(best, "_k", "left")
    listed_entry = F.col("_best.l.entry")
    verdict = F.coalesce(F.col("_best.r.action"), F.when(listed_entry.isNotNull(), "block").otherwise("allow"))
    new = [F.col("host"), F.col("path"), F.col("_best.r.entry").alias("rule"), verdict.alias("verdict"), listed_entry.alias("listed")]
    return out.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(kept)], *[x for x, c in zip(new, ("host", "path", "rule", "verdict", "listed"), strict=True) if c != url])


def listed_entries() -> list[str]:
    """The query's listed canonical URLs: every listed host below every domain."""
    return [f"{h}.{d}/" for h in LISTED_HOSTS for d in LISTED_DOMAINS]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` url judged: page_id, host, path, rule, verdict, listed."""
    rules = spark.createDataFrame(RULES, "action string, entry string")
    listed = spark.createDataFrame([(x,) for x in listed_entries()], "entry string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


_ENTRY_FITS = "(host = {h} or ends_with(host, '.' || {h})) and starts_with(path, {p})"

OP1_SQL = """
with entries(action, entry) as (values {values}),
e as (select action, entry, split_part(entry, '/', 1) h, substr(entry, strpos(entry, '/')) p from entries),
u as (
  select page_id,
         case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest
  from pages),
s as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
  from u)
select page_id, host, path, rule, coalesce(rule_action, case when listed is not null then 'block' else 'allow' end) verdict, listed
from (
  select s.*,
    (select e.entry from e where e.action <> 'listed' and {fits} order by length(e.entry) desc, e.entry desc limit 1) as rule,
    (select e.action from e where e.action <> 'listed' and {fits} order by length(e.entry) desc, e.entry desc limit 1) as rule_action,
    (select e.entry from e where e.action = 'listed' and {fits} order by length(e.entry) desc, e.entry desc limit 1) as listed
  from s)
""".format(
    values=", ".join(f"('{a}', '{e}')" for a, e in [*RULES, *[("listed", x) for x in listed_entries()]]),
    upper=ASCII_UPPER, lower=ASCII_LOWER, fits=_ENTRY_FITS.format(h="e.h", p="e.p"))
