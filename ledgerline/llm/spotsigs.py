"""SpotSigs document fingerprints, in DataFrame functions only.

Every occurrence of a common word (an *anchor*) spots a signature: the anchor and the chain of the next
``CHAIN`` content words, common words being skipped, found in the ``REACH`` words after the anchor (fewer at
the text's end). Where ``GAP`` words pass without a common word, as in tables and lists, each next word is an
anchor until one comes. A document's fingerprint is its set of signature hashes. Documents are compared by
the Jaccard likeness of their fingerprints; for joins they are partitioned by set length, and only sets whose
lengths and first signatures allow the wanted likeness are compared.

Defined results: null text counts as empty; a text without words has one signature, that of the raw text. So
equal texts have equal fingerprints, and no fingerprint is empty. Repeated rows are results of their own. An empty table
gives no rows.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, materialise, table

CHAIN = 2
REACH = 8
GAP = 6
CELLS = 65_536
BUCKET_BYTES = 12_000_000

#: Common words of English, German, French and Spanish that serve as anchors.
COMMON_WORDS = """
a an and are as at be but by for from had has have he his i in is it its not of on or she that the their
they this to was were which will with you
als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist
mit nach nicht noch sich sie sind um und von vor war wie wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour
qu que qui sa se ses son sont sur un une
al como con del el ella ellos en entre era es esta este ha la las lo los más no nos o para pero por que se
sin sobre su sus también un una y ya
""".split()


def _is_common(word: Column) -> Column:
    return word.isin(sorted(set(COMMON_WORDS)))


def _signature(words: Column, at: Column, chain: int, reach: int) -> Column:
    """Hash of the word at ``at`` (from 0) and the chain after it."""
    after = F.slice(F.filter(F.slice(words, at + 2, reach), lambda w: ~_is_common(w)), 1, chain)
    return F.hash(F.element_at(words, at + 1), after)


def _spotted(words: Column, word: Column, at: Column, gap: int) -> Column:
    """The word is common, or none of the ``gap`` words before it is."""
    before = F.slice(words, F.greatest(at - gap, F.lit(0)) + 1, F.least(at, F.lit(gap)))
    return _is_common(word) | ~F.exists(before, _is_common)


def with_fingerprint(df: DataFrame, text: str, out: str, chain: int = CHAIN, reach: int = REACH, gap: int = GAP) -> DataFrame:
    """Adds ``out``: the sorted distinct signature hashes of the column ``text`` as array<int>, never empty."""
    words = f"_{out}_words"
    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(words, F.filter(F.split(F.lower(raw), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    spots = F.transform(F.col(words), lambda w, i: F.when(_spotted(F.col(words), w, i, gap), _signature(F.col(words), i, chain, reach)))
    sigs = F.when(F.size(words) > 0, F.array_sort(F.array_distinct(F.array_compact(spots)))).otherwise(F.array(F.hash(raw)))
    return df.withColumn(out, sigs).drop(words)


def as_text(sigs: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a signature, in order."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints (0 to 1)."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return shared / (F.size(a) + F.size(b) - shared)


def with_next(df: DataFrame, order: str, weight: Column, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Adds, for each of ``columns``, its value in the next row by ascending ``order`` (nulls last; after the last: the first).

    Rows are dealt into ranges of about ``BUCKET_BYTES`` of ``weight`` by a histogram of at most ``CELLS``
    cells (its size, and that of the map made from it, does not depend on the data). Each range's first row is
    also put behind the range before it, so no range needs another's rows. Rows with equal ``order`` follow
    each other by a hash of ``columns``.
    """
    spark = df.sparkSession
    key = F.coalesce(F.col(order).cast("bigint"), F.lit(2**63 - 1))
    # cells lie between quantiles, so that a few ids far out do not put all others in one cell
    low, high = df.select(F.percentile_approx(F.when(F.col(order).isNotNull(), key), [0.001, 0.999], 10_000).alias("q")).first()[0] or (0, 0)
    cell = F.coalesce(F.width_bucket(key.cast("double"), F.lit(float(low)), F.lit(max(float(high) + 1, float(np.nextafter(float(high), np.inf)))), F.lit(CELLS)), F.lit(1)).cast("int")
    cell = F.when(F.col(order).isNull(), CELLS + 2).otherwise(cell)
    df = df.withColumns({"_cell": cell, "_key": key})
    histogram = df.groupBy("_cell").agg(F.sum(weight).alias("w"), F.min("_key").alias("k")).orderBy("_cell").collect()
    ranges: list[list] = []  # [cells, first key]
    filled = BUCKET_BYTES
    for c, w, k in histogram:
        if filled >= BUCKET_BYTES:
            ranges.append([[], k])
            filled = 0
        ranges[-1][0].append(c)
        filled += w or 0
    rows = [(c, r, first, (r - 1) % len(ranges)) for r, (cells, first) in enumerate(ranges) for c in cells]
    dealt = spark.createDataFrame(rows, "_cell int, _range int, _first bigint, _before int")
    places = F.when(F.col("_key") == F.col("_first"), F.array(F.struct(F.lit(0).alias("t"), F.col("_range").alias("r")), F.struct(F.lit(1).alias("t"), F.col("_before").alias("r")))).otherwise(F.array(F.struct(F.lit(0).alias("t"), F.col("_range").alias("r"))))
    placed = df.join(F.broadcast(dealt), "_cell").withColumn("_place", F.explode(places))
    w = Window.partitionBy("_place.r").orderBy("_place.t", "_key", F.xxhash64(*columns))
    led = placed.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in columns})
    return led.where(F.col("_place.t") == 0).drop("_cell", "_key", "_range", "_first", "_before", "_place")


def near_duplicates(fingerprints: DataFrame, sigs: str = "sigs", threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_sigs, component_id) of rows (doc_id, ``sigs``): classes of documents linked at ``threshold``.

    Equal fingerprints are collapsed first. Sets are partitioned by length: band b holds lengths from
    (1/threshold)**b; a set meets those of its own band and of the one below. In a band only sets that share
    one of the first n - ceil(threshold * n) + 1 signatures can reach the threshold; pairs are pruned by
    their lengths, then compared exactly. Null doc_ids take no part.
    """
    rows = fingerprints.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(sigs).alias("sigs"))
    rows = rows.withColumns({"fp": F.sha2(as_text(F.col("sigs")), 256), "n": F.size("sigs")})
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("sigs").alias("sigs"), F.first("n").alias("n"))
    member = rows.select("doc_id", "fp", "n").join(classes.select("fp", "rep"), "fp")
    step = log(1 / threshold)
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    head = classes.withColumns({"band": F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int"), "head": F.slice("sigs", 1, keep)})
    a = head.select(F.col("rep").alias("a"), F.col("n").alias("na"), "band", F.explode("head").alias("sig"))
    b = head.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), "head").select("b", "nb", "band", F.explode("head").alias("sig"))
    able = (F.col("nb") <= F.col("na")) & (F.col("nb") >= F.ceil(F.col("na") * threshold - 1e-9)) & ((F.col("nb") < F.col("na")) | (F.col("b") < F.col("a")))
    pairs = a.join(b, ["band", "sig"]).where(able).select("a", "b").distinct()
    sets = classes.select("rep", "sigs")
    links = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("sigs").alias("sa")), "a")
             .join(sets.select(F.col("rep").alias("b"), F.col("sigs").alias("sb")), "b")
             .where(likeness(F.col("sa"), F.col("sb")) >= threshold).select("a", "b"))
    found = connected_components(materialise(links, "spot"))
    return (member.join(found, member["rep"] == found["node"], "left")
            .select("doc_id", F.col("n").alias("n_sigs"), F.coalesce("component", "rep").alias("component_id")))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every ``documents`` text and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = with_fingerprint(docs, "text", "sigs")
    led = with_next(printed, "doc_id", F.octet_length("text"), ["text", "sigs"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    led = led.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    both = with_fingerprint(led.drop("text", "next_text"), "edited", "edited_sigs")
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
                       likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
