"""Running values along an order that hold for hot keys, too.

A window of a key is one task, however many rows the key has. Here rows are cut into ranges of (key, order), so a hot key
is many ranges. Each range is scanned by itself; what earlier ranges of the same key leave behind is one row a range, of the few keys
that reach into a second range (at most two rows for each range, so it may be broadcast), and is added at the end. The
scanned ranges are written once to the shared folder: ranges come from a sample and must not be drawn again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise


def _joined_moments(a: Column, b: Column) -> Column:
    """(n, mean, m2) of two disjoint sets; either may be empty."""
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    return F.struct(n.alias("n"), (a["mean"] + gap * share).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * share).alias("m2"))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None,
         lags: dict[str, Column] | None = None, moments: dict[str, Column] | None = None, position: str | None = None, back: Sequence[str | Column] | None = None) -> DataFrame:
    """``df`` with running values within ``keys`` along ``order``, each row counted from the key's first row to itself.

    ``sums``: running sums, nulls as 0. ``lasts``: the last value that is not null. ``nexts``: the same from the other end, along ``back``, which
    turns the order round. ``lags``: the value of the row before (null for the first). ``moments``: (n, mean, m2) of the values that are
    not null, m2 the sum of squares about the mean. ``position``: the row's number from 1. Rows that are equal in ``order`` follow each other in any
    order, so give one that tells them apart where that matters. Null keys are a key.
    """
    sums, lasts, nexts, lags, moments = sums or {}, lasts or {}, nexts or {}, lags or {}, moments or {}
    cuts = [*keys, *order]
    placed = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cuts).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy(*keys, "_part")
    rows = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    new: dict[str, Column] = {"_at": F.row_number().over(within.orderBy(*order)).cast("bigint")}
    for n, c in sums.items():
        new[f"_s_{n}"] = F.sum(F.coalesce(c, F.lit(0))).over(rows)
    for n, c in lasts.items():
        new[f"_l_{n}"] = F.last(c, ignorenulls=True).over(rows)
    for n, c in nexts.items():
        new[f"_n_{n}"] = F.last(c, ignorenulls=True).over(within.orderBy(*(back or [])).rowsBetween(Window.unboundedPreceding, 0))
    for n, c in lags.items():
        new[f"_g_{n}"] = F.lag(F.struct(c.alias("v"))).over(within.orderBy(*order))
        new[f"_o_{n}"] = F.struct(c.alias("v"))
    for n, c in moments.items():
        count = F.count(c).over(rows)
        new[f"_m_{n}"] = F.struct(count.alias("n"), F.coalesce(F.avg(c).over(rows), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(c).over(rows) * count, F.lit(0.0)).alias("m2"))
    local = materialise(placed.withColumns(new), "scan")
    left = [F.max("_at").alias("_rows")]
    left += [F.max_by(f"_s_{n}", "_at").alias(f"_s_{n}") for n in sums] + [F.max_by(f"_l_{n}", "_at").alias(f"_l_{n}") for n in lasts] + [F.min_by(f"_n_{n}", "_at").alias(f"_n_{n}") for n in nexts]
    left += [F.max_by(f"_o_{n}", "_at").alias(f"_o_{n}") for n in lags] + [F.max_by(f"_m_{n}", "_at").alias(f"_m_{n}") for n in moments]
    ends = local.groupBy(*keys, "_part").agg(*left).withColumn("_parts", F.count("*").over(Window.partitionBy(*keys))).where("_parts > 1")
    along = Window.partitionBy(*keys).orderBy("_part")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_c_rows")]
    carry += [F.sum(f"_s_{n}").over(before).alias(f"_c_s_{n}") for n in sums] + [F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_l_{n}") for n in lasts]
    carry += [F.last(f"_n_{n}", ignorenulls=True).over(after).alias(f"_c_n_{n}") for n in nexts] + [F.last(f"_o_{n}").over(before).alias(f"_c_o_{n}") for n in lags]
    empty = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    carry += [F.aggregate(F.collect_list(f"_m_{n}").over(before), empty, _joined_moments).alias(f"_c_m_{n}") for n in moments]  # a row a range
    carried = ends.select(*carry)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    both = local.join(F.broadcast(carried), same, "left")
    out = {n: F.col(f"_s_{n}") + F.coalesce(F.col(f"_c_s_{n}"), F.lit(0)) for n in sums} | {n: F.coalesce(f"_l_{n}", f"_c_l_{n}") for n in lasts} | {n: F.coalesce(f"_n_{n}", f"_c_n_{n}") for n in nexts}
    out |= {n: F.when(F.col("_at") > 1, F.col(f"_g_{n}.v")).otherwise(F.col(f"_c_o_{n}.v")) for n in lags}
    out |= {n: _joined_moments(F.coalesce(f"_c_m_{n}", empty), F.col(f"_m_{n}")) for n in moments}
    if position:
        out[position] = F.col("_at") + F.coalesce("_c_rows", F.lit(0))
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def sample_deviation(m: Column) -> Column:
    """Sample deviation of running moments; null below two values."""
    return F.when(m["n"] > 1, F.sqrt(m["m2"] / (m["n"] - 1)))
