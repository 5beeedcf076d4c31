"""De-duplication with a stated survivor, first-seen fields, and multi-source unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(pick(F.struct(*order, *[c for c in rest if c not in order])).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the least by ``order``. A minimum of structs, so it is combined before the shuffle."""
    return _one_of(df, keys, order, F.min)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``."""
    return _one_of(df, keys, order, F.max)


def first_non_null_by(df: DataFrame, keys: Sequence[str], order: Column, fields: Sequence[str]) -> DataFrame:
    """Per key and field, the first value that is not null by ``order``: later captures never overwrite."""
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields])


def union_dedupe(sources: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Union of sources; of rows with one key the first source's wins, then the least by ``order``."""
    tagged = [df.withColumn("source_rank", F.lit(k)) for k, df in enumerate(sources)]
    return keep_first(reduce(DataFrame.unionByName, tagged), [key], ["source_rank", *order])
