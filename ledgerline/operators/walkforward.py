"""Walk-forward windows and per-block train statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def add_months(day: date, months: int) -> date:
    """Months later, cut to the month's last day."""
    from calendar import monthrange

    y, m = divmod(day.year * 12 + day.month - 1 + months, 12)
    return date(y, m + 1, min(day.day, monthrange(y, m + 1)[1]))


def windows(first: date, last: date, train_years: int = 4, test_months: int = 6, least: int = 6) -> list[tuple[int, date, date, date]]:
    """(block_id, train_start, test_start, test_end), half-open and contiguous; an error below ``least`` blocks."""
    out, start = [], add_months(first, 12 * train_years)
    while (end := add_months(start, test_months)) <= last:
        out.append((len(out), add_months(start, -12 * train_years), start, end))
        start = end
    if len(out) < least:
        raise ValueError(f"{len(out)} blocks fit, at least {least} are wanted")
    return out


def windows_frame(spark: SparkSession, rows: list[tuple[int, date, date, date]]) -> DataFrame:
    """The windows as a (tiny) table."""
    return spark.createDataFrame(rows, "block_id int, train_start date, test_start date, test_end date")


def assign(series: DataFrame, blocks: DataFrame, order: str = "fecha") -> DataFrame:
    """Rows of each block's train and test range, with block_id and part; a range join against the few blocks."""
    inside = (F.col(order) >= F.col("train_start")) & (F.col(order) < F.col("test_end"))
    joined = series.join(F.broadcast(blocks), inside)
    return joined.withColumn("part", F.when(F.col(order) < F.col("test_start"), "train").otherwise("test"))


def train_scaler(assigned: DataFrame, column: str) -> DataFrame:
    """Mean and sample deviation of each block's train rows."""
    return assigned.where("part = 'train'").groupBy("block_id").agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
