"""Capture of a service's windows of time as rounds of Spark tasks, with the ledger of what was fetched as a table.

A window is one task. What a round fetched is committed by Spark's writer as one folder of the ledger, so a run that is stopped keeps all rounds
before, and a later run asks for nothing again that the ledger holds. A window that returns the service's cap is written down as split, and its
halves are windows of the next round; at the least width it is kept and marked, as what it lacks is then censored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Store
from .snapshots import RateLimited
from .tables import materialise

LEDGER = "start bigint, end bigint, status string, cap_hit boolean, rows array<string>"


@dataclass(frozen=True)
class Plan:
    """Windows [begin, end) of ``width``, in microseconds or any whole unit; a window with ``cap`` rows is split down to ``least``."""

    begin: int
    end: int
    width: int
    cap: int
    least: int = 1


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, status, cap_hit, rows) of all committed rounds; status is done or split. No rows before the first."""
    store = Store(spark, path)
    rounds = [n for n in store.names() if n.startswith("round=") and store.exists(f"{n}/_SUCCESS")]
    if not rounds:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(*[f"{path.rstrip('/')}/{n}" for n in rounds])


def pending(spark: SparkSession, path: str, plan: Plan) -> DataFrame:
    """(start, end) of the windows that are still to be fetched: the plan's and halves of split ones, less what the ledger holds."""
    known = ledger(spark, path).select("start", "end", "status")
    grid = spark.range(plan.begin, plan.end, plan.width).select(F.col("id").alias("start"), F.least(F.col("id") + plan.width, F.lit(plan.end)).alias("end"))
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("bigint")
    halves = known.where("status = 'split'").select(F.explode(F.array(F.struct(F.col("start"), middle.alias("end")), F.struct(middle.alias("start"), F.col("end")))).alias("h")).select("h.start", "h.end")
    return grid.unionByName(halves).join(known.select("start", "end"), ["start", "end"], "left_anti")


def capture(spark: SparkSession, path: str, fetch: Callable[[int, int], list[dict]], plan: Plan, at_once: int = 64, walls: int = 5, newest_first: bool = True) -> bool:
    """Fetches every pending window, ``at_once`` to a round, and says whether all are fetched.

    ``fetch(start, end)`` runs in tasks and gives rows of JSON values. A window whose fetch is rate-limited stays pending; ``walls``
    rounds in a row that fetch nothing end the run. Any other error ends it at once; the round's other windows are then asked again.
    """
    store, empty, number = Store(spark, path), 0, None
    while True:
        wanted = pending(spark, path, plan).orderBy(F.col("start").desc() if newest_first else F.col("start")).limit(at_once)
        wanted = materialise(wanted, "windows")
        n = wanted.count()
        if not n:
            return True

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for a, b in zip(frame["start"], frame["end"], strict=True):
                    try:
                        rows = fetch(int(a), int(b))
                    except RateLimited:
                        continue
                    full = len(rows) >= plan.cap
                    split = full and b - a > plan.least
                    yield pd.DataFrame({"start": [a], "end": [b], "status": ["split" if split else "done"], "cap_hit": [full], "rows": [[] if split else [json.dumps(r, sort_keys=True) for r in rows]]})

        number = len(store.names()) if number is None else number + 1
        folder = f"round={number:08d}"
        wanted.repartition(n, "start", "end").mapInPandas(run, LEDGER).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{folder}")
        got = spark.read.schema(LEDGER).parquet(f"{path.rstrip('/')}/{folder}").count()
        empty = 0 if got else empty + 1
        if empty >= walls:
            return False


def captured(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(start, end, cap_hit) and the rows' fields, by ``schema``, of all windows that are done; split ones give their halves' rows."""
    done = ledger(spark, path).where("status = 'done'")
    return done.select("start", "end", "cap_hit", F.explode("rows").alias("_row")).select("start", "end", "cap_hit", F.from_json("_row", schema).alias("_row")).select("start", "end", "cap_hit", "_row.*")


def censored(spark: SparkSession, path: str) -> DataFrame:
    """(start, end) of windows of the least width that still returned the cap."""
    return ledger(spark, path).where("status = 'done' and cap_hit").select("start", "end")
