"""Structured Streaming forms: windowed counts, first-seen rows and fields, carried decay and filter states.

Carried states are keyed values of ``transformWithState`` in the RocksDB store. Each has a timer in event time: a key that has been quiet
for longer than ``quiet`` loses its state when the watermark passes, so the store holds live keys only. Rows at or before a key's last
time come too late for a recursion that runs forward; each operator says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import kernels
from ..functions.kernels import Params

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Days by which numeric times are moved, as a stream takes nothing at or before the first watermark, which is 1970.
SHIFT = 40_000


def window_counts(events: DataFrame, ts: str = "ts", width: str = "15 minutes", late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """(key, start, n) per window; rows later than the watermark are dropped, as any watermark does."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def first_seen(events: DataFrame, url: str = "url", ts: str = "ts", late: str = "2 days") -> DataFrame:
    """The first row of each url within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([url])


class _Carried(StatefulProcessor):
    """A value a key, dropped by a timer ``quiet`` days after the key's last time."""

    def __init__(self, kind: str, quiet: float) -> None:
        self.kind, self.quiet = kind, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("carried", self.kind)

    def keep(self, value: tuple, last_ms: int) -> None:
        """Stores the value; the one timer of the key moves on."""
        self.value.update(value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last_ms + self.quiet * DAY_MS))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        yield from ()

    def close(self) -> None:
        pass


def _frames(rows) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


class _Decay(_Carried):
    def __init__(self, beta: float, quiet: float) -> None:
        super().__init__("t double, a double", quiet)
        self.beta = beta

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t, a = self.value.get() if self.value.exists() else (None, 0.0)
        frame = _frames(rows)
        ts, s = frame["t"].to_numpy(float), frame["s"].to_numpy(float)
        last = float(max(ts.max(), t if t is not None else -np.inf))
        a = (a * np.exp(-self.beta * (last - t)) if t is not None else 0.0) + float((s * np.exp(-self.beta * (last - ts))).sum())
        self.keep((last, float(a)), int((last + SHIFT) * DAY_MS))
        yield pd.DataFrame({"key": [key[0]], "t": [last], "a": [float(a)]})


def decay_state(events: DataFrame, beta: float, key: str = "key", late: str = "0 seconds", quiet: float | None = None) -> DataFrame:
    """(key, t, a) after each micro-batch: sum of s exp(-beta (t - t_j)) at the key's last event; t in days since any origin.

    Rows of a key older than its last seen time are folded in at their age; nothing is aggregated again. A key is dropped ``quiet``
    days after its last event: by default when all of its mass has decayed below 1e-12 of itself.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col("t").cast("double").alias("t"), F.col("s").cast("double").alias("s")).where("t is not null and s is not null")
    timed = rows.withColumn("ts", F.timestamp_micros(((F.col("t") + SHIFT) * 1000 * DAY_MS).cast("bigint"))).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(_Decay(beta, 28.0 / beta if quiet is None else quiet), "key string, t double, a double", "update", "eventtime")


class _Filter(_Carried):
    def __init__(self, params: Params, quiet: float) -> None:
        super().__init__("day date, r double, s2 array<double>, xi array<double>", quiet)
        self.params = params

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.value.get() if self.value.exists() else None
        day, state = (held[0], (held[1], np.asarray(held[2], float), np.asarray(held[3], float))) if held else (None, None)
        out = []
        for now, r in _frames(rows).sort_values("fecha")[["fecha", "r"]].itertuples(index=False):
            if day is not None and now <= day:
                continue
            s2, predicted, filtered, ll = kernels.filter_step(self.params, float(r), state)
            day, state = now, (float(r), s2, filtered)
            out.append((key[0], now, float(r), *map(float, predicted), *map(float, filtered), ll))
        if out:
            self.keep((day, state[0], [float(x) for x in state[1]], [float(x) for x in state[2]]), int(pd.Timestamp(day).value // 1_000_000 + SHIFT * DAY_MS))
            k = range(len(state[1]))
            yield pd.DataFrame(out, columns=["asset", "fecha", "r", *[f"xi_p_{i}" for i in k], *[f"xi_f_{i}" for i in k], "loglik"])


def filter_state(returns: DataFrame, params: Params, key: str = "asset", day: str = "fecha", r: str = "r", late: str = "0 seconds", quiet: float = 400.0) -> DataFrame:
    """Each day's predicted and filtered probabilities and log likelihood, as the batch filter gives them, for a stream of daily returns.

    A key carries its last return, variances and probabilities across batches. Days at or before the key's last are left
    out: a day once filtered is final. Null days or returns are left out. A key quiet for ``quiet`` days starts anew.
    """
    if params.B is not None:
        raise ValueError("covariate-driven transitions are not carried")
    k = range(len(params.mu))
    rows = returns.select(F.col(key).cast("string").alias("asset"), F.col(day).cast("date").alias("fecha"), F.col(r).cast("double").alias("r")).where("fecha is not null and r is not null")
    timed = rows.withColumn("ts", F.timestamp_micros((F.unix_date("fecha") + SHIFT).cast("bigint") * (1000 * DAY_MS))).withWatermark("ts", late)
    schema = ", ".join(["asset string, fecha date, r double", *[f"xi_p_{i} double" for i in k], *[f"xi_f_{i} double" for i in k], "loglik double"])
    return timed.groupBy("asset").transformWithStateInPandas(_Filter(params, quiet), schema, "append", "eventtime")


class _FirstFields(_Carried):
    def __init__(self, keys: list[str], fields: list[str], captured: str, quiet: float) -> None:
        super().__init__(", ".join(f"{c}_at double, {c} double" for c in fields), quiet)
        self.keys, self.fields, self.captured = keys, fields, captured

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.value.get()) if self.value.exists() else [None] * (2 * len(self.fields))
        frame = _frames(rows)
        for k, c in enumerate(self.fields):
            own = frame.dropna(subset=[c])
            if len(own):
                first = own.loc[own[self.captured].idxmin()]
                if held[2 * k] is None or first[self.captured] < held[2 * k]:
                    held[2 * k], held[2 * k + 1] = float(first[self.captured]), float(first[c])
        self.keep(tuple(held), int(frame[self.captured].max() * 1000))
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, **{c: [held[2 * k + 1]] for k, c in enumerate(self.fields)}})


def first_non_null_state(captures: DataFrame, keys: list[str], fields: list[str], captured: str = "captured_at", late: str = "0 seconds", quiet: float = 30.0) -> DataFrame:
    """Per key and batch, the earliest-captured non-null value of each double field so far: later captures never rewrite.

    ``captured`` is in seconds. A key that no capture has named for ``quiet`` days is final, and its state goes.
    """
    schema = ", ".join([f"{k} string" for k in keys] + [f"{c} double" for c in fields])
    rows = captures.select(*[F.col(k).cast("string").alias(k) for k in keys], *[F.col(c).cast("double").alias(c) for c in fields], F.col(captured).cast("double").alias(captured)).where(F.col(captured).isNotNull())
    timed = rows.withColumn("ts", F.timestamp_micros((F.col(captured) * 1e6).cast("bigint"))).withWatermark("ts", late)
    return timed.groupBy(*keys).transformWithStateInPandas(_FirstFields(keys, fields, captured, quiet), schema, "update", "eventtime")


def use_state_store(spark: SparkSession) -> None:
    """The carried states need the RocksDB store; a session that has chosen another keyed store with timers keeps it."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, into parquet below ``path``, and reads the result."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
