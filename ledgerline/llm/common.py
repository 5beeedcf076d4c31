"""Helpers shared by the corpus operators: table reads, the shared work folder, connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters and their lower-case forms: the only letters the contracts lower.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Bytes of one Arrow batch between the JVM and Python. Both hold several (read, converted, written) for each running task.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where that is unset and Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.ledgerline.workdir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.ledgerline.workdir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on an Arrow batch to ``BATCH_BYTES``; a lower one stays.

    The limit is on bytes, as rows of long texts or sets differ in size by orders; a longer row is a batch of its own.
    No result depends on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(\d+)([kmg]?)", spark.conf.get(name).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Returns free memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with bounded batches, whose workers give free memory back when a task ends, Arrow's and the allocator's.

    Spark keeps idle workers for later tasks; what they hold counts beside the memory of the tasks that run.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def connected_components(links: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, component), component = smallest node reachable.

    ``links`` has bigint columns ``a`` and ``b``; only nodes that occur in a link are returned. Each round
    is one large-star and one small-star step (every node hooks its neighbours onto the smallest node it
    knows), so the rounds grow with the logarithm of a component's diameter, and every edge set is written
    to the shared folder. Null ends and self links are ignored. It ends when the edges' number and hash sum stay.
    """
    spark = links.sparkSession
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = materialise(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(small_low, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        edges = materialise(small, "cc")
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            break
        state = (seen["n"], seen["h"])
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
