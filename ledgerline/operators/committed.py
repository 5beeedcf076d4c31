"""Walk-forward runs kept block by block.

Each block is a commit of its own, at a path named by what it depends on: the run's settings, and the block's window and rows. Spark's own
writer commits a block's rows and then its fit; a block counts as done when the fit's marker is there. So a run that stops
keeps all blocks that were done, a later one fits the rest, and a change of settings or data finds nothing to resume.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import Store
from ..sources.tables import materialise
from . import audit, estimate
from .estimate import Shape


def _digests(assigned: DataFrame, columns: list[str]) -> dict[int, str]:
    """A digest of each block's rows, in whatever order they come; a block without test or train rows has none."""
    row = F.xxhash64("part", *columns).cast("decimal(38,0)")
    found = assigned.groupBy("block_id").agg(F.sum(row).alias("h"), F.count("*").alias("n"), F.count(F.when(F.col("part") == "train", 1)).alias("train"), F.count(F.when(F.col("part") == "test", 1)).alias("test"))
    return {r["block_id"]: hashlib.sha256(f"{r['h']}/{r['n']}/{r['train']}".encode()).hexdigest()[:16] for r in found.collect() if r["train"] and r["test"]}  # some ten blocks


def _block(rows: DataFrame, shape: Shape, starts: int, rounds: int, seed: int, order: str, r: str, covariate: str | None, penalties: list[float], folds: int, cv_starts: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their covariate scaled, fit) of one block: the covariate's scaler and the slopes' penalty come from its train rows alone."""
    mean, std, penalty = None, None, penalties[0] if penalties else 0.0
    if covariate:
        scaler = audit.checked_scaler(rows.where("part = 'train'"), [covariate])
        mean, std = scaler[covariate]
        rows = audit.standardise_with(rows, scaler)
        if len(penalties) > 1:
            scores = estimate.choose_penalty(rows.where("part = 'train'"), shape, penalties, covariate, folds, cv_starts, rounds, "block", order, r)
            penalty = scores.where("chosen").first()["penalty"]
    fit = estimate.best_fit(estimate.fit_starts(rows.where("part = 'train'"), shape, starts, seed, rounds, penalty, "block", order, r, covariate))
    return rows, fit.withColumns({"penalty": F.lit(float(penalty)), "scaler_mean": F.lit(mean).cast("double"), "scaler_std": F.lit(std).cast("double")})


def walk_forward(assigned: DataFrame, path: str, shape: Shape, starts: int = 20, rounds: int = 150, seed: int = 42, order: str = "fecha", r: str = "r", covariate: str | None = None,
                 penalties: list[float] | None = None, folds: int = 3, cv_starts: int = 4, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows, fits) of all blocks: out-of-sample rows under each block's own fit, and the fits with penalty and scaler.

    ``assigned`` has (block_id, part); blocks without train or test rows are left out. Blocks that ``path`` holds are read, the others are
    fitted, ``at_once`` Spark jobs at a time, and committed as they end. A block's result depends on nothing else, so a resumed run gives
    the rows of one that was never stopped. ``covariate`` is a lagged column, wanted exactly if the shape has slopes; with several
    ``penalties`` one is chosen by temporal cross-validation inside each block's train rows.
    """
    spark = assigned.sparkSession
    if shape.slopes != (covariate is not None):
        raise ValueError("a lagged covariate goes with slopes, and only with them")
    grid = [float(p) for p in penalties or []]
    columns = [order, r, *([covariate] if covariate else [])]
    settings = json.dumps([shape.k, shape.student, shape.slopes, starts, rounds, seed, columns, grid, folds, cv_starts])
    run = f"{path.rstrip('/')}/run={hashlib.sha256(settings.encode()).hexdigest()[:16]}"
    rows = assigned.select("block_id", F.col("block_id").cast("string").alias("block"), "part", *columns)
    digests, store = _digests(rows, columns), Store(spark, run)
    places = {b: f"block={b}-{digest}" for b, digest in sorted(digests.items())}

    def commit(b: int) -> None:
        own, fit = _block(rows.where(F.col("block_id") == b), shape, starts, rounds, seed, order, r, covariate, grid, folds, cv_starts)
        fit = materialise(fit, "block")  # fitted once, for the rows and for the commit
        estimate.out_of_sample(own, fit, shape, "block", order, r, covariate).write.mode("overwrite").parquet(f"{run}/{places[b]}/rows")
        fit.write.mode("overwrite").parquet(f"{run}/{places[b]}/fit")

    left = [b for b in places if not store.exists(f"{places[b]}/fit/_SUCCESS")]
    if left:
        with ThreadPoolExecutor(at_once) as pool:
            jobs = [pool.submit(commit, b) for b in left]
            errors = [e for e in (j.exception() for j in jobs) if e]
        if errors:
            raise errors[0]
    if not places:
        raise ValueError("no block has train and test rows")
    read = [[spark.read.parquet(f"{run}/{p}/{part}") for p in places.values()] for part in ("rows", "fit")]
    return reduce(DataFrame.unionByName, read[0]), reduce(DataFrame.unionByName, read[1])
