"""Near-duplicate embeddings by E8 lattice hashing.

A unit vector is projected at random to eight dimensions in each of ``tables`` tables and decoded to the
nearest point of the E8 lattice. It is filed under that cell and the ``probes`` neighbouring cells nearest to
it. Vectors that meet in a cell are compared by their cosine in double precision. Cells of at most ``SMALL``
vectors get ids with 16-byte sketches only, whose distance rules out most pairs without loss, and send on the
pairs left, whose vectors are fetched once a pair. Larger cells get the
vectors: a pair that meets in several of them counts in the least, which both vectors' lists of large cells tell,
so they send on only sums per vector and never pairs. Cells of more than ``BLOCK`` vectors are cut into blocks, and
each two blocks meet in a group of their own: any cell is handled whole, in pieces of bounded size.

At the default cosine of 0.93, vectors of exactly that cosine meet with probability 0.989 in 64 dimensions
(measured by tests against brute force), closer ones more often.

Defined results: vectors compare only with equal, non-null labels and lengths. Null vectors, zero vectors and
those with null or non-finite components link with nothing (n_links 0, a component of their own), as do rows
with null vec_id (component and kept null). Equal vectors are linked without hashing. A repeated vec_id
counts once; rows that share a vec_id share its component. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, table

BLOCK = 2_048
SKETCH = 16  # bytes
SMALL = 16  # most vectors of a cell that sends on pairs of ids
HOT_BROADCAST = 100_000


def e8_minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: an odd sum moves the worst-rounded coordinate the other way."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer of those of D8 and of D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where(((x - a) ** 2).sum(1, keepdims=True) <= ((x - b) ** 2).sum(1, keepdims=True), a, b)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cell_keys(vectors: np.ndarray, labels: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Keys (n, tables * (1 + probes)) of the cells in which unit vectors are filed, with their labels."""
    n, d = vectors.shape
    minimal = e8_minimal()
    out = []
    for t in range(tables):
        x = vectors @ (np.random.default_rng((seed, t, d)).normal(size=(d, 8)) * scale / np.sqrt(8))
        p = nearest_e8(x)
        gain = (x - p) @ minimal.T
        near = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else np.zeros((n, 0), int)
        points = np.concatenate([p[:, None], p[:, None] + minimal[near]], 1)
        code = np.rint(points * 2).astype(np.int64).astype(np.uint64)
        h = np.full(code.shape[:2], np.uint64(t * 1_000_003 + d), np.uint64) ^ _mix(labels.astype(np.int64).astype(np.uint64))[:, None]
        for k in range(8):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + code[:, :, k])
        out.append(h.astype(np.int64))
    return np.concatenate(out, 1)


def sketches(vectors: np.ndarray, seed: int) -> np.ndarray:
    """(n, ``SKETCH``) bytes of unit vectors: their part in a random subspace, rounded."""
    n, d = vectors.shape
    basis = np.linalg.qr(np.random.default_rng((seed, 99, d)).normal(size=(d, min(d, SKETCH))))[0]
    out = np.zeros((n, SKETCH), np.int8)
    out[:, : basis.shape[1]] = np.rint(vectors @ basis * 127)
    return out


def sketch_bound(threshold: float) -> float:
    """No two unit vectors of at least this cosine have sketches further apart: projecting shortens, rounding adds half a unit a side."""
    return 127 * np.sqrt(max(2 - 2 * threshold, 0)) + np.sqrt(SKETCH) + 1e-6


def _unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _matrices(batch: pa.RecordBatch, column: str):
    """Yields (rows, matrix) for each vector length in a list column without nulls."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()[:-1]
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _group_links(ids, labels, mult, keys, blocks, vectors, cell: int, between: bool, threshold: float):
    """(ids, links counted, component) of a cell's vectors that have links which count here."""
    n = len(ids)
    left, right = [], []
    for at in range(0, n, 512):
        close = vectors[at : at + 512] @ vectors[at:].T >= threshold
        close &= labels[at : at + 512, None] == labels[None, at:]
        if between:
            close &= blocks[at : at + 512, None] != blocks[None, at:]
        i, j = np.nonzero(close)
        up = j > i
        left.append(i[up] + at)
        right.append(j[up] + at)
    i, j = np.concatenate(left), np.concatenate(right)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 8_192):
        a, b = keys[i[at : at + 8_192]], keys[j[at : at + 8_192]]
        shared = (a[:, :, None] == b[:, None, :]).any(2)
        keep[at : at + 8_192] = np.where(shared, a, np.iinfo(np.int64).max).min(1) == cell
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    count = np.bincount(i, mult[j], n) + np.bincount(j, mult[i], n)
    low = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    order = np.sort(ids, kind="stable")
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            break
        low = new
    linked = np.flatnonzero(count)
    return ids[linked], count[linked].astype(np.int64), order[low[linked]]


def _small_cells(batches, most: int, bound: float):
    """Pairs of reps that meet in a cell, of rows (cell, rep, s1, s2, big) sorted by cell, in cells of at most ``most`` rows.

    Pairs whose sketches are too far apart are none; pairs that also meet in a large cell are left to it.
    """
    tail: pa.RecordBatch | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and tail is not None:
            batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0] if batch.num_rows else tail
        last = batch is None
        batch = tail if last else batch
        tail = None
        if batch is None or not batch.num_rows:
            continue
        cell, rep = batch.column("cell").to_numpy(), batch.column("rep").to_numpy()
        end = len(cell) if last else int(np.searchsorted(cell, cell[-1], "left"))  # the last cell may go on
        if not last:
            tail = batch.slice(end)
        sketch = np.stack([batch.column(c).to_numpy() for c in ("s1", "s2")], 1).view(np.int8)
        has_big = batch.column("big").is_valid().to_numpy(zero_copy_only=False)
        out = []
        for k in range(1, most):
            i = np.flatnonzero(cell[: max(end - k, 0)] == cell[k:end])
            if not len(i):
                break
            apart = sketch[i].astype(np.float32) - sketch[i + k]
            i = i[(apart * apart).sum(1) <= bound * bound]
            both = has_big[i] & has_big[i + k]
            if both.any():
                big = batch.column("big")
                apart = np.array([not set(big[int(x)].as_py()) & set(big[int(x) + k].as_py()) for x in i[both]])
                i = np.sort(np.concatenate([i[~both], i[both][apart]]))
            x, y = rep[i], rep[i + k]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        if out:
            pairs = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _close_pairs(batches, threshold: float):
    """(rep, links, component) twice for each pair (a, b, va, vb, ma, mb) whose cosine reaches the threshold."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        close = np.zeros(len(a), bool)
        sizes = np.diff(batch.column("vb").offsets.to_numpy())
        for at, left in _matrices(batch, "va"):
            same = sizes[at] == left.shape[1]
            at, left = at[same], left[same]
            if len(at):
                starts = batch.column("vb").offsets.to_numpy()[:-1][at]
                flat = batch.column("vb").values.to_numpy(zero_copy_only=False)
                right = flat[starts[:, None] + np.arange(left.shape[1])].astype(np.float64)
                close[at] = (_unit(left) * _unit(right)).sum(1) >= threshold
        a, b, ma, mb = a[close], b[close], batch.column("ma").to_numpy()[close], batch.column("mb").to_numpy()[close]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((a, b), (mb, ma), (a, a))], names=["rep", "n", "low"])


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tables: int = 5, probes: int = 3, scale: float = 2.5, seed: int = 11, small: int = SMALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # vectors travel as they are
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"), F.col("label").cast("bigint").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    marked = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    hashed = marked.where("sound").select("vec_id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(5), "v").alias("h2"))
    classes = (hashed.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("mult"), F.min("v").alias("v")))
    classes = materialise(classes, "vectors")
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))

    def file(batches):
        for batch in batches:
            for at, matrix in _matrices(batch, "v"):
                unit = _unit(matrix)
                keys = cell_keys(unit, batch.column("label").to_numpy()[at], tables, probes, scale, seed)
                sketch = sketches(unit, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("rep").to_numpy()[at]), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), lists(keys)], names=["rep", "s1", "s2", "keys"])

    filed = materialise(classes.select("rep", "label", "v").mapInArrow(file, "rep bigint, s1 bigint, s2 bigint, keys array<bigint>").select("rep", "s1", "s2", F.array_distinct("keys").alias("keys")), "cells")
    hot = filed.select(F.explode("keys").alias("cell")).groupBy("cell").count().where(F.col("count") > small)
    hot = materialise(hot.select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("k")), "large-cells")
    hot = F.broadcast(hot) if hot.count() <= HOT_BROADCAST else hot
    big = materialise(filed.select("rep", F.explode("keys").alias("cell")).join(hot.select("cell"), "cell").groupBy("rep").agg(F.array_sort(F.collect_set("cell")).alias("big")), "in-large-cells")

    # small cells send on pairs of ids, which then meet their vectors once each
    spread = filed.join(big, "rep", "left").select("rep", "s1", "s2", "big", F.explode("keys").alias("cell")).where("big is null or not array_contains(big, cell)")
    pairs = spread.select("cell", "rep", "s1", "s2", "big").repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda b: _small_cells(b, small, sketch_bound(threshold)), "a bigint, b bigint").distinct()
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("v").alias(f"v{x}"), F.col("mult").alias(f"m{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb", "ma", "mb").mapInArrow(lambda b: _close_pairs(b, threshold), "rep bigint, n bigint, low bigint")

    # large cells get the vectors, in blocks; a pair counts in the least large cell it shares
    placed = big.join(classes.select("rep", "label", "mult", "v"), "rep").withColumn("cell", F.explode("big")).join(hot, "cell")
    block = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("k")).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    placed = placed.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "label", "mult", F.col("big").alias("keys"), "v")
    grouped = placed.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def bounds(batch):
            at = np.stack([batch.column(c).to_numpy() for c in ("cell", "lo", "hi")])
            return np.concatenate([[0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1, [batch.num_rows]]), at

        def solve(parts):
            batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
            edges, at = bounds(batch)
            out = []
            np_ = lambda c: batch.column(c).to_numpy()
            rep, label, mult, blocks = np_("rep"), np_("label"), np_("mult"), np_("block")
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            flat, start = batch.column("v").values.to_numpy(zero_copy_only=False), batch.column("v").offsets.to_numpy()
            kflat, kstart = batch.column("keys").values.to_numpy(zero_copy_only=False), batch.column("keys").offsets.to_numpy()
            for a, b in itertools.pairwise(edges):
                if b - a < 2 or len(set(sizes[a:b])) > 1:
                    continue
                d = sizes[a]
                m = _unit(flat[start[a] : start[b]].reshape(b - a, d).astype(np.float64))
                held_keys = np.diff(kstart[a : b + 1])
                keys = np.full((b - a, held_keys.max()), np.iinfo(np.int64).max)  # no cell: meets only what is no cell
                keys[np.repeat(np.arange(b - a), held_keys), np.arange(held_keys.sum()) - np.repeat(np.cumsum(held_keys) - held_keys, held_keys)] = kflat[kstart[a] : kstart[b]]
                cell, lo, hi = at[:, a]
                found = _group_links(rep[a:b], label[a:b], mult[a:b], keys, blocks[a:b], m, cell, lo != hi, threshold)
                if found:
                    out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["rep", "n", "low"])

        for batch in batches:
            if not batch.num_rows:
                continue
            edges, _ = bounds(batch)
            first = batch.slice(0, 1)
            same = bool(held) and all(held[-1].column(c)[held[-1].num_rows - 1] == first.column(c)[0] for c in ("cell", "lo", "hi"))
            if held and not same:
                yield from solve(held)
                held = []
            if len(edges) > 2:
                head = batch.slice(0, int(edges[-2]))
                yield from solve([*held, head])
                held = [batch.slice(int(edges[-2]))]
            else:
                held.append(batch)
        if held:
            yield from solve(held)

    links = materialise(grouped.mapInArrow(compare, "rep bigint, n bigint, low bigint").unionByName(near), "links")
    sums = links.groupBy("rep").agg(F.sum("n").alias("n"))
    found = connected_components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    reps = classes.select("label", "h1", "h2", "rep", "mult").join(sums, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    member = hashed.select("vec_id", "label", "h1", "h2").distinct().join(
        reps.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("c")), ["label", "h1", "h2"])
    member = member.groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    out = marked.select("vec_id", "sound").join(member, "vec_id", "left")
    component = F.when(F.col("sound"), F.coalesce("c", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("sound"), F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and kept flag of every row of ``embeddings``."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP9_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
links as (select a, b from pairs union select b, a from pairs),
n as (select a as vec_id, count(*) as n from links group by 1),
reach(node, seen) as (select a, a from links union select a, b from links union select r.node, l.b from reach r join links l on r.seen = l.a),
component as (select node, min(seen) as c from reach group by 1)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(c.c, e.vec_id) as component_id, coalesce(c.c, e.vec_id) = e.vec_id as kept
from embeddings e left join n on n.vec_id = e.vec_id left join component c on c.node = e.vec_id
"""
