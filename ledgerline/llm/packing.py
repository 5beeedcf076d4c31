"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest permitted length are cut into pieces of that length plus a remainder, so
no token is dropped. Remainders are dealt over shards of a bounded number of documents. The permitted lengths are
chosen jointly: a shard is laid out with every mix of them, and the cheapest layout stays. In a layout pieces go,
longest first, into the open bin that leaves the least room, else into a new bin of the length of the mix whose cost
per token that can still be put into it is least; in the end each bin shrinks to the smallest permitted length that
holds its contents. Shards only fix which documents may share a bin; every document of every shard is packed.

Defined results: null or empty text is one row with no tokens and no bin. Ties in length go by doc_id, then by
row. Null doc_ids and repeated rows are packed like any other row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_DOCS = 32_768

PACKED = ("doc_id bigint, n_tokens bigint, piece int, piece_start bigint, piece_tokens int, "
          "bin_id string, bin_start int, bin_used int, capacity int, opened_capacity int")


def bin_cost(capacity: int, overhead: float = 64.0, quadratic: float = 65_536.0) -> float:
    """What a sequence costs: a fixed part, a part per position, and attention's part per pair of positions."""
    return overhead + capacity + capacity * capacity / quadratic


def pack_lengths(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost=bin_cost) -> tuple[np.ndarray, np.ndarray, list[int], list[int], list[int]]:
    """Packs lengths given longest first: (bin of each, start of each, used, final capacity, opened capacity per bin)."""
    capacities = sorted(capacities)
    left = int(sum(lengths))
    where, start = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    opened: list[int] = []
    rooms: dict[int, list[int]] = {}  # room left -> bins with it
    mask = 0  # bit r: some open bin has room r
    costs = [(c, cost(c)) for c in capacities]
    for i, n in enumerate(lengths):
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                mask &= ~(1 << room)
        else:
            capacity = min((c for c in costs if c[0] >= n), key=lambda c: (c[1] / min(c[0], left), c[0]))[0]
            b, room = len(used), capacity
            used.append(0)
            opened.append(capacity)
        where[i], start[i] = b, used[b]
        used[b] += n
        left -= n
        room -= n
        if room:
            rooms.setdefault(room, []).append(b)
            mask |= 1 << room
    final = [next(c for c in capacities if c >= u) for u in used]
    return where, start, used, final, opened


def cheapest_layout(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost=bin_cost):
    """The layout (as of ``pack_lengths``) of least total cost over all mixes of capacities; ties go to the mix tried first, of more sizes."""
    capacities = sorted(capacities)
    longest = max(lengths, default=0)
    best = None
    for size in range(len(capacities), 0, -1):
        for mix in combinations(capacities, size):
            if mix[-1] < longest:
                continue
            where, start, used, _, opened = pack_lengths(lengths, mix, cost)
            final = [next(c for c in capacities if c >= u) for u in used]
            price = sum(map(cost, final))
            if best is None or price < best[0] - 1e-9:
                best = price, (where, start, used, final, opened)
    return best[1]


def sequences(packed: DataFrame) -> DataFrame:
    """One row per bin: bin_id, capacity, bin_used and its parts in order (bin_start, doc_id, piece, piece_start, piece_tokens); padding is what is left."""
    part = F.struct("bin_start", "doc_id", "piece", "piece_start", "piece_tokens")
    return (packed.where("bin_id is not null").groupBy("bin_id", "capacity", "bin_used")
            .agg(F.array_sort(F.collect_list(part)).alias("parts")))


def best_fit_pack(docs: DataFrame, tokens: str = "n_tokens", capacities: Sequence[int] = CAPACITIES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Packs rows (doc_id, ``tokens``): one row per piece of a document, columns as in ``PACKED``."""
    capacities, longest = sorted(capacities), max(capacities)
    items = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n_tokens"))
    shards = max(1, -(-items.count() // shard_docs))
    # the partition's number spreads rows that repeat one doc_id
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(shards)))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n_tokens"], kind="stable", na_position="last").reset_index(drop=True)
        n = rows["n_tokens"].to_numpy(np.int64)
        whole, rest = n // longest, n % longest
        order = np.argsort(-rest, kind="stable")
        order = order[rest[order] > 0]
        where, start, used, final, opened = cheapest_layout(rest[order].tolist(), capacities)
        name = f"{int(key[0])}-"
        used_a, final_a, opened_a = (np.array(x, np.int64) for x in (used, final, opened))
        parts = [pd.DataFrame({"row": order, "piece": whole[order], "piece_start": whole[order] * longest, "piece_tokens": rest[order], "bin_no": where, "bin_start": start, "bin_used": used_a[where] if len(where) else where, "capacity": final_a[where] if len(where) else where, "opened_capacity": opened_a[where] if len(where) else where})]
        full = np.repeat(np.arange(len(n)), whole)
        if len(full):
            piece = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
            parts.append(pd.DataFrame({"row": full, "piece": piece, "piece_start": piece * longest, "piece_tokens": longest, "bin_no": len(used) + np.arange(len(full)), "bin_start": 0, "bin_used": longest, "capacity": longest, "opened_capacity": longest}))
        out = pd.concat(parts, ignore_index=True)
        out["bin_id"] = name + out["bin_no"].astype("int64").astype(str)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            out = pd.concat([out, pd.DataFrame({"row": empty, "piece": 0, "piece_start": 0, "piece_tokens": 0})], ignore_index=True)
        at = out["row"].astype("int64")
        out["doc_id"] = rows["doc_id"].to_numpy()[at]
        out["n_tokens"] = n[at]
        names = [c.split()[0] for c in PACKED.split(", ")]
        for c in ("doc_id", "bin_start", "bin_used", "capacity", "opened_capacity"):
            out[c] = out[c].astype("Int64")
        return out[names]

    return sharded.groupBy("shard").applyInPandas(pack, PACKED)


def with_token_count(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_tokens: runs of non-space characters plus one end mark; 0 for null, empty or blank text."""
    words = F.size(F.split(F.trim(F.regexp_replace(F.col(text), r"[\s]+", " ")), " "))
    return docs.withColumn("n_tokens", F.when(F.coalesce(F.trim(F.regexp_replace(text, r"[\s]+", " ")), F.lit("")) == "", 0).otherwise(words + 1))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of 512 to 4096 tokens; a row per piece."""
    docs = with_token_count(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return best_fit_pack(docs.select("doc_id", "n_tokens"))
