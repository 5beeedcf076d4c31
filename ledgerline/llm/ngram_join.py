"""Near-duplicate documents by an exact Jaccard self-join on word shingles (T-occurrence search, DivideSkip).

Two sets of n1 and n2 shingles link when they share at least T = ceil(t/(1+t) * (n1+n2)) shingles. Sets are hashed
once, written, and read from there. As in DivideSkip the inverted lists are divided:

* Shingles with more than ``LONG`` documents have *long lists*. They are marked in a bit filter of fixed greatest
  size; a false mark only makes a short list count as long. A set is filed under the first n - ceil(t*n) + k of its
  shingles, long lists last, so linked sets share at least k filed shingles (k = ``needed``).
* *Short lists* send their ids to the sets on them. Each set merges its lists with a heap (MergeSkip): what comes
  on fewer lists than needed is skipped by bisection. A pair needs k common short lists. If both sets have filed
  all their short lists, it needs T less what the smaller number of long ones could still add, as these are counted
  in full; so documents that share a passage, but not enough, are no candidates, and their number does not grow with
  the square of a passage's spread.
* The long lists of a candidate pair are then *probed* by binary search in the other set; counts are exact, on
  64-bit shingle hashes.
* Only sets whose long lists alone can reach T may link without a short list. On each long list they are first
  compared with the list's head. Those that this leaves in different components are compared in blocks of bounded
  size, blocks of one component with none of their own. Near copies of one text thus cost about one comparison each.

Documents with equal sets are collapsed to one before. What is broadcast is the filter and has a fixed bound.
Lists send on spanning links, never all pairs of a long list.

Defined results: words are runs of characters other than space and tab to CR (bytes 9 to 13), A-Z lower-cased.
Fewer words than ``words`` make one shingle. Null, empty and blank texts have no shingles, and link with
nothing. Equal sets always link. Rows with null doc_id link with nothing and have a null component. Rows that
share a doc_id are one node with all their texts' links, and share its component; each keeps its own n_shingles.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, map_batches, materialise, table

LONG = 32
LOW = 0.4  # share of the hash range in which all lists are counted; most sets are filed there
MOST_FILTER_BITS = 1 << 26
BLOCK = 256
SHARE = 6
BUCKET_POSTINGS = 200_000
MOST_BUCKETS = 1 << 20
COUNT_KEYS = 1_000_000  # keys that a task counts before it sends the counts on
BROADCAST_CLASSES = 200_000
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 17)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, b in (("up", _BASE), ("down", inverse)):
                x = np.full(size, np.uint64(b))
                x[0] = 1
                _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def shingle_hashes(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's word shingles."""
    plain = b" ".join((text or b"").lower().split())
    if not plain:
        return np.zeros(0, np.uint64)
    letters = np.frombuffer(plain, np.uint8)
    gaps = np.flatnonzero(letters == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(letters)]])
    k = min(words, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    up, down = _powers(len(letters) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[letters] * up[: len(letters)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return np.unique(h ^ (h >> np.uint64(32)))


def _pack(keys: np.ndarray) -> bytes:
    """48-bit keys as six bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) if x else np.zeros(0, np.uint64) for x in batch.column("hashes").to_pylist()]


class Marks:
    """Marked 48-bit keys in a bit filter, two bits a key; without any, nothing is marked."""

    def __init__(self, words: np.ndarray | None = None) -> None:
        self.words = words

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        other = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return (keys % np.uint64(bits)).astype(np.int64), (other % np.uint64(bits)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if self.words is None:
            return np.zeros(len(keys), bool)
        x, y = self.places(keys, 32 * len(self.words))
        return ((self.words[x >> 5] >> (x & 31).astype(np.uint32)) & (self.words[y >> 5] >> (y & 31).astype(np.uint32)) & 1).astype(bool)


def marks_of(keys: DataFrame) -> Marks:
    """The filter of the column ``key``; about 16 bits a key, up to ``MOST_FILTER_BITS`` in all."""
    n = keys.count()
    if not n:
        return Marks()
    bits = min(MOST_FILTER_BITS, 1 << max(15, (16 * n - 1).bit_length()))

    def place(batches):
        for batch in batches:
            x = np.concatenate(Marks.places(batch.column("key").to_numpy().astype(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((x >> 5).astype(np.int32)), pa.array(np.left_shift(1, x & 31))], names=["word", "mask"])

    found = keys.transform(map_batches, place, "word int, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros(bits // 32, np.uint32)
    words[found["word"]] = found["mask"].to_numpy().astype(np.uint64).astype(np.uint32)
    return Marks(words)


def _low(hashes: np.ndarray) -> int:
    return int(np.searchsorted(hashes, np.uint64(int(LOW * 2**64))))


def long_keys(sets: DataFrame, buckets: int, percent: int, known=None) -> DataFrame:
    """Keys (first 48 bits) of the long lists, counted over all documents.

    Without ``known`` those of the low part of the hash range. With it (a broadcast ``Marks`` of these) those of
    the rest, over the sets that have too few short lists in the low part and so are filed beyond it.
    """

    most = COUNT_KEYS

    def part(h: np.ndarray) -> np.ndarray:
        at = _low(h)
        if known is None:
            return h[:at]
        return h[at:] if at - int(known.value.holds(h[:at] >> np.uint64(16)).sum()) < filed_under(len(h), percent) else h[:0]

    def count(batches):
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(np.concatenate([part(h) for h in _sets(batch)] or [np.zeros(0, np.uint64)]) >> np.uint64(16))
                size += len(held[-1])
            if not size or batch is not None and size < most:
                continue
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            to = ((keys >> np.uint64(15)) % np.uint64(buckets)).astype(np.int32)
            rows = _by_bucket(to, np.argsort(to, kind="stable"))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([_pack(keys[x]) for _, x in rows], pa.binary()),
                                              pa.array([np.minimum(n[x], 65_535).astype("<u2").tobytes() if (n[x] > 1).any() else b"" for _, x in rows], pa.binary())], names=["bucket", "keys", "n"])

    def merge(batches):
        for _, rows in _buckets(batches, ["keys", "n"]):
            parts = []
            for k, n in rows:
                k = _unpack(k)
                parts.append((k, np.frombuffer(n, "<u2").astype(np.int64) if n else np.ones(len(k), np.int64)))
                if len(parts) > 64:  # sums so far
                    parts = [_sum(parts)]
            keys, n = _sum(parts)
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > LONG].astype(np.int64))], names=["key"])

    return (sets.select("hashes").transform(map_batches, count, "bucket int, keys binary, n binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
            .transform(map_batches, merge, "key bigint"))


def _by_bucket(part: np.ndarray, order: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions) of each bucket that occurs; ``order`` sorts ``part``."""
    names, first = np.unique(part[order], return_index=True)
    edges = np.append(first, len(order))
    return [(int(b), order[edges[k] : edges[k + 1]]) for k, b in enumerate(names)]


def _buckets(batches, columns: list[str]):
    """(bucket, its rows) of batches sorted by bucket, one bucket in memory at a time."""
    bucket, rows = None, []
    for batch in batches:
        for b, *row in zip(batch.column("bucket").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if b != bucket:
                if rows:
                    yield bucket, rows
                bucket, rows = b, []
            rows.append(row)
    if rows:
        yield bucket, rows


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def least_share(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent/100 * n)."""
    return -(-n * percent // 100)


def needed(n):
    """k: how many filing keys a set of n shingles must share with a linked one that is not smaller."""
    return np.maximum(1, -(-n * SHARE // 100))


def filed_under(n: int, percent: int) -> int:
    """How many of its n shingles a set is filed under."""
    return n - int(least_share(np.int64(n), percent)) + int(needed(np.int64(n))) if n else 0


def filing_keys(hashes: np.ndarray, marks: Marks, percent: int) -> tuple[np.ndarray, int]:
    """Keys of the shingles a set is filed under (long lists last, then by hash), and its number of long lists.

    The number is -1 if short lists are left that it is not filed under.
    """
    keep = filed_under(len(hashes), percent)
    keys = hashes >> np.uint64(16)
    long = marks.holds(keys)
    held = int(long.sum())
    if long[:keep].any():
        keys = np.concatenate([keys[~long], keys[long]])
    return np.unique(keys[:keep]), held if len(hashes) - held <= keep else -1


def merge_skip(lists: list[list[int]], least: int):
    """(id, count) of the ids on at least ``least`` of the sorted lists, by a heap of the lists' heads.

    Where the smallest id is on too few, least - 1 lists skip by bisection to what the others hold next.
    """
    at = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapify(heap)
    while len(heap) >= least:
        top, out = heap[0][0], []
        while heap and heap[0][0] == top:
            out.append(heappop(heap)[1])
        if len(out) >= least:
            yield top, len(out)
            for k in out:
                at[k] += 1
        else:
            while heap and len(out) < least - 1:
                out.append(heappop(heap)[1])
            if not heap:
                return
            for k in out:
                at[k] = bisect_left(lists[k], heap[0][0], at[k])
        for k in out:
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))


def t_occurrence(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, part: np.ndarray | None = None, n: np.ndarray | None = None, held: np.ndarray | None = None, cut: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs i < j of a bounded number of sets, by DivideSkip.

    ``side`` and ``part``, if given, must differ; with ``n`` and ``held`` the smaller number held must reach T.

    Short lists (up to ``cut`` sets) are merged by counting. A pair goes on if its count could reach T when
    the shorter of the sets' long lists all held both; then its long lists are probed.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(tokens)))
    counts = np.zeros(m * m, np.int32)
    short = (lengths > 1) & (lengths <= cut)
    at, left = starts[short], lengths[short]
    for k in range(1, int(left.max(initial=1))):  # the k-th next set of each list
        for first in range(int(left.max()) - k):
            live = left > first + k
            if live.any():
                counts += np.bincount(owner[at[live] + first] * m + owner[at[live] + first + k], minlength=m * m).astype(np.int32) if live.sum() > m * m // 8 else 0
                if live.sum() <= m * m // 8:
                    np.add.at(counts, owner[at[live] + first] * m + owner[at[live] + first + k], 1)
    long = np.flatnonzero(lengths > cut)
    member = np.zeros((m, len(long)), bool)
    for column, k in enumerate(long):
        member[owner[starts[k] : starts[k] + lengths[k]], column] = True
    probed = member.sum(1)
    i, j = np.triu_indices(m, 1)
    both = sizes[i] + sizes[j]
    able = (100 + percent) * (counts[i * m + j] + np.minimum(probed[i], probed[j])) >= percent * both
    able &= sizes[i] > 0
    able &= sizes[j] > 0
    for x in (side, part):
        if x is not None:
            able &= x[i] != x[j]
    if held is not None:
        able &= (100 + percent) * np.minimum(held[i], held[j]) >= percent * (n[i] + n[j])
    i, j, both = i[able], j[able], both[able]
    shared = counts[i * m + j].astype(np.int64)
    for at in range(0, len(i), 4_096):
        s = slice(at, at + 4_096)
        shared[s] += (member[i[s]] & member[j[s]]).sum(1)
    linked = (100 + percent) * shared >= percent * both
    return i[linked], j[linked]


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component here) that connect what the pairs connect."""
    low = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    names = np.sort(ids, kind="stable")
    own = low.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            break
        low = new
    moved = np.flatnonzero(low != own)
    return ids[moved], names[low[moved]]


def _list_rows(batches, percent: int):
    """What each set (``a``) gets from the lists of a bucket: (a, list, b, need), list -1 for a head of a long one.

    ``need`` is the least number of short lists that link the pair. Lists are in order of set sizes, and a set gets
    the ids after its own that are not too large.
    """
    for _, own in _buckets(batches, ["keys", "rep", "n", "held"]):
        keys = np.concatenate([_unpack(r[0]) for r in own])
        rep = np.concatenate([np.frombuffer(r[1], "<i8") for r in own])
        n, held = (np.concatenate([np.frombuffer(r[k], "<i4") for r in own]).astype(np.int64) for k in (2, 3))
        order = np.lexsort((rep, n, keys))
        keys, rep, n, held = keys[order], rep[order], n[order], held[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        length = np.diff(np.append(start, len(keys)))
        run = np.repeat(np.arange(len(start)), length)
        size = length[run]
        least = needed(n)
        out = []
        live = np.flatnonzero((size > 1) & (size <= LONG))
        for k in range(1, LONG):  # once a set is too large, all later ones are
            live = live[live + k < len(keys)]
            live = live[run[live + k] == run[live]]
            live = live[n[live] * 100 >= percent * n[live + k]]
            if not len(live):
                break
            x, y = live, live + k
            both = np.minimum(held[x], held[y])
            need = np.where(both >= 0, np.maximum(1, -(-(n[x] + n[y]) * percent // (100 + percent)) - both), least[x])
            out.append((rep[x], run[x], rep[y], need))
        # on a long list, sets that their long lists may link form chains of not too different sizes
        able = np.flatnonzero((size > LONG) & (held >= least_share(n, percent)))
        # of two such sets the long lists of the smaller must reach T for its own size at least
        strong = (100 + percent) * held[able] >= 2 * percent * n[able]
        before = np.maximum.accumulate(np.where(strong, np.arange(len(able)), -1)) if len(able) else able
        lead = able[np.maximum(before, 0)] if len(able) else able
        able = able[strong | (before >= 0) & (run[lead] == run[able]) & (n[lead] * 100 >= percent * n[able])]
        if len(able) > 1:
            joined = (run[able[1:]] == run[able[:-1]]) & (n[able[:-1]] * 100 >= percent * n[able[1:]])
            head = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined]), np.arange(len(able)), 0))
            member = np.flatnonzero(head != np.arange(len(able)))
            out.append((rep[able[member]], np.full(len(member), -1), rep[able[head[member]]], np.zeros(len(member), np.int64)))
        if out:
            a, ls, b, need = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ls.astype(np.int32)), pa.array(b), pa.array(need.astype(np.int32))], names=["a", "list", "b", "need"])


def _merge_lists(batches):
    """Candidate pairs (a, b, dense) of rows (a, list, b, need) sorted by a, list and b."""
    tail = None
    for batch in itertools.chain(batches, [None]):
        cols = None if batch is None else [batch.column(c).to_numpy() for c in ("a", "list", "b", "need")]
        if tail is not None:
            cols = tail if cols is None else [np.concatenate(x) for x in zip(tail, cols, strict=True)]
        if cols is None or not len(cols[0]):
            continue
        a, ls, b, need = cols
        end = len(a) if batch is None else int(np.searchsorted(a, a[-1], "left"))  # the last set may go on
        tail = None if batch is None else [x[end:] for x in cols]
        found: list[tuple[int, int, bool]] = []
        edges = np.append(np.flatnonzero(np.concatenate([[True], a[1:end] != a[: end - 1]])), end) if end else [0]
        for i, j in itertools.pairwise(edges):
            own, own_lists, own_need = b[i:j], ls[i:j], need[i:j]
            heads = int(np.searchsorted(own_lists, 0))
            found += [(int(a[i]), int(x), True) for x in np.unique(own[:heads])]
            own, own_lists, own_need = own[heads:], own_lists[heads:], own_need[heads:]
            if not len(own):
                continue
            cuts = np.flatnonzero(own_lists[1:] != own_lists[:-1]) + 1
            least = int(own_need.min())
            if len(cuts) + 1 < least:
                continue
            wanted = dict(zip(own.tolist(), own_need.tolist(), strict=True))
            found += [(int(a[i]), x, False) for x, count in merge_skip([x.tolist() for x in np.split(own, cuts)], least) if count >= wanted[x]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.bool_())], names=["a", "b", "dense"])


def probe(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two sorted sets share: those of the smaller are probed for in the larger by binary search."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _sets_of(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(rid, hashes) of the sets in ``ids`` (key) and few others: what cannot be wanted is left out before the joins that decide."""
    wanted = sets.sparkSession.sparkContext.broadcast(marks_of(ids.distinct()))

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.holds(batch.column("rid").to_numpy().astype(np.uint64))))

    return sets.select("rid", "hashes").transform(map_batches, keep, "rid bigint, hashes binary")


def _verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of candidate pairs (a, b); heads of long lists, which are in many pairs, are ``b`` and joined first, in rows without sets."""

    def check(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("ha"), batch.column("hb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                linked[k] = (100 + percent) * probe(x, y) >= percent * (len(x) + len(y))
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    b = _sets_of(sets, pairs.select(F.col("b").alias("key"))).select(F.col("rid").alias("b"), F.col("hashes").alias("hb"))
    a = _sets_of(sets, pairs.select(F.col("a").alias("key"))).select(F.col("rid").alias("a"), F.col("hashes").alias("ha"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ha", "hb").transform(map_batches, check, "a bigint, b bigint")


def _verify_rest(clusters: DataFrame, components: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning links between sets of a cluster (node, component) that ``components`` (node, component) leaves apart.

    A component of more than ``BLOCK`` sets has blocks of its own, others share blocks; each two blocks meet but those
    of one component. Only pairs whose long lists can reach T are compared, all others have met on short lists.
    """
    member = (clusters.select("node", F.col("component").alias("cluster")).join(components.withColumnRenamed("component", "part"), "node", "left")
              .withColumn("part", F.coalesce("part", "node")))
    sizes = member.groupBy("cluster", "part").agg(F.count("*").alias("m"))
    apart = sizes.groupBy("cluster").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("m") < BLOCK, F.col("m")).otherwise(0)).alias("loose")).where("parts > 1")
    own = F.when(F.col("m") >= BLOCK, F.col("part")).otherwise(F.lit(-1))
    count = F.ceil(F.when(F.col("m") >= BLOCK, F.col("m")).otherwise(F.col("loose")) / BLOCK)
    of = sizes.join(apart, "cluster").withColumns({"own": own, "k": count})
    blocks = of.select("cluster", "own", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("i")).distinct()
    placed = member.join(of.select("cluster", "part", "own", "k"), ["cluster", "part"]).join(facts, F.col("node") == F.col("rid")).drop("rid")
    mine = F.when(F.col("own") >= 0, F.col("node")).otherwise(F.col("part"))
    placed = placed.withColumn("i", F.pmod(F.xxhash64(mine, F.lit(9)), F.col("k")).cast("int"))
    other = blocks.groupBy("cluster").agg(F.collect_list(F.struct("own", "i")).alias("others"))
    met = placed.join(other, "cluster").withColumn("other", F.explode("others")).where("own < 0 or own <> other.own")
    here = F.struct("own", "i")
    met = met.select("cluster", F.least(here, "other").alias("lo"), F.greatest(here, "other").alias("hi"), "own", "i", "part", "n", "held", "node")
    keys = ["cluster", "lo_own", "lo_i", "hi_own", "hi_i"]
    wanted = member.join(apart, "cluster").select(F.col("node").alias("key"))
    flat = (met.join(_sets_of(sets, wanted).withColumnRenamed("rid", "node"), "node")
            .select("cluster", F.col("lo.own").alias("lo_own"), F.col("lo.i").alias("lo_i"), F.col("hi.own").alias("hi_own"), F.col("hi.i").alias("hi_i"), "own", "i", "part", "n", "held", "node", "hashes"))
    grouped = flat.repartition(*keys).sortWithinPartitions(*keys)

    def solve(key, rows):
        ids = np.array([r[0] for r in rows], np.int64)
        part, n, held = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        side = np.array([hash(r[4]) for r in rows]) if key[1:3] != key[3:5] else None
        i, j = t_occurrence([r[5] for r in rows], percent, side, part, n, held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(ids, i, j)], names=["a", "b"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for *at, own, i, part, n, held, node, hashes in zip(*(batch.column(x).to_pylist() for x in (*keys, "own", "i", "part", "n", "held", "node", "hashes")), strict=True):
                if key != tuple(at):
                    if len(rows) > 1:
                        yield solve(key, rows)
                    key, rows = tuple(at), []
                rows.append((node, part, n, held, (own, i), np.frombuffer(hashes, np.uint64)))
        if len(rows) > 1:
            yield solve(key, rows)

    return grouped.transform(map_batches, run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, percent: int = 80, words: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, ``text``)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text).alias("text"))

    def hash_sets(batches):
        for batch in batches:
            found = [shingle_hashes(t, words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            blobs = [h.tobytes() or None for h in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array([len(h) for h in found], pa.int64()), pa.array([b and hashlib.blake2b(b, digest_size=16).digest() for b in blobs], pa.binary()), pa.array(blobs, pa.binary())], names=["doc_id", "rid", "n", "digest", "hashes"])

    # written once, so each row keeps its number
    rows = materialise(docs.transform(map_batches, hash_sets, "doc_id bigint, rid bigint, n bigint, digest binary, hashes binary"), "sets")
    sets = rows.where("digest is not null and doc_id is not null")
    buckets = min(MOST_BUCKETS, 1 << max(5, int((sets.agg(F.sum("n")).first()[0] or 0) * 0.26 / BUCKET_POSTINGS).bit_length()))
    low = materialise(long_keys(sets, buckets, percent), "long")
    low_marks = spark.sparkContext.broadcast(marks_of(low))
    rest = materialise(long_keys(sets, buckets, percent, low_marks), "long")
    marks = spark.sparkContext.broadcast(marks_of(low.unionByName(rest).distinct()))

    def file(batches):
        for batch in batches:
            found = [filing_keys(h, marks.value, percent) for h in _sets(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "rid", "n", "digest")), pa.array([h for _, h in found], pa.int64()), pa.array([_pack(k) for k, _ in found], pa.binary())], names=["doc_id", "rid", "n", "digest", "held", "keys"])

    filed = sets.transform(map_batches, file, "doc_id bigint, rid bigint, n bigint, digest binary, held bigint, keys binary")
    classes = materialise(filed.groupBy("digest").agg(F.min(F.struct("rid", "n", "held", "keys")).alias("c"), F.min("doc_id").alias("least"), F.count("*").alias("copies")).select("digest", "least", "copies", "c.*"), "classes")

    def post(batches):
        for batch in batches:
            reps, n, held = (batch.column(c).to_numpy() for c in ("rid", "n", "held"))
            keys = [_unpack(k) for k in batch.column("keys").to_pylist()]
            row = np.repeat(np.arange(len(reps)), np.array([len(k) for k in keys], np.int64))
            keys = np.concatenate(keys or [np.zeros(0, np.uint64)])
            part = ((keys >> np.uint64(15)) % np.uint64(buckets)).astype(np.int64)
            out = _by_bucket(part, np.lexsort((reps[row], part)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), *[pa.array([f(x) for _, x in out], pa.binary()) for f in (
                lambda x: _pack(keys[x]), lambda x: reps[row[x]].astype("<i8").tobytes(), lambda x: n[row[x]].astype("<i4").tobytes(), lambda x: held[row[x]].astype("<i4").tobytes())]], names=["bucket", "keys", "rep", "n", "held"])

    posted = classes.select("rid", "n", "held", "keys").transform(map_batches, post, "bucket int, keys binary, rep binary, n binary, held binary")
    received = posted.repartition(buckets, "bucket").sortWithinPartitions("bucket").transform(map_batches, lambda b: _list_rows(b, percent), "a bigint, list int, b bigint, need int")
    found = materialise(received.repartition(buckets, "a").sortWithinPartitions("a", "list", "b").transform(map_batches, _merge_lists, "a bigint, b bigint, dense boolean"), "candidates")
    links = materialise(_verify_pairs(found.select("a", "b"), sets, percent), "links")
    # a doc_id with several texts is one node
    several = sets.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    nodes = sets.join(several, "doc_id").select("doc_id", "digest").join(classes.select("digest", "rid"), "digest")
    ties = nodes.join(nodes.groupBy("doc_id").agg(F.min("rid").alias("b")), "doc_id").select(F.col("rid").alias("a"), "b")
    links = materialise(links.unionByName(ties), "links")
    components = materialise(connected_components(links), "components")
    dense = found.where("dense").select("a", "b")
    if not dense.isEmpty():
        clusters = materialise(connected_components(dense), "clusters")
        more = materialise(_verify_rest(clusters, components, classes.select("rid", "n", "held"), sets, percent), "links")
        if not more.isEmpty():
            components = materialise(connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")
    # only classes with company need a lookup
    known = classes.select("digest", "rid", "least", "copies").join(components, F.col("rid") == F.col("node"), "left").where("copies > 1 or component is not null")
    known = known.select("digest", "least", F.coalesce("component", "rid").alias("component"))
    known = materialise(known.join(known.groupBy("component").agg(F.min("least").alias("label")), "component").select("digest", "label"), "labels")
    known = F.broadcast(known) if known.count() <= BROADCAST_CLASSES else known
    return (rows.select("doc_id", "n", "digest").join(known, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every row of ``documents``."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
with recursive w as (
  select row_number() over () as i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select i, doc_id, case when len(w) = 0 then [] else list_distinct([array_to_string(w[k:k + 4], ' ') for k in range(1, greatest(len(w) - 4, 1) + 1)]) end as s from w),
e as (select i, doc_id, len(s) as n, md5(unnest(s)) as g from s where doc_id is not null),
shared as (select a.doc_id as a, b.doc_id as b, a.i as ai, b.i as bi, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.g = b.g and a.i < b.i group by 1, 2, 3, 4),
pairs as (select a, b from shared where 100 * c >= 80 * (na + nb - c)),
links as (select a, b from pairs union select b, a from pairs),
reach(node, seen) as (select a, a from links union select a, b from links union select r.node, l.b from reach r join links l on r.seen = l.a),
component as (select node, min(seen) as c from reach group by 1)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(component.c, s.doc_id) as component_id from s left join component on s.doc_id = component.node
"""
