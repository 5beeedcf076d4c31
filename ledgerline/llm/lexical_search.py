"""Ranked lexical search on a clustered index: recursive graph bisection, shards visited by their bounds, exact stopping.

*Order.* Documents and terms are a bipartite graph. It is bisected recursively so that the terms' lists become dense on
one side (the gain of moving a document is what the logarithmic gaps of its terms' lists lose). The bisection is
fitted on about ``FIT_DOCS`` documents, a Spark job a level and a task a node; each node leaves a weight a term and a
threshold. Every document then walks down the tree, which numbers documents by the leaf they reach.

*Index.* A leaf is cut into shards of some ``SHARD_POSTINGS`` postings, so a leaf that holds a third of all rows is many shards. A shard is a row:
its documents, its terms' lists and each list's highest impact.

*Search.* A query's bound in a shard is the sum of its terms' weights times the highest impacts. Queries visit shards by falling
bound, in rounds; a shard whose bound is below a query's tenth score can't change its result, one whose bound equals
it may (ties go to smaller doc_ids) and is visited. So results are exact, whatever the order was worth; shard-local numbers become doc_ids before ranking.

Queries come in blocks of bounded size, each a pass over the documents that indexes the terms it asks for.

Defined results: null text has no terms; documents without terms count in no statistic. Rows with null doc_id count in
the statistics and are never returned. Repeated documents or queries are rows of their own. No documents or no terms: no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, map_batches, materialise, table

FIT_DOCS = 16_384
FIT_TERMS = 8_192
FIT_ROUNDS = 20
MAX_DEPTH = 8
LEAF_DOCS = 2_048
SHARD_POSTINGS = 400_000
BLOCK_WORDS = 200_000
BLOCK_ITEMS = 1_024
WINDOW_BYTES = 1 << 20
#: Shards a query visits in the first round; each round visits so many times more.
FIRST_VISITS = 8
BROADCAST_VISITS = 1_000_000

#: Bytes that are part of a term (digits, letters, all of the higher code points), A-Z lowered; others part terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms in their order, in lists of bounded size (a window of the text each)."""
    start = 0
    while start < len(text):
        piece = text[start : start + WINDOW_BYTES].translate(_BYTES)
        while start + len(piece) < len(text) and (cut := piece.rfind(b" ")) < 0:  # a term longer than the window
            piece += text[start + len(piece) : start + len(piece) + WINDOW_BYTES].translate(_BYTES)
        if start + len(piece) < len(text):
            piece = piece[: cut + 1]
        yield piece.split()
        start += len(piece)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms): each row's distinct terms, as binary."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            terms = [sorted(set().union(*_words(t))) if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    return map_batches(rows, run, "item_id bigint, terms array<binary>")


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with at least one term: all terms with repeats, and counts of the vocabulary's."""
    asked = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = asked.value
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                counts, n = Counter(), 0
                for words in _words(t.as_py() or b""):
                    n += len(words)
                    counts.update(words)
                if n:
                    mine = sorted((known[w], counts[w]) for w in counts.keys() & known.keys())
                    for column, value in zip((ids, ns, terms, tfs), (d, n, [x for x, _ in mine], [c for _, c in mine]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return map_batches(rows, run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


# --- order


def _log_cost(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> np.ndarray:
    """Bits of the gaps of lists with a and b documents on sides of n_a and n_b."""
    return a * np.log2(n_a / (a + 1)) + b * np.log2(n_b / (b + 1))


def bisect(terms: np.ndarray, rows: np.ndarray, n_rows: int, n_terms: int, rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, threshold) of one node: a document goes left where its terms' weights add up to more than the threshold.

    Documents start by halves and swap sides in pairs, by falling gain, while a pair gains.
    """
    left = np.arange(n_rows) % 2 == 0
    n_l, n_r = max(int(left.sum()), 1), max(int(n_rows - left.sum()), 1)
    for _ in range(rounds):
        a = np.bincount(terms[left[rows]], minlength=n_terms).astype(float)
        b = np.bincount(terms[~left[rows]], minlength=n_terms).astype(float)
        now = _log_cost(a, b, n_l, n_r)
        to_right = now - _log_cost(np.maximum(a - 1, 0), b + 1, n_l, n_r)
        to_left = now - _log_cost(a + 1, np.maximum(b - 1, 0), n_l, n_r)
        gain = np.bincount(rows, np.where(left[rows], to_right[terms], to_left[terms]), minlength=n_rows)
        ls, rs = np.flatnonzero(left), np.flatnonzero(~left)
        ls, rs = ls[np.argsort(-gain[ls], kind="stable")], rs[np.argsort(-gain[rs], kind="stable")]
        k = min(len(ls), len(rs))
        swaps = int((gain[ls[:k]] + gain[rs[:k]] > 1e-9).sum())
        if not swaps:
            break
        left[ls[:swaps]], left[rs[:swaps]] = False, True
    a = np.bincount(terms[left[rows]], minlength=n_terms).astype(float)
    b = np.bincount(terms[~left[rows]], minlength=n_terms).astype(float)
    now = _log_cost(a, b, n_l, n_r)
    weights = (_log_cost(a, b + 1, n_l, n_r) - _log_cost(a + 1, b, n_l, n_r)).astype(np.float32)
    weights[now == 0] = 0
    return weights, float(np.median(np.bincount(rows, weights[terms], minlength=n_rows)))


def walk(terms: np.ndarray, rows: np.ndarray, n_rows: int, tree: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf of each row: one step for each of the tree's levels (weights by node and term, thresholds by node)."""
    at = np.zeros(n_rows, np.int64)
    for weights, thresholds in tree:
        score = np.bincount(rows, weights[at[rows], terms], minlength=n_rows)
        at = 2 * at + (score <= thresholds[at])
    return at


def _level_steps(known, n_terms: int) -> tuple:
    """The two steps of a level: documents to the nodes they have reached, and the bisection of a node's documents."""

    def place(batches):
        columns, nodes = known.value
        for batch in batches:
            terms, rows = _lists(batch.column("terms"))
            terms = columns[terms]
            at = walk(terms[terms >= 0], rows[terms >= 0], batch.num_rows, nodes)
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["node", *batch.schema.names])

    def fit(part):
        terms, rows = _lists(part.column("terms"))
        terms = known.value[0][terms]
        weights, threshold = bisect(terms[terms >= 0], rows[terms >= 0], part.num_rows, n_terms)
        return pa.table({"node": part.column("node")[:1], "weights": pa.array([weights.tobytes()], pa.binary()), "threshold": pa.array([threshold])})

    return place, fit


def fit_tree(counts: DataFrame, n_docs: int, n_terms: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(fitted, tree): the tree, and for each term its column in it (-1: not fitted), from about ``FIT_DOCS`` documents.

    Of the terms the ``FIT_TERMS`` that most of these hold are fitted, so the tree is at most 255 x ``FIT_TERMS`` numbers.
    """
    spark = counts.sparkSession
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(n_docs, 1) / LEAF_DOCS))))
    fitted, tree = np.full(max(n_terms, 1), -1), []
    if not depth:
        return fitted, tree
    chosen = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIT_DOCS / n_docs))
    sample = materialise(counts.where(chosen).select("terms"), "sample")
    common = sample.select(F.explode("terms").alias("t")).groupBy("t").count().where("count > 1").orderBy(F.col("count").desc(), "t").limit(FIT_TERMS).collect()
    fitted[[r["t"] for r in common]] = np.arange(len(common))
    if not common:
        return fitted, tree
    n = len(common)
    for level in range(depth):
        place, fit = _level_steps(spark.sparkContext.broadcast((fitted, list(tree))), n)
        nodes = map_batches(sample, place, "node bigint, terms array<int>").groupBy("node").applyInArrow(fit, "node bigint, weights binary, threshold double").collect()
        weights, thresholds = np.zeros((1 << level, n), np.float32), np.zeros(1 << level)
        for r in nodes:
            weights[r["node"]], thresholds[r["node"]] = np.frombuffer(bytes(r["weights"]), np.float32), r["threshold"]
        tree.append((weights, thresholds))
    return fitted, tree


# --- index


def clustered_index(counts: DataFrame, n_docs: int, n_words: int, n_terms: int) -> DataFrame:
    """(leaf, part, doc_ids, terms, starts, docs, impacts, tops): a row a shard.

    The list of ``terms[k]`` is docs and impacts from ``starts[k]`` to ``starts[k + 1]``; ``docs`` are places in ``doc_ids``.
    """
    fitted, tree = fit_tree(counts, n_docs, n_terms)
    place, _ = _level_steps(counts.sparkSession.sparkContext.broadcast((fitted, tree)), 0)
    able = counts.where("doc_id is not null and size(terms) > 0")
    placed = materialise(map_batches(able, place, "node bigint, " + ", ".join(f"{c} {t}" for c, t in able.dtypes)).withColumnRenamed("node", "leaf"), "placed")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.sum(F.size("terms")) / SHARD_POSTINGS).alias("parts"))  # one row a leaf, 256 at most
    dealt = placed.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).select("leaf", "part", "doc_id", "n", "terms", "tfs")

    def build(part: pa.Table) -> pa.Table:
        terms, rows = _lists(part.column("terms"))
        tf = _lists(part.column("tfs"))[0].astype(np.int64)
        m = 10 + (90 * part.column("n").to_numpy() * n_docs) // n_words
        impacts = (1_000_000_000 * tf) // (1_000 * tf + 8 * m[rows])
        order = np.argsort(terms, kind="stable")
        names, starts = np.unique(terms[order], return_index=True)
        rest = {"doc_ids": part.column("doc_id").to_numpy(), "terms": names.astype(np.int32), "starts": np.append(starts, len(terms)).astype(np.int32), "docs": rows[order].astype(np.int32),
                "impacts": impacts[order].astype(np.int32), "tops": np.maximum.reduceat(impacts[order], starts).astype(np.int32)}
        return pa.table({c: part.column(c)[:1] for c in ("leaf", "part")} | {c: pa.array([v], pa.list_(pa.int64() if c == "doc_ids" else pa.int32())) for c, v in rest.items()})

    kinds = "leaf bigint, part bigint, doc_ids array<bigint>, terms array<int>, starts array<int>, docs array<int>, impacts array<int>, tops array<int>"
    return materialise(dealt.groupBy("leaf", "part").applyInArrow(build, kinds), "index")


# --- search


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, ties by id."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
    return found[np.lexsort((ids[found], -scores[found]))][:k]


def visit(index: DataFrame, visits: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each shard that is visited, each visiting query's k best."""
    asked = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        where = np.full(n_terms, -1)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, terms, starts, docs, impacts, items = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("doc_ids", "terms", "starts", "docs", "impacts", "items"))
                where[terms] = np.arange(len(terms))
                out: list[list] = [[], [], []]
                for item in items:
                    scores = np.zeros(len(ids), np.int64)
                    for t, w in zip(*asked.value[item], strict=True):
                        if (at := where[t]) >= 0:
                            some = slice(starts[at], starts[at + 1])
                            scores[docs[some]] += w * impacts[some].astype(np.int64)
                    best = _best(scores, ids, k)
                    for column, value in zip(out, (np.full(len(best), item), ids[best], scores[best]), strict=True):
                        column.append(value)
                where[terms] = -1
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["item", "doc_id", "score"])

    per_shard = visits.groupBy("leaf", "part").agg(F.collect_list("item").alias("items"))  # at most a block's items
    small = visits.count() <= BROADCAST_VISITS
    joined = index.join(F.broadcast(per_shard) if small else per_shard, ["leaf", "part"])
    return map_batches(joined.select("doc_ids", "terms", "starts", "docs", "impacts", "items"), run, "item bigint, doc_id bigint, score bigint")


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) of the given (item_id, terms); None if nothing is found."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    if not vocabulary:
        return None
    counts = materialise(term_counts(docs, vocabulary), "counts").withColumn("row", F.monotonically_increasing_id())
    n_docs, n_words = counts.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    index = clustered_index(counts, n_docs, n_words, len(vocabulary))
    lists = index.select("leaf", "part", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tops").alias("top"))).alias("x")).select("leaf", "part", "x.term", "x.top")
    # a row with null doc_id has no place in the index, but counts
    found = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most the vocabulary
    weight = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1))) for r in found}
    asked = [[(x, weight[x]) for x in sorted(vocabulary[t] for t in terms) if weight.get(x)] for _, terms in items]
    pairs = [(i, x, w) for i, terms in enumerate(asked) for x, w in terms]
    if not pairs:
        return None
    queries = [(np.array([x for x, _ in terms], int), np.array([w for _, w in terms], np.int64)) for terms in asked]
    wanted = spark.createDataFrame(pairs, "item bigint, term int, w bigint")
    bounds = lists.join(F.broadcast(wanted), "term").groupBy("item", "leaf", "part").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    falling = Window.partitionBy("item").orderBy(F.col("bound").desc(), "leaf", "part")
    bounds = materialise(bounds.withColumn("place", F.row_number().over(falling)), "bounds")
    last = bounds.agg(F.max("place")).first()[0] or 0
    ranks = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    best, done, until = None, 0, FIRST_VISITS
    while done < last:
        ahead = bounds.where((F.col("place") > done) & (F.col("place") <= until))
        if best is not None:
            least = best.where(F.col("rank") == k).select("item", F.col("score").alias("least"))  # one row an item of the block
            ahead = ahead.join(F.broadcast(least), "item", "left").where("least is null or bound >= least")
        ahead = materialise(ahead.select("item", "leaf", "part"), "visits")
        if ahead.isEmpty():
            break  # bounds fall, so all that are left are lower still
        new = visit(index, ahead, queries, len(vocabulary), k)
        new = new if best is None else new.unionByName(best.select("item", "doc_id", "score"))
        best = materialise(new.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k), "best")
        done, until = until, 8 * until
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item bigint, item_id bigint")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank, doc_id, score.

    Items are dealt into blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` terms, by hash; each block is a pass over ``docs``.
    """
    spark = docs.sparkSession
    terms = materialise(item_terms(items), "items").withColumn("row", F.monotonically_increasing_id())
    n, words = terms.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-(words or 0) // BLOCK_WORDS))
    out = None
    for b in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("item_id", "terms").collect()
        part = _search_block(docs, [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in block], k)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best ``documents`` of every ``benchmark`` item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(upper=ASCII_UPPER, lower=ASCII_LOWER)

OP12_SQL = f"""
with d as (select row_number() over () r, doc_id, {_TERMS} ws from documents),
c as (select count(*) n, sum(len(ws))::bigint l from d where len(ws) > 0),
q as (select row_number() over () i, item_id, list_distinct({_TERMS}) ws from benchmark),
qt as (select i, item_id, unnest(ws) t from q),
tf as (select r, doc_id, len(ws)::bigint n, unnest(ws) t from d),
tfs as (select r, doc_id, n, t, count(*)::bigint tf from tf where t in (select t from qt) group by 1, 2, 3, 4),
df as (select t, count(*) df from tfs group by t),
w as (select t, floor(1000 * ln((2 * c.n + 2) / (2 * df + 1)))::bigint w from df, c),
s as (
  select i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * tfs.n * c.n) // c.l)))))::bigint score
  from tfs join w using (t) join qt using (t), c where doc_id is not null group by 1, 2, 3, 4)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by i order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
"""
