"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: its words, and one to three successive word *shapes*
(case, trailing punctuation, repetition of the word before). Each indicator is scaled by the log ratio of its
class-wise smoothed counts; a linear hinge-loss model is fitted to the scaled, length-normalised indicators by
dual coordinate descent, in shards of a bounded number of rows whose weights are averaged, and drawn towards
the mean weight as is usual for this model. Margins become probabilities by a logistic fit to margins that
each row gets from the other shards' weights.

Learning takes labelled rows up to ``max_rows`` (a documented bound; above it a fixed share of them chosen by
a hash of doc_id). Scoring reads every word of every text; the model's size is fixed (2 ** ``BITS`` weights).

Defined results: null and empty texts have no features and get the intercept's score. Null labels are not
learned from; doc_ids with several labels take the least. Without labels every score is 0.5; with one class
only it is that class's smoothed share. Equal texts get equal scores. Repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, table
from .langid import held_out
from .tokenizer import runs_of_bytes

BITS = 18
MAX_ROWS = 20_000
SHARD_ROWS = 4_000
THRESHOLD = 0.3
CACHE_WORDS = 400_000



def shape(word: bytes) -> bytes:
    """Case of a word's first letters and what follows them; runs of a sign count as one or three."""
    text = word.decode("utf-8", "replace")
    core = text.strip("\"'([{")
    body = core.rstrip("".join({c for c in core if not c.isalnum()}) or " ")
    tail = core[len(body):]
    kind = "n" if not body else "d" if any(c.isdigit() for c in body) else "C" if len(body) > 1 and body.isupper() else "X" if body[0].isupper() else "x" if body.islower() else "m"
    return (kind + re.sub(r"(.)\1+", r"\1\1", tail)[:4]).encode()


class Features:
    """Feature ids of texts; words met before are looked up."""

    def __init__(self, bits: int = BITS) -> None:
        self.mask, self.known = (1 << bits) - 1, {}
        self.words, self.shapes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def _number(self, new: list[bytes]) -> None:
        first = len(self.known)
        while first + len(new) > len(self.words):
            self.words, self.shapes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.words, self.shapes))
        self.words[first : first + len(new)] = [zlib.crc32(w.decode("utf-8", "replace").lower().encode()) for w in new]
        self.shapes[first : first + len(new)] = [zlib.crc32(shape(w)) for w in new]
        self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def of(self, texts: list[bytes | None]):
        """Yields the sorted distinct feature ids of each text (UTF-8)."""
        for at, end in runs_of_bytes(texts):
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            split = [(t or b"").split() for t in texts[at:end]]
            self._number(sorted({w for x in split for w in x if w not in self.known}))
            for words in split:
                n = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                w, s = self.words[n], self.shapes[n].copy()
                s[1:][w[1:] == w[:-1]] = 1  # the word before once more
                k = np.int64(1_000_003)
                two = s[:-1] * k + s[1:] if len(s) > 1 else s[:0]
                three = two[:-1] * k + s[2:] if len(s) > 2 else s[:0]
                ids = np.concatenate([w * 4, s * 4 + 1, two * 4 + 2, three * 4 + 3]).astype(np.uint64)
                ids = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                yield np.unique(ids.astype(np.int64) & self.mask)


class QualityModel:
    """Weights of the indicators, intercept, and the logistic fit of margins."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.ratio, self.weights, self.bias, self.slope, self.offset = ratio, weights, bias, slope, offset

    def score(self, ids: np.ndarray) -> float:
        margin = _margin(ids, self.ratio, self.weights, self.bias)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def _margin(ids: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float) -> float:
    x = ratio[ids]
    norm = np.sqrt((x * x).sum())
    return float((weights[ids] * x).sum() / norm) + bias if norm else bias


def dual_coordinate_descent(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-loss linear SVM in its dual, one coordinate at a time in shuffled order."""
    w, b = np.zeros(len(ratio)), 0.0
    xs = []
    for ids in rows:
        x = ratio[ids]
        norm = np.sqrt((x * x).sum())
        xs.append(x / norm if norm else x)
    alpha = np.zeros(len(rows))
    q = np.array([(x * x).sum() + 1.0 for x in xs])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            ids, x, y = rows[i], xs[i], signs[i]
            gradient = y * ((w[ids] * x).sum() + b) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[ids] += step * x
                b += step
                alpha[i] = new
    return w, b


def logistic_fit(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of Platt's fit by Newton steps, with his smoothed targets."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    theta = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-6), float(theta[1])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, shard_rows: int = SHARD_ROWS, bits: int = BITS) -> QualityModel:
    """Fits the model to ``docs`` (doc_id, text) with 0/1 labels (doc_id, ``label``)."""
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_y"))
    total = marked.count()
    share = min(1.0, max_rows / max(total, 1))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1e6)
    shards = max(3, -(-min(total, max_rows) // shard_rows))
    sample = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").select(
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.col("_y").cast("int").alias("y"), F.col(text).alias("text"))

    def featurise(batches):
        features = Features(bits)
        for batch in batches:
            ids = list(features.of(batch.column("text").cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("y"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["shard", "y", "ids"])

    rows = materialise(sample.transform(map_batches, featurise, "shard int, y int, ids array<int>"), "quality")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    size = 1 << bits
    if not sizes or len(sizes) < 2:
        n = sum(sizes.values())
        p = (sizes.get(1, 0) + 1) / (n + 2)
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(p / (1 - p))))
    counts = rows.select("y", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("y").alias("p"), F.count("*").alias("n")).toPandas()
    p, q = np.ones(size), np.ones(size)
    p[counts["id"]] += counts["p"]
    q[counts["id"]] += counts["n"] - counts["p"]
    ratio = np.log((p / (sizes[1] + 2)) / (q / (sizes[0] + 2)))
    shared = spark.sparkContext.broadcast(ratio)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("y", kind="stable")
        ids = sorted(zip(part["y"], (np.asarray(x, np.int64) for x in part["ids"]), strict=True), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
        w, b = dual_coordinate_descent([x for _, x in ids], np.array([1 if y else -1 for y, _ in ids]), shared.value)
        return pd.DataFrame({"shard": [key[0]], "b": [b], "w": [w.astype(np.float32).tobytes()]})

    fitted = rows.groupBy("shard").applyInPandas(fit, "shard int, b double, w binary").toPandas()
    weights = {r.shard: np.frombuffer(r.w, np.float32).astype(float) for r in fitted.itertuples()}
    biases = dict(zip(fitted["shard"], fitted["b"], strict=True))
    smooth = lambda w: 0.25 * w + 0.75 * np.abs(w[w != 0]).mean() if (w != 0).any() else w
    mean = lambda out=None: (smooth(np.mean([w for k, w in weights.items() if k != out], 0)), float(np.mean([b for k, b in biases.items() if k != out])))
    others = spark.sparkContext.broadcast({k: mean(k) for k in weights} if len(weights) > 1 else {k: mean() for k in weights})

    def margins(batches):
        for batch in batches:
            shard, ids = batch.column("shard").to_pylist(), batch.column("ids").to_pylist()
            out = [_margin(np.array(x, np.int64), shared.value, *others.value[k]) for k, x in zip(shard, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.float64())], names=["y", "m"])

    seen = rows.transform(map_batches, margins, "y int, m double").toPandas().sort_values(["m", "y"])
    slope, offset = logistic_fit(seen["m"].to_numpy(), seen["y"].to_numpy())
    return QualityModel(ratio, *mean(), slope, offset)


def classify(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 from ``threshold`` on), replacing columns of those names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(*[c for c in (score, predicted) if c in docs.columns])
    spec = spark.createDataFrame([], docs.schema).selectExpr("*", f"cast(null as double) as `{score}`", f"cast(null as int) as `{predicted}`").schema
    bits = int(np.log2(len(model.ratio)))

    def run(batches):
        held, features = shared.value, Features(bits)
        for batch in batches:
            scores = np.array([held.score(x) for x in features.of(batch.column(text).cast(pa.binary()).to_pylist())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=[*batch.schema.names, score, predicted])

    return docs.transform(map_batches, run, spec)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every ``documents`` text, learned from labels outside the held-out fifth."""
    docs = held_out(table(spark, sf_dir, "documents").select("doc_id", "text"), 5, 0)
    labels = held_out(table(spark, sf_dir, "labels"), 5, 0).where(~F.col("held_out")).select("doc_id", "quality")
    model = learn(docs.select("doc_id", "text"), labels)
    return classify(docs, model).select("doc_id", "held_out", "score", "predicted")
