"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a
language is the sum, over all ways to segment it into pieces, of the product of its pieces' probabilities,
computed by the forward algorithm; a text's is the product over its words (runs of letters, lower-cased).
The piece probabilities are fitted by expectation maximisation (forward-backward over the words' lattices,
each round one Spark job) from word counts of labelled rows.

Learning takes all labelled rows of a language up to ``max_docs`` of them (a documented bound; above it a
fixed share chosen by a hash of doc_id and text). Scoring covers every word of every whole text.

Defined results: null text, or text without a letter: ``und`` with score 0. Rows with null lang are not
learned from. Of more than ``MAX_LANGUAGES`` values the most frequent are learned, so that the model's size has a
bound. With nothing to learn from, everything is ``und``. Equal texts get equal results; ties between
languages go to the first in alphabetical order. The score is the posterior probability under equal priors.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialise, table
from .lattice import _UP, SCALE, VECTOR_BYTES, Vocabulary, backward, forward, lattice, load_vocabulary, word_edges, word_log_forward
from .tokenizer import VOCABULARY, runs_of_bytes

MAX_DOCS = 2_000  # labelled documents of a language that are learned from
MAX_LANGUAGES = 512
ROUNDS = 3
SMOOTHING = 0.02  # added to every piece's expected count
CACHE_WORDS = 100_000
BATCH_WORDS = 4_000  # words in one lattice

_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORDS(text.lower())


def _count_words(sample: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, word, n) over the sample; words as bytes with a space before them, counted per batch first."""

    def count(batches):
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in words_of(value):
                    seen[name, word] = seen.get((name, word), 0) + 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    return (sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null")
            .transform(map_batches, count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))


def expected_counts(vocab: Vocabulary, words: list[bytes], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the words' segmentations, weighted: one E step for one language."""
    out = np.zeros(vocab.size + 1)
    short = sorted((k for k, w in enumerate(words) if len(w) <= VECTOR_BYTES), key=lambda k: len(words[k]))
    for at in range(0, len(short), BATCH_WORDS):
        part = short[at : at + BATCH_WORDS]
        lens, steps = lattice(vocab, [words[k] for k in part])
        alpha = forward(lens, steps, probs[:, None])[:, :, 0]
        beta = backward(lens, steps, probs)
        per = weights[part] / alpha[np.arange(len(part)), lens]
        for x in steps:
            out += np.bincount(x.ids, per[x.rows] * alpha[x.rows, x.start] * (probs[x.ids] * _UP[x.ends - x.start]) * beta[x.rows, x.ends], len(out))
    log_probs = np.log(probs)
    for k, word in enumerate(words):
        if len(word) > VECTOR_BYTES:
            edges = list(word_edges(vocab, word))
            a, b = {0: 0.0}, {len(word): 0.0}
            for s, e, i in edges:
                a[e] = np.logaddexp(a.get(e, -np.inf), a[s] + log_probs[i])
            for s, e, i in reversed(edges):
                if e in b:
                    b[s] = np.logaddexp(b.get(s, -np.inf), b[e] + log_probs[i])
            for s, e, i in edges:
                if e in b:
                    out[i] += weights[k] * np.exp(a[s] + log_probs[i] + b[e] - a[len(word)])
    return out


class LanguageModel:
    """Languages (sorted) and log probabilities, one column per language; small whatever the corpus."""

    def __init__(self, vocab: Vocabulary, languages: list[str], log_probs: np.ndarray) -> None:
        self.vocab, self.languages, self.log_probs = vocab, languages, log_probs

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word in each language, all segmentations summed."""
        out = np.zeros((len(words), len(self.languages)))
        probs = np.exp(self.log_probs)
        short = sorted((k for k, w in enumerate(words) if len(w) <= VECTOR_BYTES), key=lambda k: len(words[k]))
        for at in range(0, len(short), BATCH_WORDS):
            part = short[at : at + BATCH_WORDS]
            lens, steps = lattice(self.vocab, [words[k] for k in part])
            alpha = forward(lens, steps, probs)
            out[part] = np.log(alpha[np.arange(len(part)), lens]) - (lens * np.log(SCALE))[:, None]
        for k, word in enumerate(words):
            if len(word) > VECTOR_BYTES:
                out[k] = word_log_forward(self.vocab, word, self.log_probs)
        return out


def learn(docs: DataFrame, vocab: Vocabulary, lang: str = "lang", text: str = "text", max_docs: int = MAX_DOCS, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> LanguageModel:
    """Fits a model to the rows of ``docs`` that have a language.

    What reaches the driver is one number per language and piece used: bounded by the vocabulary.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel(vocab, [], np.zeros((vocab.size + 1, 0)))
    share = spark.createDataFrame([(k, max_docs / n) for k, n in sizes.items()], "_lang string, _share double")
    draw = F.pmod(F.xxhash64(F.substring(text, 1, 200), F.length(text)), F.lit(1_000_000)) / 1e6
    sample = known.join(F.broadcast(share), known[lang] == share["_lang"]).where(draw < F.col("_share"))
    counts = materialise(_count_words(sample, lang, text), "words")
    start = np.exp(np.append(vocab.scores, vocab.fallback_score)) * np.append(vocab.usable, True)
    probs = {k: np.maximum(start / start.sum(), 1e-12) for k in languages}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vocab, probs))

        def expect(batches, shared=shared):
            v, p = shared.value
            for batch in batches:
                names, words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for name in set(names):
                    at = [k for k, x in enumerate(names) if x == name]
                    found = expected_counts(v, [b" " + words[k].encode() for k in at], n[at].astype(float), p[name])
                    ids = np.flatnonzero(found > 0)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(ids.astype(np.int32)), pa.array(found[ids])], names=["lang", "id", "n"])

        rows = counts.transform(map_batches, expect, "lang string, id int, n double").groupBy("lang", "id").agg(F.sum("n").alias("n")).toPandas()
        shared.unpersist()
        for name, part in rows.groupby("lang"):
            found = np.full(vocab.size + 1, smoothing)
            found[part["id"].to_numpy()] += part["n"].to_numpy()
            found[:-1][~vocab.usable] = 0
            probs[name] = np.maximum(found / found.sum(), 1e-12)
    return LanguageModel(vocab, languages, np.log(np.stack([probs[k] for k in languages], 1)))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability, both as new columns (replacing same names)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.vocab, model.languages, model.log_probs))
    docs = docs.drop(*[c for c in (lang_pred, score) if c in docs.columns])
    spec = spark.createDataFrame([], docs.schema).selectExpr("*", f"cast(null as string) as `{lang_pred}`", f"cast(null as double) as `{score}`").schema

    def run(batches):
        held = LanguageModel(*shared.value)
        known: dict[str, int] = {}
        table_ = np.zeros((1024, len(held.languages)))
        for batch in batches:
            texts = batch.column(text).to_pylist()
            preds, scores = [], []
            for at, end in runs_of_bytes(texts):
                if len(known) > CACHE_WORDS:
                    known = {}
                words = [words_of(t) if t else [] for t in texts[at:end]]
                new = sorted({w for x in words for w in x if w not in known})
                if new and held.languages:
                    first = len(known)
                    while first + len(new) > len(table_):
                        table_ = np.concatenate([table_, np.zeros_like(table_)])
                    table_[first : first + len(new)] = held.word_scores([b" " + w.encode() for w in new])
                    known.update(zip(new, range(first, first + len(new)), strict=True))
                for x in words:
                    if not held.languages or not any(c.isalpha() for w in x for c in w):
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    total = table_[np.fromiter(map(known.__getitem__, x), np.int64, len(x))].sum(0)
                    best = int(total.argmax())
                    preds.append(held.languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_pred, score])

    return docs.transform(map_batches, run, spec)


def held_out(docs: DataFrame, folds: int, fold: int, doc_id: str = "doc_id") -> DataFrame:
    """Adds held_out: crc32 of the doc_id as text, modulo ``folds``, is ``fold`` (null ids: false)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every ``documents`` text, learned from the rows that are not held out."""
    docs = held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), 4, 2)
    model = learn(docs.where(~F.col("held_out")).select("text", "lang"), load_vocabulary(VOCABULARY))
    found = identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
