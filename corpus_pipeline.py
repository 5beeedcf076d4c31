"""The corpus pipeline: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as parquet
to the shared folder and reads it again as the next stage's input. The first three stages return the columns
of their input; rows they reject are gone. The last returns one row per packed piece of a kept document.

Rows with null text are rejected by the language stage. Repeated rows stand or fall alike in the first two
stages; the near-duplicate stage keeps one row of each group, also of rows that repeat one doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import langid, ngram_join, packing, quality
from ledgerline.llm.common import fresh_path, materialise, table
from ledgerline.llm.lattice import load_vocabulary
from ledgerline.llm.tokenizer import VOCABULARY

#: A text whose best language has a lower posterior is rejected: no language stands out.
MIN_LANGUAGE_SCORE = 0.5
BROADCAST_IDS = 1_000_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language is clear; learned from the documents' own labels."""
    fold = langid.held_out(docs, 4, 2)
    model = langid.learn(fold.where(~F.col("held_out")).select("text", "lang"), load_vocabulary(VOCABULARY))
    found = langid.identify(docs, model, lang_pred="_lang_pred", score="_lang_score")
    return found.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents predicted to be of quality; learned from labels outside the held-out fifth."""
    labels = langid.held_out(table(spark, sf_dir, "labels"), 5, 0).where(~F.col("held_out")).select("doc_id", "quality")
    model = quality.learn(docs.select("doc_id", "text"), labels)
    return quality.classify(docs, model, score="_score", predicted="_predicted").where("_predicted = 1").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id.

    Null doc_ids link with nothing and stay. Of rows that repeat the kept doc_id one stays: the first by
    text, then by the other columns as JSON.
    """
    found = materialise(ngram_join.jaccard_components(docs.select("doc_id", "text")), "groups")
    gone = _small(found.where("doc_id <> component_id").select("doc_id").distinct())
    several = _small(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti")
    order = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")])))
    first = left.join(several, "doc_id", "left_semi").withColumn("_row", F.row_number().over(order)).where("_row = 1")
    return left.join(several, "doc_id", "left_anti").select(docs.columns).unionByName(first.select(docs.columns))


def _small(ids: DataFrame) -> DataFrame:
    """Ids to be broadcast up to ``BROADCAST_IDS`` of them, so that no text is shuffled; beyond that to be joined by shuffling."""
    ids = materialise(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every kept document into sequences of several permitted lengths."""
    return packing.best_fit_pack(packing.with_token_count(docs.select("doc_id", "text")).select("doc_id", "n_tokens"))


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the language model nor the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
