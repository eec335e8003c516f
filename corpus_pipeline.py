"""A corpus pipeline of the training-data operators; each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, language, mixing, near_dup, pii
from tallyforge.llm.shared import discard, in_training, materialize, table
from tallyforge.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language scores less are rejected, as are those without letters.
LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: those whose text is null, empty or without letters too. Repeated rows stay; other columns are left out."""
    model = language.fit_languages(docs.where(in_training(F.col("doc_id"))))
    seen = language.predict_languages(docs.select(*COLUMNS), model)
    return seen.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each near-duplicate class.

    Rows go by doc_id and a hash of their text here, so that rows of one doc_id but different texts are told apart; of repeated rows one stays.
    """
    marked = docs.select(*COLUMNS).withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    classes = materialize(near_dup.near_duplicates(marked.select(F.struct("doc_id", "_h").alias("doc_id"), "text")), "classes")
    chosen = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id.doc_id", "doc_id._h").agg(F.count(F.lit(1)).alias("_n"))
    repeated = chosen.where("_n > 1").limit(1).count() > 0
    same = marked["doc_id"].eqNullSafe(chosen["doc_id"]) & (marked["_h"] == chosen["_h"])
    kept = marked.join(chosen, same, "left_semi")
    return (kept.dropDuplicates(["doc_id", "_h"]) if repeated else kept).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts stay, as do repeated rows; an empty benchmark drops nothing."""
    found = decontamination.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and counts n_chars anew where it does. Null and empty texts stay as they are, as do repeated rows."""
    found = pii.redact_private(docs.select(*COLUMNS), pii.fit_tagger(docs.select("doc_id", "text")))
    return found.withColumn("n_chars", F.when(F.col("n_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how many words to take of each document (doc_id, source, size, source_size, target, taken), those with none left out."""
    return mixing.mix_sources(docs.select(*COLUMNS), mixing.label_quality(table(spark, sf_dir, "labels"))).where(F.col("taken") > 0)


STAGES = [("language", identify_language), ("near duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("private data", redact_private), ("mixing", mix)]
#: The stages aren't expressible in SQL; tests hold language, decontamination and mixing against plain versions, and all of them against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    ship(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
        before = docs
    return docs
