"""Documents to packed training sequences: five stages, each of which works on all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.llm import language_id, ngram_join, packing, pii, quality_model, shared

#: Languages are undecided below this probability; documents of undecided language, or without letters, are rejected.
MIN_LANGUAGE_SCORE = 0.4
MIN_QUALITY_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell; a missing ``lang`` is filled in."""
    labelled = language_id.label(docs, language_id.train(docs), prediction="stage_lang", score="stage_score")
    kept = labelled.filter((F.col("stage_lang") != "und") & (F.col("stage_score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "stage_lang")).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject. Without any labels of ``docs`` nothing is rejected."""
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.score(docs, model, score_column="stage_score").filter(F.col("stage_score") >= MIN_QUALITY_SCORE).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id; rows without an id all stay.

    Of rows with one id, which are one document, the row of the smallest hash over all columns stays.
    """
    first = shared.alone(spark, lambda: ngram_join.jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct())
    digest = F.xxhash64(*docs.columns)
    row = docs.select("doc_id", digest.alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("digest")).join(first, "doc_id", "left_semi")
    named = docs.withColumn("digest", digest).join(row, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind and disclosing terms by their class."""
    return pii.sanitize(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents in windows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), special=packing.SPECIAL)


STAGES = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Trained models, components and packing are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
