"""From raw documents to packed training sequences, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabml.llm import mixing, packing, quality_rules, rule_ensemble, simhash
from tabml.llm.queries import THRESHOLD, quality_model, tokenizer_path
from tabml.session import materialize


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality_rules.passing(docs)


def keep_by_score(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below the threshold go. It learns from the labelled rows of
    the documents table outside the held-out fold, as the stage before has removed most bad examples."""
    return rule_ensemble.accepted(quality_model(spark, sf_dir), docs, threshold=THRESHOLD)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: texts whose five-word
    shingles overlap by 0.8 or more. SimHash joins the very near ones, prefix filtering finds all others."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, as wholes."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents, placed in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_score),
    ("near duplicates", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: tokens and hashes are beyond SQL: tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
