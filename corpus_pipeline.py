"""From raw documents to token files: five stages, each a stored table for the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagekit.llm.common import python_batches, table, word_count
from passagekit.llm.decontaminate import without_contaminated
from passagekit.llm.mixture import contract_mix, mixed
from passagekit.llm.quality import without_rejected
from passagekit.llm.rans import token_files, vocabulary
from passagekit.llm.simhash import one_of_each
from passagekit.plans.registry import query
from passagekit.scale import stage

#: Tokens and classes have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None

# Near-duplicates of the pipeline: words of a shingle and Jaccard similarity.
SHINGLE = 5
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    python_batches(spark)
    return without_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    python_batches(spark)
    return one_of_each(docs, size=SHINGLE, similarity=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights of the sources ask."""
    python_batches(spark)
    return mixed(docs, contract_mix(docs, word_count("text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left; returns where each document lies in them."""
    python_batches(spark)
    return token_files(docs, vocabulary())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
    return docs
