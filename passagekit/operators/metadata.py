"""Metadata of papers and patents, and its attachment to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagekit.scale import broadcast_if_small, left_join, top_k
from passagekit.schemas import QUESTION_KEY


def map_ids(corpus: DataFrame, targets: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """Distinct (id, foreign key) pairs of the target ids.

    Missing keys are null or empty strings. The targets are broadcast when they are
    few, so that the corpus is filtered in its scan stage.
    """
    wanted = broadcast_if_small(targets.select(id_col).distinct())
    known = corpus.where(F.col(key_col).isNotNull() & (F.col(key_col) != ""))
    return known.select(id_col, key_col).join(wanted, id_col, "left_semi").distinct()


def paper_metadata(targets: DataFrame, mapping: DataFrame, metadata: DataFrame) -> DataFrame:
    """Year and categories of every target; unknown targets keep nulls.

    ``mapping`` (paper_id, arxiv_id) should hold one key per paper; with more,
    the smallest is used. ``metadata`` is (id, categories, update_date).
    """
    single = mapping.groupBy("paper_id").agg(F.min("arxiv_id").alias("arxiv_id"))
    found = targets.select("paper_id").distinct().join(single, "paper_id", "left")
    facts = metadata.select(F.col("id").alias("arxiv_id"), "categories", "update_date")
    joined = left_join(found, facts, "arxiv_id", ["paper_id"])
    known = F.when(F.col("categories") != "", F.col("categories"))
    return joined.select(
        "paper_id",
        F.substring(F.col("update_date").cast("string"), 1, 4).alias("year"),
        F.substring_index(known, " ", 1).alias("category"),
        F.col("categories").alias("all_categories"),
        "arxiv_id",
    )


def patent_metadata(ids: list[DataFrame], patents: DataFrame) -> DataFrame:
    """Grant year, class and section of the ids found in several result sets.

    Of a patent's class rows the lowest ``cpc_sequence`` counts.
    """
    wanted = ids[0]
    for more in ids[1:]:
        wanted = wanted.union(more)
    wanted = wanted.distinct().toDF("patent_id").select(F.col("patent_id").try_cast("bigint").alias("patent_id"))
    rows = patents.join(broadcast_if_small(wanted.where(F.col("patent_id").isNotNull())), "patent_id", "left_semi")
    first = top_k(rows, ["patent_id"], [F.col("cpc_sequence"), F.col("cpc_class")], 1, "_first")
    return first.select(
        F.col("patent_id").cast("string").alias("patent_id"), "grant_year", "cpc_class", "cpc_section"
    )


def enrich(flat: DataFrame, papers: DataFrame, patents: DataFrame) -> DataFrame:
    """Attach patent fields (by patent_id) and paper fields (by paper_id).

    Questions without papers have no paper_id. ``patent_known`` says whether the
    patent was found, with or without a year.
    """
    known = patents.withColumn("patent_known", F.lit(True))
    joined = flat.join(known, "patent_id", "left").withColumn("patent_known", F.coalesce("patent_known", F.lit(False)))
    return left_join(joined, papers, "paper_id", QUESTION_KEY)


def enrichment_counts(enriched: DataFrame) -> DataFrame:
    """Enriched and total patents and paper instances.

    A patent counts as enriched when it was found. A paper instance is one paper of
    one question; it counts as enriched only when its year is known.
    """
    instance = ["patent_id", "qtype", "q_idx", "paper_idx"]
    papers = enriched.groupBy(*instance).agg(
        F.bool_or(F.col("paper_id").isNotNull()).alias("_paper"),
        F.bool_or(F.col("paper_year").isNotNull()).alias("_dated"),
        F.bool_or("patent_known").alias("_granted"),
    )
    per_patent = papers.groupBy("patent_id").agg(
        F.bool_or("_granted").alias("_granted"),
        F.count_if("_paper").alias("_papers"),
        F.count_if(F.col("_paper") & F.col("_dated")).alias("_dated"),
    )
    return per_patent.agg(
        F.count_if("_granted").alias("enriched_patents"),
        F.count("*").alias("total_patents"),
        F.sum("_dated").alias("enriched_papers"),
        F.sum("_papers").alias("total_papers"),
    )
