"""Retrieval metrics over ranked hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Cut-offs of the reported metrics.
CUTOFFS = [1, 5, 10, 20, 50, 100]


def first_ranks(hits: DataFrame, question: str, item: str) -> DataFrame:
    """Best rank of every distinct item of a question."""
    return hits.groupBy(question, item).agg(F.min("rank").alias("first_rank"))


def unique_at_k(
    hits: DataFrame, question: str, item: str, cutoffs: Sequence[int] = CUTOFFS
) -> DataFrame:
    """Distinct items in the top k of every question.

    An item is in the top k when its best rank is, so all cut-offs come from
    one pre-aggregation instead of one distinct count each.
    """
    counts = [
        F.count_if(F.col("first_rank") <= k).alias(f"unique_at_{k}") for k in cutoffs
    ]
    return first_ranks(hits, question, item).groupBy(question).agg(*counts)


def mean_unique_at_k(per_question: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    return per_question.agg(
        F.count("*").alias("questions"),
        *[F.round(F.avg(f"unique_at_{k}"), 6).alias(f"unique_at_{k}") for k in cutoffs],
    )


def questions_per_level(questions: DataFrame, level: str = "qtype") -> DataFrame:
    return questions.groupBy(level).agg(F.count("*").alias("questions"))


def retrieval_metrics(
    questions: DataFrame,
    hits: DataFrame,
    truth: DataFrame,
    question: str,
    item: str,
    cutoffs: Sequence[int] = CUTOFFS,
) -> DataFrame:
    """Mean recall@k and MRR@k over all questions.

    ``truth`` holds (question, item) pairs. The rank of a question is the
    position of the first hit with a true item; a question without one
    counts as zero.
    """
    matched = (
        hits.join(truth.select(question, item).distinct(), [question, item], "left_semi")
        .groupBy(question)
        .agg(F.min("rank").alias("first_rank"))
    )
    ranked = questions.select(question).join(matched, question, "left")
    found = lambda k: F.coalesce(F.col("first_rank") <= k, F.lit(False))
    recall = [F.round(F.avg(F.when(found(k), 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in cutoffs]
    mrr = [
        F.round(F.avg(F.when(found(k), 1.0 / F.col("first_rank")).otherwise(0.0)), 6).alias(f"mrr_at_{k}")
        for k in cutoffs
    ]
    return ranked.agg(F.count("*").alias("questions"), *recall, *mrr)


def ann_recall(approximate: DataFrame, exact: DataFrame, question: str, item: str, k: int) -> DataFrame:
    """Share of the exact top k that the approximate top k contains."""
    near = approximate.where(F.col("rank") <= k).select(question, item, F.lit(1).alias("_hit"))
    true = exact.where(F.col("rank") <= k).select(question, item)
    return true.join(near, [question, item], "left").groupBy(question).agg(
        F.count("*").alias("expected"),
        F.count("_hit").alias("found"),
        F.round(F.count("_hit") / F.count("*"), 6).alias("overlap"),
    )


def export_topk(
    hits: DataFrame, question: str, item: str, paper: str, score: str, shown: int = 10, k: int = 100
) -> DataFrame:
    """One line per question: top ids and scores joined by ``;`` and the
    distinct papers of the top ``k`` in order. ``k`` bounds every list. Scores have
    four decimals, rounded half up from six."""
    ordered = (
        hits.where(F.col("rank") <= k)
        .groupBy(question)
        .agg(F.sort_array(F.collect_list(F.struct("rank", item, paper, score))).alias("_hits"))
    )
    line = lambda field, n: F.array_join(
        F.slice(F.transform("_hits", lambda h: h[field].cast("string")), 1, n), ";"
    )
    four = lambda h: F.round(h[score].cast("decimal(18,6)"), 4).cast("decimal(18,4)").cast("string")
    scores = F.array_join(F.slice(F.transform("_hits", four), 1, shown), ";")
    papers = F.array_distinct(F.transform("_hits", lambda h: h[paper].cast("string")))
    return ordered.select(
        question,
        line(item, shown).alias("top_ids"),
        scores.alias("top_scores"),
        F.array_join(papers, ";").alias("papers"),
    )
