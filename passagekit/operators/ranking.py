"""Ordering, grouping and positional sampling of ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from passagekit.scale import row_index


def group_by_paper(ranked: DataFrame, question: Sequence[str]) -> DataFrame:
    """Positions of papers (by best rank) and of paragraphs within a paper.

    The rows of one question are bounded by the retrieval cut-off, so all
    windows work on one shuffle by question, and on none if the rows lie so already.
    """
    within = W.partitionBy(*question, "paper_id")
    # The first window asks for the rows of a question in one place; the count is never 0.
    placed = ranked.withColumn("_rows", F.count("*").over(W.partitionBy(*question)))
    placed = placed.withColumn("_best", F.when(F.col("_rows") > 0, F.min("rank").over(within)))
    papers = W.partitionBy(*question).orderBy("_best", "paper_id")
    return (
        placed.withColumn("paper_idx", (F.dense_rank().over(papers) - 1).cast("int"))
        .withColumn("para_idx", (F.row_number().over(within.orderBy("rank")) - 1).cast("int"))
        .drop("_rows", "_best")
    )


def ordered_unique(ranked: DataFrame, question: Sequence[str], item: str = "paper_id") -> DataFrame:
    """Distinct items of a question in order of first appearance."""
    first = ranked.groupBy(*question, item).agg(F.min("rank").alias("first_rank"))
    order = W.partitionBy(*question).orderBy("first_rank", item)
    return first.withColumn("position", F.row_number().over(order).cast("int"))


def every_nth(df: DataFrame, order: Sequence[str], limit: int, total: int | None = None) -> DataFrame:
    """Systematic sample: every ⌊total/limit⌋-th row in order, ``limit`` rows."""
    indexed = row_index(df, order)
    rows = indexed.count() if total is None else total
    step = max(1, rows // limit)
    wanted = (F.col("row_idx") % step == 0) & (F.col("row_idx") < step * limit)
    return indexed.where(wanted)


#: Rows that Spark may bring together to find the first ones.
SMALL_LIMIT = 100_000


def first_n(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in order.

    For few rows each task forwards its own first ones; for many the whole table is
    placed, without bringing the result together anywhere.
    """
    if limit <= SMALL_LIMIT:
        return df.orderBy(*order).limit(limit)
    return row_index(df, order).where(F.col("row_idx") < limit).drop("row_idx")


def assign_shards(df: DataFrame, id_col: str, shards: int) -> DataFrame:
    """Contiguous, equally sized shards of the sorted distinct ids."""
    ids = row_index(df.select(F.col(id_col).cast("string").alias(id_col)).distinct(), [id_col])
    total = ids.count()
    size = max(1, -(-total // shards))
    return ids.withColumn("shard", F.floor(F.col("row_idx") / size).cast("int"))


def class_order(df: DataFrame, keys: Sequence[str] = ("patent_id", "cpc_sequence")) -> DataFrame:
    """Global order by patent and class sequence, as the 0-based ``row_idx``.

    Rows that tie are ordered by their other columns.
    """
    return row_index(df, [*keys, *[c for c in df.columns if c not in keys]])


def slice_questions(sources: Sequence[DataFrame], order: Sequence[str], skip: int, limit: int | None) -> DataFrame:
    """Rows ``skip`` to ``limit`` of the concatenated sources, in order."""
    numbered = [part.withColumn("src_order", F.lit(place)) for place, part in enumerate(sources)]
    combined = numbered[0]
    for part in numbered[1:]:
        combined = combined.unionByName(part)
    indexed = row_index(combined, ["src_order", *order])
    wanted = F.col("row_idx") >= skip
    if limit is not None:
        wanted = wanted & (F.col("row_idx") < limit)
    return indexed.where(wanted)
