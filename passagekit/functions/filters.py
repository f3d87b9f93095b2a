"""Passage and search-hit normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from passagekit.functions.parse import strip


def usable_passages(
    candidates: DataFrame, question: Sequence[str], text: str = "paragraph_text", asked: str | None = None
) -> DataFrame:
    """Candidates with text, at their original rank.

    A question none of whose candidates has text, or whose own text (column
    ``asked``, if given) is null or blank, keeps all of them, marked
    with ``fallback`` so that their order is used as it is. A question's
    candidates are bounded by the retrieval cut-off.
    """
    usable = F.coalesce(strip(F.col(text)) != "", F.lit(False))
    found = F.bool_or("_usable").over(W.partitionBy(*question))
    blank = F.lit(False) if asked is None else F.coalesce(strip(F.col(asked)) == "", F.lit(True))
    marked = candidates.withColumn("_usable", usable).withColumn("fallback", ~found | blank)
    return marked.where(F.col("_usable") | F.col("fallback")).drop("_usable")


def normalise_hits(
    hits: DataFrame,
    fields: Sequence[str] = ("raw_content", "content", "snippet"),
    min_chars: int = 50,
    prefix: str = "web",
) -> DataFrame:
    """External hits as result rows.

    The text is the first non-empty field; hits with fewer than ``min_chars``
    trimmed characters are dropped. ``position`` is the 0-based place in the
    response, which also gives the rank.
    """
    text = F.coalesce(*[F.nullif(F.col(name), F.lit("")) for name in fields])
    paper = F.concat(F.lit(f"{prefix}_"), F.col("position").cast("string"))
    return (
        hits.withColumn("paragraph_text", text)
        .where(F.length(strip(F.col("paragraph_text"))) >= min_chars)
        .withColumn("paper_id", paper)
        .withColumn("paragraph_id", F.concat("paper_id", F.lit("_p0")))
        .withColumn("rank", (F.col("position") + 1).cast("int"))
    )
