"""Verified question-paper links and the tables derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from passagekit.scale import stage
from passagekit.schemas import QUESTION_KEY

#: Names in results and metadata, and in the tables made from links.
LINK_NAMES = {
    "qtype": "q_type",
    "grant_year": "patent_year",
    "cpc_class": "patent_cpc",
    "cpc_section": "patent_section",
    "paper_category": "paper_cat",
}


def verified_links(
    flat: DataFrame, patents: DataFrame, papers: DataFrame, question: Sequence[str] = QUESTION_KEY
) -> DataFrame:
    """One row per question and paper with at least one yes.

    Only the yes rows are read; they are reduced to links before the attributes of ``patents`` (by
    patent_id) and ``papers`` (by paper_id) are attached. The names of the metadata
    (grant_year, cpc_class, cpc_section, paper_category, qtype) become those of the
    link tables (patent_year, patent_cpc, patent_section, paper_cat, q_type).
    """
    keys = list(dict.fromkeys(["patent_id", *question, "paper_id"]))
    yes = flat.where((F.col("contains_answer") == "Y") & F.col("paper_id").isNotNull())
    links = yes.select(*keys).distinct().join(patents, "patent_id", "left").join(papers, "paper_id", "left")
    return links.withColumnsRenamed(LINK_NAMES)


def with_field(links: DataFrame) -> DataFrame:
    """Broad field: category up to the first dot, else ``Unknown``."""
    broad = F.substring_index("paper_cat", ".", 1)
    known = F.coalesce(F.col("paper_cat"), F.lit("")) != ""
    return links.withColumn("paper_field", F.when(known, broad).otherwise("Unknown"))


def field_counts(links: DataFrame) -> DataFrame:
    """Understanding links per section and broad field."""
    chosen = with_field(links).where(
        (F.col("q_type") == "understanding") & F.col("patent_section").isNotNull()
    )
    return chosen.groupBy("patent_section", "paper_field").agg(F.count("*").alias("links"))


def link_matrix(links: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Section by broad field counts, zero-filled.

    The field names are the category vocabulary, read from the already counted
    table. With ``fields`` these become the columns; a link of any other field is
    an error, never dropped.
    """
    counts = stage(field_counts(links), "link-counts")
    found = [row.paper_field for row in counts.select("paper_field").distinct().orderBy("paper_field").collect()]
    if fields is not None and set(found) - set(fields):
        raise ValueError(f"links of fields that are not listed: {sorted(set(found) - set(fields))}")
    fields = found if fields is None else fields
    return counts.groupBy("patent_section").pivot("paper_field", list(fields)).agg(F.sum("links")).na.fill(0)


def link_matrix_norm(links: DataFrame, top_fields: int = 15, top_sections: int = 10) -> DataFrame:
    """Share of each top field within each top section.

    Unknown fields go first; both tops are taken before the joint filter.
    """
    # A link without section still counts towards the top fields.
    chosen = with_field(links).where(
        (F.col("q_type") == "understanding") & (F.col("paper_field") != "Unknown")
    )
    # Sections x fields; written because both tops and the result read it.
    counts = stage(
        chosen.groupBy("patent_section", "paper_field").agg(F.count("*").alias("links")), "link-counts"
    )
    top = lambda name, n: (
        counts.where(F.col(name).isNotNull())
        .groupBy(name).agg(F.sum("links").alias("_n"))
        .orderBy(F.desc("_n"), name)
        .limit(n)
        .select(name)
    )
    # Both tops have at most 15 and 10 rows.
    kept = counts.join(F.broadcast(top("paper_field", top_fields)), "paper_field", "left_semi").join(
        F.broadcast(top("patent_section", top_sections)), "patent_section", "left_semi"
    )
    total = F.sum("links").over(W.partitionBy("patent_section"))
    return kept.withColumn("share", F.round(F.col("links") / total, 6))


def with_lag(links: DataFrame) -> DataFrame:
    """Years between paper and patent; links without both years are dropped."""
    return links.where(F.col("patent_year").isNotNull() & F.col("paper_year").isNotNull()).withColumn(
        "lag", F.col("patent_year").cast("int") - F.col("paper_year").cast("int")
    )


def lag_histogram(links: DataFrame, low: int = -5, high: int = 29) -> DataFrame:
    """Links per unit lag bin and level; the last bin includes its right edge.

    Bins without links are present with zero for every level that occurs.
    """
    dated = with_lag(links).where(F.col("lag").between(low, high))
    slot = F.least("lag", F.lit(high - 1))
    bins = [
        F.struct(F.lit(at).alias("lag_bin"), F.count_if(slot == at).alias("links")) for at in range(low, high)
    ]
    return dated.groupBy("q_type").agg(F.array(*bins).alias("_bins")).select("q_type", F.inline("_bins"))


def lag_evolution(links: DataFrame, first: int = 2000, last: int = 2024) -> DataFrame:
    """Mean lag per patent year and level."""
    dated = with_lag(links).where(F.col("patent_year").between(first, last))
    return dated.groupBy("patent_year", "q_type").agg(F.round(F.avg("lag"), 6).alias("mean_lag"))


def level_shares(links: DataFrame) -> DataFrame:
    """Share of each level among a section's links, zero-filled.

    A column for every level that occurs.
    """
    chosen = links.where(F.col("patent_section").isNotNull())
    counts = stage(chosen.groupBy("patent_section", "q_type").agg(F.count("*").alias("links")), "level-counts")
    levels = [row.q_type for row in counts.select("q_type").distinct().orderBy("q_type").collect() if row.q_type is not None]
    # Sections x levels: a handful of rows.
    total = F.sum("links").over(W.partitionBy("patent_section"))
    shares = counts.withColumn("share", F.round(F.col("links") / total, 6))
    return shares.groupBy("patent_section").pivot("q_type", levels).agg(F.sum("share")).na.fill(0)
