"""Preparation of the patent table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from passagekit.scale import hash_sample

# Section and class codes counted as computer science.
COMPUTING_CODES = {
    "G": ["G06", "G06C", "G06F", "G06K", "G06N", "G06Q", "G11", "G11B", "G11C"],
    "H": ["H03", "H03M", "H04", "H04L", "H04W", "H05", "H05B", "H05K"],
}


class DuplicateKeyError(ValueError):
    """The right side of a many-to-one join repeats a key."""


def utility_patents(patents: DataFrame) -> DataFrame:
    # Columns that nothing uses further on.
    unused = ["patent_type", "filename", "withdrawn", "num_claims", "wipo_kind"]
    return patents.where(F.col("patent_type") == "utility").drop(*unused)


def inventional_classes(classes: DataFrame) -> DataFrame:
    kept = classes.where(F.col("cpc_type") == "inventional").drop("cpc_group", "cpc_type")
    return kept.distinct()


def flagged(predictions: DataFrame, flag: str = "flag_patent") -> DataFrame:
    return predictions.where(F.col(flag) == 1)


def flag_domain(
    df: DataFrame,
    taxonomy: Mapping[str, Sequence[str]] = COMPUTING_CODES,
    columns: Sequence[str] = ("cpc_class", "cpc_subclass"),
    name: str = "is_computer_science_patent",
) -> DataFrame:
    """True where any of the code columns holds a code of the taxonomy."""
    codes = sorted({code for members in taxonomy.values() for code in members})
    flag = F.lit(False)
    for column in columns:
        flag = flag | F.coalesce(F.col(column).isin(codes), F.lit(False))
    return df.withColumn(name, flag)


def join_many_to_one(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join that refuses a right side with repeated keys.

    The check stops at the first repeated key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    known = right
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    repeated = known.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).limit(1)
    example = repeated.collect()
    if example:
        raise DuplicateKeyError(f"right side repeats {example[0].asDict()}")
    return left.join(right, keys, how)


def patent_table(
    patents: DataFrame,
    classes: DataFrame,
    titles: DataFrame,
    abstracts: DataFrame,
    ai_flags: DataFrame,
    summaries: DataFrame,
    taxonomy: Mapping[str, Sequence[str]] = COMPUTING_CODES,
) -> DataFrame:
    """Patents with their classes, titles, abstract, flags and summary.

    Classes without title are dropped; everything else is kept. Each side
    table is joined once. Titles are unique per code pair; abstracts, flags
    and summaries are unique per patent.
    """
    titled = join_many_to_one(classes, titles.distinct(), ["cpc_class", "cpc_subclass"])
    wide = patents.join(titled, "patent_id", "left")
    wide = flag_domain(wide, taxonomy)
    for table in (abstracts, ai_flags, summaries):
        wide = join_many_to_one(wide, table, "patent_id", "left")
    return wide


def stratified_cap(
    df: DataFrame,
    by: str,
    n: int = 10_000,
    seed: str = "42",
    id_col: str = "patent_id",
    flag: str = "is_computer_science_patent",
) -> DataFrame:
    """At most ``n`` rows per class, and whether the whole class sample is flagged.

    ``n`` bounds the rows of a class that meet in the window.
    """
    sampled = hash_sample(df, n, id_col, seed, by=[by])
    whole = F.bool_and(F.coalesce(flag, F.lit(False))).over(W.partitionBy(by))
    return sampled.withColumn("class_is_cs", whole)
