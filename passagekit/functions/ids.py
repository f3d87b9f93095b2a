"""Paragraph-id and numeric-id expressions."""

from pyspark.sql import Column, DataFrame, functions as F


def paper_id(paragraph_id: str | Column) -> Column:
    """``'2510268_p5' -> '2510268'``."""
    return F.substring_index(paragraph_id, "_", 1)


def paragraph_number(paragraph_id: str | Column) -> Column:
    """``'2510268_p5' -> 5``; null when there is no number."""
    return F.get(F.split(paragraph_id, "_p"), F.lit(1)).try_cast("int")


def with_paragraph_keys(df: DataFrame, column: str = "paper_paragraph_id") -> DataFrame:
    """Add paper id, number and the neighbouring ids of a paragraph id.

    Paragraph 0 has no predecessor; a malformed id has no neighbours.
    """
    keyed = df.withColumn("paper_id", paper_id(column)).withColumn(
        "para_num", paragraph_number(column)
    )
    neighbour = lambda step: F.concat("paper_id", F.lit("_p"), (F.col("para_num") + step).cast("string"))
    return keyed.withColumn("prev_id", F.when(F.col("para_num") > 0, neighbour(-1))).withColumn(
        "next_id", neighbour(1)
    )


def numeric_ids(df: DataFrame, column: str) -> DataFrame:
    """Drop ids that start with a non-digit and cast the rest to long.

    An id that starts with a digit but is no number becomes null, so that a
    caller can count it.
    """
    return df.where(~F.col(column).rlike("^[^0-9]")).withColumn(
        column, F.col(column).try_cast("bigint")
    )


def with_date_parts(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Year, month and ``yyyy-MM`` of a date column."""
    return (
        df.withColumn(f"{prefix}year", F.year(column))
        .withColumn(f"{prefix}month", F.month(column))
        .withColumn(f"{prefix}year_month", F.date_format(column, "yyyy-MM"))
    )
