"""Words, names and tables shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagekit.scale import configure, shared_dir

#: Fixed values of the result contract: a word is a run of anything but these.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows and bytes of one Arrow batch. Texts may be long, so batches are kept short.
BATCH_ROWS = 1_000
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return python_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def python_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Set the session's options that the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return configure(spark)


def text_of(column: str | Column) -> Column:
    """The text as a string; null text is empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(column, UPPER, UPPER.lower())


def word_count(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it (in any case)."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name += "_"
    return name


def checkpointed(spark: SparkSession) -> SparkSession:
    """Make sure that ``checkpoint()`` has its folder."""
    shared_dir(spark, "checkpoint")
    return spark


#: SQL for ``WITH``: the 256 steps of CRC-32, made by its rule. 3988292384 is its fixed polynomial.
CRC_STEPS_SQL = """crc_steps AS (SELECT list(v ORDER BY i) AS steps FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i)))"""


def crc32_sql(digits: str) -> str:
    """SQL for the unsigned CRC-32 of bytes given as a column of hex digits; needs ``crc_steps`` beside it."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length({digits}) // 2),
           lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""
