"""Shards that all have the mixture of the whole: proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked. Row k of n of a source
gets the fraction (2 k + 1) / 2 n, all rows are sorted by their fractions, and the order
is cut into shards of equal length. A run of the order holds each source in proportion,
give or take one row, so every shard and every prefix of a shard matches the mixture.

Both ranks come from a range-partitioned sort and one offset per partition: a source that
holds most of the rows is spread over many tasks. DataFrame functions only.

Defined results: a null source is a source of its own; rows that agree in all columns of
``by`` are told apart by nothing and stand next to each other; null text has no bytes;
more shards than rows leave some shards empty; an empty table gives no rows; columns that
have the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagekit.llm.common import CRC_STEPS_SQL, crc32_sql, table, text_of
from passagekit.plans.registry import query
from passagekit.scale import broadcast_if_small, row_index, stage

# Fixed values of the result contract.
SHARDS = 40
ROW_BYTES = 16
LAW = "rows"

SEED = "shards-1"


def seeded_hash(columns: Sequence[Column], seed: str) -> Column:
    """MD5 of the seed and all columns; null is a dash."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns]))


def source_key(column: str | Column) -> Column:
    """The source as a string that is never null: null first, then by code point."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def interleaved(
    docs: DataFrame, shards: int = SHARDS, source_col: str = "source", by: Sequence[str] | None = None, seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: the place of each row in its shard.

    Shard sizes differ by one row at most. ``by`` names the columns that the shuffle
    hashes, by default all. All columns travel through two sorts: give narrow rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = stage(docs.select(
        source_key(source_col).alias("s"), seeded_hash([F.col(c) for c in by or docs.columns], seed).alias("h"),
        F.struct(*kept).alias("row"),
    ), "shard-rows")
    ranked = row_index(rows, ["s", "h"], "at")
    # One row per source.
    sources = broadcast_if_small(ranked.groupBy("s").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    fraction = (2 * (F.col("at") - F.col("first")) + 1).cast("double") / (2 * F.col("n"))
    ordered = row_index(ranked.join(sources, "s").select("s", "h", "row", fraction.alias("f")), ["f", "h", "s"], "at")
    total = rows.count()
    shard = F.expr(f"at * {shards}L div {max(total, 1)}L")
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ordered.withColumn("shard", shard).select(
        "row.*", F.col("shard").cast("int").alias("shard"), (F.col("at") - start).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=N`` per shard, its files in the order of the slots.

    Shards are cut by ranges of slots, so a shard may be written by several tasks.
    """
    placed = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(path)


SQL = f"""
WITH {CRC_STEPS_SQL},
sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS s, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size,
         {crc32_sql("digits")} AS text_crc32
  FROM (SELECT doc_id, source, text, hex(coalesce(text, '')) AS digits FROM documents), crc_steps),
hashed AS (
  SELECT *, md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, '-'), size, text_crc32)) AS h FROM sized),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY s ORDER BY h) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY s)) AS f FROM hashed),
placed AS (SELECT *, row_number() OVER (ORDER BY f, h, s) - 1 AS place, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32, '{LAW}' AS law, (place * {SHARDS} // total)::INTEGER AS shard,
       place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""


@query("op13_sharding", SQL)
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the counts of shards differ by one at most."""
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(
        "doc_id", "source", (F.octet_length(text_of("text")) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text_of("text")).alias("text_crc32"),
    )
    placed = interleaved(narrow, by=["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
