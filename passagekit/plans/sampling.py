"""Positional sampling, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagekit.functions.ids import with_paragraph_keys
from passagekit.operators import patents, ranking
from passagekit.plans import fixtures as fx
from passagekit.plans.filters import CLASSES, _classes
from passagekit.plans.fixtures import table, with_sql
from passagekit.plans.registry import query
from passagekit.schemas import POSITION_KEY


@query("stratified_cap", """
SELECT p_brand, p_partkey, bool_and(p_size > 1) OVER (PARTITION BY p_brand) AS class_is_cs
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42' || p_partkey), p_partkey) AS place FROM part)
WHERE place <= 40""")
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("wide", F.col("p_size") > 1)
    return patents.stratified_cap(parts, "p_brand", 40, "42", "p_partkey", "wide").select(
        "p_brand", "p_partkey", "class_is_cs"
    )


@query("systematic_sample", with_sql("""
SELECT * EXCLUDE (place, total) FROM (
  SELECT patent_id, qtype, q_idx, paper_idx, para_idx, paragraph_id,
         row_number() OVER (ORDER BY patent_id, qtype, q_idx, paper_idx, para_idx) - 1 AS place,
         count(*) OVER () AS total
  FROM reviews WHERE paragraph_id IS NOT NULL)
WHERE place % (total // 250) = 0 AND place < (total // 250) * 250""", fx.REVIEWS))
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.reviews(spark, sf_dir).where(F.col("paragraph_id").isNotNull())
    return ranking.every_nth(rows.select(*POSITION_KEY, "paragraph_id"), POSITION_KEY, 250).drop("row_idx")


@query("sequential_sample", with_sql("""
SELECT patent_id, qtype, q_idx, paper_idx, para_idx, paragraph_id FROM reviews WHERE paragraph_id IS NOT NULL
ORDER BY patent_id, qtype, q_idx, paper_idx, para_idx LIMIT 250""", fx.REVIEWS))
def sequential_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 250 paragraphs in document order."""
    rows = fx.reviews(spark, sf_dir).where(F.col("paragraph_id").isNotNull())
    return ranking.first_n(rows.select(*POSITION_KEY, "paragraph_id"), POSITION_KEY, 250)


@query("shard_assign", with_sql("""
SELECT patent_id, row_idx, CAST(row_idx // ((total + 9) // 10) AS INTEGER) AS shard FROM (
  SELECT patent_id, row_number() OVER (ORDER BY patent_id) - 1 AS row_idx, count(*) OVER () AS total
  FROM (SELECT DISTINCT patent_id FROM reviews))""", fx.REVIEWS))
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.assign_shards(fx.reviews(spark, sf_dir), "patent_id", 10)


@query("class_order", with_sql("""
SELECT patent_id, cpc_sequence, cpc_class, cpc_subclass,
       row_number() OVER (ORDER BY patent_id, cpc_sequence, cpc_class, cpc_subclass) - 1 AS row_idx FROM classes""", CLASSES))
def class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.class_order(patents.inventional_classes(_classes(spark, sf_dir)))


@query("union_by_name", """
SELECT o_orderkey AS id, o_orderpriority AS kind, CAST(year(o_orderdate) AS INTEGER) AS year, NULL AS name FROM orders
UNION ALL SELECT c_custkey, c_mktsegment, NULL, c_name FROM customer""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.year("o_orderdate").alias("year")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind")
    )
    return orders.unionByName(customers, allowMissingColumns=True)


@query("distinct_rows", with_sql("SELECT * FROM classes", CLASSES))
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.inventional_classes(_classes(spark, sf_dir))


@query("id_union", with_sql("""
SELECT DISTINCT id FROM (
  SELECT paper_paragraph_id AS id FROM paragraphs
  UNION ALL SELECT corpusid || '_p' || (para_num - 1) FROM paragraphs WHERE para_num > 0
  UNION ALL SELECT corpusid || '_p' || (para_num + 1) FROM paragraphs)""", fx.PARAGRAPHS))
def id_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph ids together with their neighbours."""
    keyed = with_paragraph_keys(fx.paragraphs(spark, sf_dir).select("paper_paragraph_id"))
    around = F.array_compact(F.array("paper_paragraph_id", "prev_id", "next_id"))
    return keyed.select(F.explode(around).alias("id")).distinct()
