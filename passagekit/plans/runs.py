"""Verdict, question and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagekit.operators import scoring
from passagekit.plans import fixtures as fx
from passagekit.plans.fixtures import table, with_sql
from passagekit.plans.registry import query
from passagekit.schemas import POSITION_KEY
from passagekit.scale import shared_dir
from passagekit.streaming.incremental import read_target, run_incremental


def patent_texts(rows: DataFrame) -> DataFrame:
    return rows.select("patent_id").distinct().select(
        "patent_id",
        F.concat(F.lit("patent "), "patent_id").alias("patent_title"),
        F.lit("orders of one customer group").alias("patent_abstract"),
    )


def judged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews without verdict judged by word overlap with a short question."""
    rows = fx.reviews(spark, sf_dir)
    asked = rows.withColumn(
        "question", F.concat(F.lit("red "), F.col("q_idx").cast("string"), F.lit(" gear of supplier"))
    )
    return scoring.verify(asked, patent_texts(rows), scoring.overlap_judge(0.4))


JUDGED = """judged AS (
  SELECT patent_id, qtype, q_idx, paper_idx, para_idx, contains_answer AS old_verdict, answer AS old_answer, error AS old_error,
         paragraph_text,
         len(list_intersect(list_distinct(string_split(lower(question), ' ')), list_distinct(string_split(lower(paragraph_text), ' ')))) AS shared,
         len(list_distinct(string_split(lower(question), ' '))) AS asked
  FROM (SELECT * REPLACE ('red ' || answer_words || ' of supplier' AS question) FROM (
          SELECT *, q_idx || ' gear' AS answer_words FROM reviews WHERE paragraph_id IS NOT NULL)))"""


@query("verify_job", with_sql("""
SELECT patent_id, qtype, q_idx, paper_idx, para_idx,
       CASE WHEN old_verdict IS NOT NULL THEN old_verdict WHEN paragraph_text IS NULL THEN 'N'
            WHEN shared >= 0.4 * asked THEN 'Y' ELSE 'N' END AS contains_answer,
       CASE WHEN old_verdict IS NOT NULL THEN old_answer
            WHEN paragraph_text IS NOT NULL AND shared >= 0.4 * asked THEN 'shares ' || shared || ' of ' || asked || ' words' END AS answer,
       CASE WHEN old_verdict IS NOT NULL THEN old_error WHEN paragraph_text IS NULL THEN 'Paragraph text not found' END AS error
FROM judged""", fx.REVIEWS, JUDGED))
def verify_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_reviews(spark, sf_dir).select(*POSITION_KEY, "contains_answer", "answer", "error")


@query("question_job", """
SELECT CAST(p_partkey AS VARCHAR) AS patent_id, n AS question_id, 'What is ' || w || '?' AS question, 'remembering' AS level
FROM part, (SELECT unnest(['1', '2', '3']) AS n)
CROSS JOIN LATERAL (SELECT CASE n WHEN '1' THEN split_part(p_name, ' ', 1) WHEN '2' THEN split_part(p_name, ' ', 2) ELSE lower(p_type) END AS w)
WHERE p_size > 10 AND p_size <> 50""")
def question_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for parts not yet done; size 50 has no abstract."""
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string").alias("patent_id")
    rows = parts.select(
        key,
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("patent_title"),
        F.when(F.col("p_size") != 50, F.col("p_brand")).alias("patent_abstract"),
        F.col("p_brand").alias("cpc_class"),
    )
    repeated = rows.unionByName(rows.withColumn("cpc_class", F.lit("other")))
    done = parts.where(F.col("p_size") <= 10).select(key)
    questions, _ = scoring.generate(repeated, done, scoring.template_writer("remembering"), "remembering")
    return questions.select("patent_id", "question_id", "question", "level")


@query("incremental_verdicts", with_sql("""
SELECT patent_id, qtype, q_idx, paper_idx, para_idx,
       CASE WHEN paragraph_text IS NULL THEN 'N' WHEN shared >= 0.4 * asked THEN 'Y' ELSE 'N' END AS contains_answer,
       CASE WHEN paragraph_text IS NULL THEN 'Paragraph text not found' END AS error
FROM judged""", fx.REVIEWS, JUDGED))
def incremental_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews judged in two waves of files and a third, empty run."""
    rows = fx.reviews(spark, sf_dir).withColumn(
        "question", F.concat(F.lit("red "), F.col("q_idx").cast("string"), F.lit(" gear of supplier"))
    )
    for name in ("contains_answer", "answer", "error"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    path = shared_dir(spark, "stream")
    facts = patent_texts(rows)
    judge = lambda batch: scoring.verify(batch, facts, scoring.overlap_judge(0.4))
    run = lambda: run_incremental(spark, f"{path}/in", rows.schema, judge, f"{path}/out", f"{path}/state")
    for level in ("remembering", "understanding"):
        rows.where(F.col("qtype") == level).write.mode("append").parquet(f"{path}/in")
        run()
    run()
    return read_target(spark, f"{path}/out", rows.schema).select(*POSITION_KEY, "contains_answer", "error")
