"""Length profile of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagekit.operators import corpus
from passagekit.plans import fixtures as fx
from passagekit.plans.fixtures import with_sql
from passagekit.plans.registry import query


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_counts(fx.paragraphs(spark, sf_dir))


LENGTHS = "lengths AS (SELECT length(paragraph_text) AS length FROM paragraphs)"


@query("length_summary", with_sql("""
SELECT count(*) AS n, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) AS stddev,
       CAST(min(length) AS INTEGER) AS min, CAST(max(length) AS INTEGER) AS max FROM lengths""", fx.PARAGRAPHS, LENGTHS))
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_summary(fx.paragraphs(spark, sf_dir))


@query("length_quantiles", with_sql("SELECT " + ", ".join(
    f"round(quantile_cont(length, {p}), 6) AS p{round(100 * p):02d}" for p in corpus.PERCENTILES
) + " FROM lengths", fx.PARAGRAPHS, LENGTHS))
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_quantiles(_counts(spark, sf_dir))


@query("length_quantiles_approx")
def length_quantiles_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_quantiles_approx(fx.paragraphs(spark, sf_dir))


def _short_sql(limits: list[int]) -> str:
    return with_sql(" UNION ALL ".join(
        f"SELECT {n} AS threshold, CAST(count_if(length < {n}) AS BIGINT) AS n, "
        f"round(count_if(length < {n}) * 100.0 / count(*), 6) AS pct FROM lengths" for n in limits
    ), fx.PARAGRAPHS, LENGTHS)


@query("short_counts", _short_sql(corpus.SHORT_LIMITS))
def short_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.short_counts(_counts(spark, sf_dir))


@query("cdf_marks", _short_sql(corpus.CDF_LIMITS))
def cdf_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.cdf_marks(_counts(spark, sf_dir))


def _histogram_sql(name: str, condition: str) -> str:
    return f"""
SELECT '{name}' AS histogram, b.bin, round(low + b.bin * width / 100.0, 6) AS left_edge,
       round(low + (b.bin + 1) * width / 100.0, 6) AS right_edge, CAST(coalesce(f.n, 0) AS BIGINT) AS n,
       round((SELECT avg(length) FROM lengths), 6) AS mean_marker,
       round((SELECT quantile_cont(length, 0.5) FROM lengths), 6) AS median_marker
FROM (SELECT CAST(unnest(range(100)) AS INTEGER) AS bin) b
CROSS JOIN (SELECT min(length) AS low, greatest(max(length) - min(length), 1) AS width FROM lengths WHERE {condition})
LEFT JOIN (
  SELECT least((length - low) * 100 // width, 99) AS bin, count(*) AS n
  FROM lengths CROSS JOIN (SELECT min(length) AS low, greatest(max(length) - min(length), 1) AS width FROM lengths WHERE {condition})
  WHERE {condition} GROUP BY 1) f ON f.bin = b.bin"""


@query("length_histogram", with_sql(
    _histogram_sql("capped", "length <= 2000") + " UNION ALL " + _histogram_sql("zoomed", "length < 1000"),
    fx.PARAGRAPHS, LENGTHS))
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    capped = corpus.length_histogram(counts, 2000, inclusive=True).withColumn("histogram", F.lit("capped"))
    zoomed = corpus.length_histogram(counts, 1000, inclusive=False).withColumn("histogram", F.lit("zoomed"))
    return capped.unionByName(zoomed)


@query("length_cdf", with_sql("""
SELECT CAST(length AS INTEGER) AS length, n, round(sum(n) OVER (ORDER BY length) * 100.0 / sum(n) OVER (), 6) AS cum_pct
FROM (SELECT length, count(*) AS n FROM lengths GROUP BY length)""", fx.PARAGRAPHS, LENGTHS))
def length_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_cdf(_counts(spark, sf_dir))


@query("length_box", with_sql("""
SELECT count(*) AS n, round(max(q1), 6) AS q1, round(max(q2), 6) AS median, round(max(q3), 6) AS q3,
       CAST(min(length) FILTER (length >= q1 - 1.5 * (q3 - q1)) AS INTEGER) AS low_whisker,
       CAST(max(length) FILTER (length <= q3 + 1.5 * (q3 - q1)) AS INTEGER) AS high_whisker,
       (SELECT count(*) FROM lengths WHERE length > 2000) AS excluded
FROM lengths CROSS JOIN (
  SELECT quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.5) AS q2, quantile_cont(length, 0.75) AS q3
  FROM lengths WHERE length <= 2000)
WHERE length <= 2000""", fx.PARAGRAPHS, LENGTHS))
def length_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_box(_counts(spark, sf_dir))


@query("bounded_sample")
def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About two thousand paragraph lengths of the whole corpus."""
    rows = fx.paragraphs(spark, sf_dir).select("paper_paragraph_id", F.length("paragraph_text").alias("length"))
    return corpus.bounded_sample(rows, 2000)
