"""Verdict statistics, method comparison, links and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagekit.operators import links, metadata, ranking, scoring, verdicts
from passagekit.plans import fixtures as fx
from passagekit.plans.fixtures import with_sql
from passagekit.plans.joins import ENRICHED, STATUS, review_facts
from passagekit.plans.registry import query
from passagekit.plans.runs import JUDGED, judged_reviews, patent_texts
from passagekit.scale import rows_kept_in_place, shuffles_dropped, stage
from passagekit.schemas import QUESTION_KEY

PER_QUESTION = """per_question AS (
  SELECT patent_id, qtype, q_idx, count(paper_id) AS paragraphs,
         count_if(coalesce(contains_answer = 'Y', FALSE)) AS yes FROM reviews GROUP BY ALL)"""


@query("verification_stats", with_sql("""
SELECT count(*) AS questions, CAST(count_if(paragraphs > 0) AS BIGINT) AS questions_with_papers,
       CAST(count_if(yes > 0) AS BIGINT) AS questions_with_yes, CAST(sum(paragraphs) AS BIGINT) AS paragraphs,
       CAST(sum(yes) AS BIGINT) AS paragraphs_with_yes,
       round(count_if(yes > 0) * 100.0 / count_if(paragraphs > 0), 6) AS pct_of_questions_with_papers,
       round(count_if(yes > 0) * 100.0 / count(*), 6) AS pct_of_questions,
       round(sum(yes) * 100.0 / sum(paragraphs), 6) AS pct_of_paragraphs
FROM per_question""", fx.REVIEWS, PER_QUESTION))
def verification_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.verification_stats(fx.reviews(spark, sf_dir))


@query("question_yes", with_sql("""
SELECT patent_id, qtype, q_idx, CAST(yes AS BIGINT) AS yes_count, yes > 0 AS has_yes FROM per_question
WHERE paragraphs > 0""", fx.REVIEWS, PER_QUESTION))
def question_yes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.question_yes(fx.reviews(spark, sf_dir))


@query("run_report", with_sql("""
SELECT count(*) AS processed, count(paragraph_text) AS verified,
       count(CASE WHEN paragraph_text IS NOT NULL THEN old_error END) AS errors,
       count(*) - count(paragraph_text) AS missing_texts, CAST(count_if(yes) AS BIGINT) AS yes,
       round(count_if(yes) * 100.0 / greatest(count(paragraph_text), 1), 6) AS yes_pct
FROM (SELECT *, paragraph_text IS NOT NULL AND coalesce(old_verdict = 'Y', shared >= 0.4 * asked) AS yes FROM judged)""",
    fx.REVIEWS, JUDGED))
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a finished run over the reviews."""
    return verdicts.run_report(judged_reviews(spark, sf_dir))


@query("error_log", with_sql("""
SELECT patent_id, qtype, q_idx, paper_idx, para_idx, paragraph_id, error FROM reviews WHERE error IS NOT NULL""", fx.REVIEWS))
def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.error_log(fx.reviews(spark, sf_dir))


@query("method_report", with_sql("""
SELECT (SELECT count(*) FROM (SELECT DISTINCT patent_id, qtype, q_idx FROM reviews
                              WHERE patent_id IN (SELECT patent_id FROM second))) AS questions,
       count(*) AS compared, CAST(a AS BIGINT) AS first_only, CAST(b AS BIGINT) AS second_only,
       CAST(ab AS BIGINT) AS both, CAST(count(*) - a - b - ab AS BIGINT) AS neither,
       round((a + b + ab) * 100.0 / count(*), 6) AS combined_pct, round((a + ab) * 100.0 / count(*), 6) AS first_pct,
       round((b + ab) * 100.0 / count(*), 6) AS second_pct
FROM statuses CROSS JOIN (
  SELECT count_if(status = 'first_only') AS a, count_if(status = 'second_only') AS b, count_if(status = 'both') AS ab
  FROM statuses)
GROUP BY a, b, ab""", fx.REVIEWS, fx.SECOND, STATUS))
def method_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.method_report(fx.reviews(spark, sf_dir), fx.second_opinion(spark, sf_dir))


@query("answered_by_both", with_sql("""
SELECT patent_id, qtype, q_idx, status, question FROM statuses
JOIN (SELECT patent_id, qtype, q_idx, max(question) AS question FROM reviews GROUP BY ALL) USING (patent_id, qtype, q_idx)
WHERE status = 'both' ORDER BY patent_id, qtype, q_idx LIMIT 20""", fx.REVIEWS, fx.SECOND, STATUS))
def answered_by_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the first twenty questions both methods answered."""
    return verdicts.answered_by_both(fx.reviews(spark, sf_dir), fx.second_opinion(spark, sf_dir))


@query("results_summary", with_sql("""
SELECT patent_id, count(*) AS questions, CAST(count_if(qtype = 'remembering') AS BIGINT) AS remembering,
       CAST(count_if(qtype = 'understanding') AS BIGINT) AS understanding
FROM (SELECT DISTINCT patent_id, qtype, q_idx FROM reviews) GROUP BY patent_id""", fx.REVIEWS))
def results_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.results_summary(fx.reviews(spark, sf_dir))


@query("paper_listing", with_sql("""
SELECT patent_id, qtype, q_idx, count(*) AS papers,
       string_agg(line, ' | ' ORDER BY paper_idx) FILTER (paper_idx < 5) AS top_papers
FROM (SELECT patent_id, qtype, q_idx, paper_idx,
             paper_id || ': ' || string_agg(paragraph_id, ', ' ORDER BY para_idx) AS line
      FROM reviews WHERE paper_id IS NOT NULL GROUP BY patent_id, qtype, q_idx, paper_idx, paper_id)
GROUP BY patent_id, qtype, q_idx""", fx.REVIEWS))
def paper_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.paper_listing(fx.reviews(spark, sf_dir))


# -- links ------------------------------------------------------------------


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link is identified by question and paper."""
    return links.verified_links(
        fx.link_rows(spark, sf_dir), fx.link_patents(spark, sf_dir), fx.link_papers(spark, sf_dir)
    )


@query("verified_links", with_sql("""
SELECT patent_id, patent_year, patent_cpc, patent_section, paper_id, paper_year, paper_cat, q_type, q_idx FROM links""", fx.LINKS))
def verified_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


FIELDS = ["Unknown", "economy", "large", "medium", "promo", "small", "standard"]


@query("link_matrix", with_sql("SELECT patent_section, " + ", ".join(
    f'count_if(paper_field = \'{name}\')::BIGINT AS "{name}"' for name in FIELDS
) + """ FROM fielded WHERE q_type = 'understanding' AND patent_section IS NOT NULL GROUP BY patent_section""", fx.LINKS))
def link_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_matrix(_links(spark, sf_dir))


@query("link_matrix_norm", with_sql("""
SELECT patent_section, paper_field, n AS links, round(n / sum(n) OVER (PARTITION BY patent_section), 6) AS share
FROM (SELECT patent_section, paper_field, count(*) AS n FROM chosen
      WHERE paper_field IN (SELECT paper_field FROM chosen GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15)
        AND patent_section IN (SELECT patent_section FROM chosen WHERE patent_section IS NOT NULL
                               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
      GROUP BY ALL)""", fx.LINKS,
    "chosen AS (SELECT * FROM fielded WHERE q_type = 'understanding' AND paper_field <> 'Unknown')"))
def link_matrix_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_matrix_norm(_links(spark, sf_dir))


LAGS = """lags AS (
  SELECT *, patent_year - paper_year AS lag FROM links WHERE patent_year IS NOT NULL AND paper_year IS NOT NULL)"""


@query("lag_histogram", with_sql("""
SELECT q_type, CAST(b.lag_bin AS INTEGER) AS lag_bin, CAST(coalesce(n, 0) AS BIGINT) AS links
FROM (SELECT DISTINCT q_type FROM lags WHERE lag BETWEEN -5 AND 29) CROSS JOIN (SELECT unnest(range(-5, 29)) AS lag_bin) b
LEFT JOIN (SELECT q_type, least(lag, 28) AS lag_bin, count(*) AS n FROM lags WHERE lag BETWEEN -5 AND 29 GROUP BY ALL) c
  USING (q_type, lag_bin)""", fx.LINKS, LAGS))
def lag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.lag_histogram(_links(spark, sf_dir))


@query("lag_evolution", with_sql("""
SELECT patent_year, q_type, round(avg(lag), 6) AS mean_lag FROM lags WHERE patent_year BETWEEN 2000 AND 2024 GROUP BY ALL""",
    fx.LINKS, LAGS))
def lag_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.lag_evolution(_links(spark, sf_dir))


@query("level_shares", with_sql("""
SELECT patent_section, round(count_if(q_type = 'remembering') / count(*), 6) AS remembering,
       round(count_if(q_type = 'understanding') / count(*), 6) AS understanding
FROM links WHERE patent_section IS NOT NULL GROUP BY patent_section""", fx.LINKS))
def level_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.level_shares(_links(spark, sf_dir))


@query("evidence_pipeline", with_sql("""
SELECT 'links' AS report, cpc_section AS part, field AS item, CAST(count(*) AS DOUBLE) AS value FROM evidence
WHERE qtype = 'understanding' AND cpc_section IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'lag', qtype, CAST(least(lag, 28) AS VARCHAR), CAST(count(*) AS DOUBLE)
FROM (SELECT qtype, grant_year - paper_year AS lag FROM evidence) WHERE lag BETWEEN -5 AND 29 GROUP BY ALL
UNION ALL SELECT 'level', cpc_section, qtype,
  round(count(*) / sum(count(*)) OVER (PARTITION BY cpc_section), 6) FROM evidence WHERE cpc_section IS NOT NULL GROUP BY cpc_section, qtype
UNION ALL SELECT 'patents', 'enriched', 'all', CAST(count(DISTINCT CASE WHEN known THEN patent_id END) AS DOUBLE)
FROM enriched WHERE paragraph_id IS NOT NULL""",
    fx.REVIEWS, ENRICHED, """verdicts AS (
  SELECT r.*, CASE WHEN q_idx = 0 AND contains_answer IS NOT NULL THEN contains_answer WHEN paragraph_text IS NULL THEN 'N'
    WHEN len(list_intersect(a, list_distinct(string_split(lower(paragraph_text), ' ')))) >= 0.4 * len(a) THEN 'Y' ELSE 'N' END AS verdict
  FROM (SELECT *, list_distinct(string_split('red ' || q_idx || ' gear of supplier', ' ')) AS a FROM reviews WHERE paragraph_id IS NOT NULL) r),
evidence AS (
  SELECT v.patent_id, qtype, q_idx, v.paper_id, grant_year, cpc_section, paper_year,
         CASE WHEN coalesce(paper_category, '') <> '' THEN split_part(paper_category, '.', 1) ELSE 'Unknown' END AS field
  FROM (SELECT DISTINCT patent_id, qtype, q_idx, paper_id FROM verdicts WHERE verdict = 'Y') v
  LEFT JOIN patent_facts p ON p.patent_id = v.patent_id LEFT JOIN paper_facts f ON f.paper_id = v.paper_id)"""))
def evidence_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From questions to link tables in one run: the patents are sharded, verdicts of an
    earlier run taken over, the rest judged, the results enriched, and the links of all
    questions reported by field, lag and level."""
    reviews = fx.reviews(spark, sf_dir)
    blank = reviews.withColumn(
        "question", F.concat(F.lit("red "), F.col("q_idx").cast("string"), F.lit(" gear of supplier"))
    )
    for name in ("contains_answer", "answer", "error"):
        blank = blank.withColumn(name, F.lit(None).cast("string"))
    shards = ranking.assign_shards(reviews, "patent_id", 4)
    earlier = reviews.where((F.col("q_idx") == 0) & F.col("paragraph_id").isNotNull())
    # Texts are moved and sorted once: all three joins find them by patent.
    blank = blank.repartition("patent_id")
    waiting = verdicts.merge_prior(blank, earlier).join(shards.select("patent_id", "shard"), "patent_id")
    with rows_kept_in_place(spark), shuffles_dropped(spark):
        judged = stage(scoring.verify(waiting, patent_texts(reviews), scoring.overlap_judge(0.4)), "evidence", "zstd")
    patents, papers = review_facts(spark, sf_dir)
    counts = metadata.enrichment_counts(metadata.enrich(judged, papers, patents))
    found = stage(links.verified_links(judged, patents, papers, QUESTION_KEY), "evidence-links")
    row = lambda report, part, item, value: [
        F.lit(report).alias("report"), F.col(part).alias("part"), F.col(item).cast("string").alias("item"),
        F.col(value).cast("double").alias("value"),
    ]
    shares = links.level_shares(found)
    levels = [c for c in shares.columns if c != "patent_section"]
    long = shares.unpivot("patent_section", levels, "level", "share").where(F.col("share") > 0)
    return (
        links.field_counts(found).select(*row("links", "patent_section", "paper_field", "links"))
        .unionByName(links.lag_histogram(found).where(F.col("links") > 0).select(*row("lag", "q_type", "lag_bin", "links")))
        .unionByName(long.select(*row("level", "patent_section", "level", "share")))
        .unionByName(counts.select(
            F.lit("patents").alias("report"), F.lit("enriched").alias("part"), F.lit("all").alias("item"),
            F.col("enriched_patents").cast("double").alias("value"),
        ))
    )
