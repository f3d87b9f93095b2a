"""Lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagekit.functions.ids import paper_id
from passagekit.functions.text import coverage, word_set
from passagekit.operators import lexical, metrics, ranking
from passagekit.operators.scoring import rerank
from passagekit.plans import fixtures as fx
from passagekit.plans.fixtures import table, with_sql
from passagekit.plans.registry import query
from passagekit.scale import stage


@query("bm25_index", with_sql("""
SELECT p.term, p.doc_id, CAST(p.tf AS INTEGER) AS tf, CAST(l.doc_len AS INTEGER) AS doc_len, f.df,
       s.docs, round(s.avg_len, 6) AS avg_len
FROM postings p JOIN lengths l ON l.doc_id = p.doc_id JOIN frequencies f ON f.term = p.term CROSS JOIN stats s""",
    fx.PARAGRAPHS, fx.TOKENS, fx.POSTINGS))
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with document length, frequency and corpus statistics."""
    index = fx.paragraph_index(spark, sf_dir)
    return lexical.with_frequencies(index).select(
        "term", "doc_id", "tf", "doc_len", "df",
        index.stats.select("docs").scalar().alias("docs"),
        F.round(index.stats.select("avg_len").scalar(), 6).alias("avg_len"),
    )


@query("bm25_topk", with_sql("SELECT query_id, doc_id, score, rank FROM hits", *fx.BM25,
    fx.ranked_sql("hits", "scores", 100)))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_topk(fx.paragraph_index(spark, sf_dir), fx.questions(spark, sf_dir), 100).select(
        "query_id", "doc_id", "score", "rank"
    )


def _words(column: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({column}), '\\s+'), lambda w: w <> ''))"


OVERLAP = f"""word_sets AS (SELECT paper_paragraph_id AS doc_id, {_words('paragraph_text')} AS t FROM paragraphs),
asked_sets AS (SELECT query_id, {_words('question')} AS q FROM questions)"""


def _overlap_sql(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT c.query_id, c.doc_id, round(len(list_intersect(q, t)) / greatest(len(q), len(t), 1), 6) AS score
  FROM {source} c JOIN word_sets w ON w.doc_id = c.doc_id JOIN asked_sets a ON a.query_id = c.query_id)"""


@query("overlap_rerank", with_sql("SELECT query_id, doc_id, score, rank FROM hits", *fx.BM25,
    fx.ranked_sql("candidates", "scores", 100), OVERLAP, _overlap_sql("overlap_scores", "candidates"),
    fx.ranked_sql("hits", "overlap_scores", 50)))
def overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.questions(spark, sf_dir)
    candidates = stage(lexical.bm25_topk(fx.paragraph_index(spark, sf_dir), asked, 100), "candidates")
    return lexical.overlap_rerank(candidates, asked, fx.paragraphs(spark, sf_dir), 50).select(
        "query_id", "doc_id", "score", "rank"
    )


def question_coverage(spark: SparkSession, sf_dir: str):
    """Last stage of the cascade: share of the question's words in the text."""

    def score(candidates: DataFrame) -> DataFrame:
        texts = lexical.with_document_values(
            candidates.select("query_id", "doc_id"), fx.paragraphs(spark, sf_dir), "paper_paragraph_id",
            word_set("paragraph_text"), "_text",
        )
        asked = fx.questions(spark, sf_dir).select("query_id", word_set("question").alias("_asked"))
        pairs = texts.join(asked, "query_id").withColumn(
            "_text", F.coalesce("_text", F.array().cast("array<string>"))
        )
        return rerank(pairs, coverage(F.col("_asked"), F.col("_text")), 10)

    return score


@query("bm25_cascade", with_sql("SELECT query_id, doc_id, score AS rerank_score, rank FROM hits", *fx.BM25,
    fx.ranked_sql("first_cut", "scores", 30000), OVERLAP, _overlap_sql("overlap_scores", "first_cut"),
    fx.ranked_sql("second_cut", "overlap_scores", 1000),
    """covered AS (
  SELECT c.query_id, c.doc_id, round(len(list_intersect(q, t)) / len(q), 6) AS score
  FROM second_cut c JOIN word_sets w ON w.doc_id = c.doc_id JOIN asked_sets a ON a.query_id = c.query_id)""",
    fx.ranked_sql("hits", "covered", 10)))
def bm25_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30,000 lexical candidates, 1,000 by overlap, 10 by the last scorer."""
    return lexical.cascade(
        fx.paragraph_index(spark, sf_dir), fx.questions(spark, sf_dir), fx.paragraphs(spark, sf_dir),
        question_coverage(spark, sf_dir),
    ).select("query_id", "doc_id", "rerank_score", "rank")


@query("paper_grouping", with_sql("""
SELECT query_id, doc_id, rank, split_part(doc_id, '_', 1) AS paper_id,
       CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY best) - 1 AS INTEGER) AS paper_idx,
       CAST(row_number() OVER (PARTITION BY query_id, split_part(doc_id, '_', 1) ORDER BY rank) - 1 AS INTEGER) AS para_idx
FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, split_part(doc_id, '_', 1)) AS best FROM hits)""", *fx.BM25, fx.HITS))
def paper_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fx.lexical_hits(spark, sf_dir).select("query_id", "doc_id", "rank", "paper_id")
    return ranking.group_by_paper(hits, ["query_id"])


@query("ordered_unique", with_sql("""
SELECT query_id, paper_id, first_rank,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY first_rank, paper_id) AS INTEGER) AS position
FROM (SELECT query_id, split_part(doc_id, '_', 1) AS paper_id, min(rank) AS first_rank FROM hits GROUP BY ALL)""",
    *fx.BM25, fx.HITS))
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ordered_unique(fx.lexical_hits(spark, sf_dir), ["query_id"])


def containment_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, paper) pairs whose document holds the passage verbatim."""
    pairs = lexical.containing_documents(
        fx.paragraph_index(spark, sf_dir), fx.questions(spark, sf_dir), table(spark, sf_dir, "documents"),
        "query_id", "question", "doc_id", "text", owner=paper_id,
    )
    return pairs.withColumnRenamed("doc_id", "paper_id")


TRUTH = """truth AS (
  SELECT query_id, CAST(doc_id AS VARCHAR) AS paper_id FROM questions JOIN documents ON contains(text, question))"""


@query("containment_truth", with_sql("SELECT query_id, paper_id FROM truth", fx.QUESTIONS, TRUTH))
def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment_truth(spark, sf_dir)


@query("questions_per_level", with_sql("SELECT qtype, count(*) AS questions FROM questions GROUP BY qtype", fx.QUESTIONS))
def questions_per_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.questions_per_level(fx.questions(spark, sf_dir))


def _metric_columns(cutoffs: list[int]) -> str:
    recall = [f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k}" for k in cutoffs]
    mrr = [f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 / first_rank ELSE 0.0 END), 6) AS mrr_at_{k}" for k in cutoffs]
    return ", ".join(recall + mrr)


@query("recall_mrr", with_sql(f"""
SELECT count(*) AS questions, {_metric_columns(metrics.CUTOFFS)}
FROM questions LEFT JOIN (
  SELECT h.query_id, min(rank) AS first_rank FROM hits h
  JOIN truth t ON t.query_id = h.query_id AND t.paper_id = split_part(h.doc_id, '_', 1) GROUP BY h.query_id) m
  USING (query_id)""", *fx.BM25, fx.ranked_sql("hits", "scores", 100), TRUTH))
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and MRR of the lexical top 100 against verbatim containment."""
    asked = fx.questions(spark, sf_dir)
    hits = lexical.bm25_topk(fx.paragraph_index(spark, sf_dir), asked, 100)
    return metrics.retrieval_metrics(
        asked, hits.withColumn("paper_id", paper_id("doc_id")), containment_truth(spark, sf_dir),
        "query_id", "paper_id", metrics.CUTOFFS,
    )
