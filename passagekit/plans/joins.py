"""Metadata, patent-table, text and result joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagekit.operators import corpus, metadata, patents, verdicts
from passagekit.plans import fixtures as fx
from passagekit.plans.filters import CLASSES, TAXONOMY, _classes, _patents
from passagekit.plans.fixtures import table, with_sql
from passagekit.plans.registry import query
from passagekit.schemas import POSITION_KEY


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts returned at least once, and as many ids nobody knows."""
    returned = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select("l_partkey").distinct()
    unknown = returned.select((-F.col("l_partkey") - 1).alias("l_partkey"))
    return returned.unionByName(unknown)


def _corpus_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as (paper, foreign key); undiscounted lines have none."""
    key = F.when(F.col("l_discount") == 0, "").when(F.col("l_discount") == 0.1, None).otherwise(
        F.col("l_suppkey").cast("string")
    )
    return table(spark, sf_dir, "lineitem").select("l_partkey", key.alias("arxiv"))


TARGETS = """returned AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'),
targets AS (SELECT l_partkey FROM returned UNION ALL SELECT -l_partkey - 1 FROM returned),
mapping AS (
  SELECT DISTINCT l_partkey, CAST(l_suppkey AS VARCHAR) AS arxiv FROM lineitem
  WHERE l_discount <> 0 AND l_discount <> 0.1 AND l_partkey IN (SELECT l_partkey FROM targets))"""


@query("id_mapping", with_sql("SELECT l_partkey, arxiv FROM mapping", TARGETS))
def id_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.map_ids(_corpus_keys(spark, sf_dir), _targets(spark, sf_dir), "l_partkey", "arxiv")


@query("paper_metadata", with_sql("""
SELECT CAST(t.l_partkey AS VARCHAR) AS paper_id,
       CASE WHEN s.s_acctbal >= 0 THEN CAST(1990 + s.s_nationkey AS VARCHAR) END AS year,
       split_part(s.categories, ' ', 1) AS category, s.categories AS all_categories, m.arxiv AS arxiv_id
FROM targets t
LEFT JOIN (SELECT l_partkey, min(arxiv) AS arxiv FROM mapping GROUP BY l_partkey) m ON m.l_partkey = t.l_partkey
LEFT JOIN (SELECT *, n_name || ' ' || s_name AS categories FROM supplier JOIN nation ON s_nationkey = n_nationkey) s
  ON CAST(s.s_suppkey AS VARCHAR) = m.arxiv""", TARGETS))
def paper_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    mapping = metadata.map_ids(_corpus_keys(spark, sf_dir), targets, "l_partkey", "arxiv").select(
        F.col("l_partkey").cast("string").alias("paper_id"), F.col("arxiv").alias("arxiv_id")
    )
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    facts = suppliers.select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.concat_ws(" ", "n_name", "s_name").alias("categories"),
        F.when(F.col("s_acctbal") >= 0, F.make_date(1990 + F.col("s_nationkey"), F.lit(6), F.lit(1))).alias("update_date"),
    )
    return metadata.paper_metadata(
        targets.select(F.col("l_partkey").cast("string").alias("paper_id")), mapping, facts
    )


@query("patent_metadata", with_sql("""
SELECT CAST(patent_id AS VARCHAR) AS patent_id, CAST(year(o_orderdate) AS INTEGER) AS grant_year, cpc_class, cpc_section
FROM (SELECT *, row_number() OVER (PARTITION BY patent_id ORDER BY cpc_sequence, cpc_class) AS place
      FROM (SELECT patent_id, cpc_sequence, cpc_class, left(cpc_class, 7) AS cpc_section FROM classes))
JOIN orders ON o_orderkey = patent_id
WHERE place = 1 AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')""", CLASSES))
def patent_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patents of two result sets, looked up in the class rows."""
    orders = table(spark, sf_dir, "orders")
    chosen = lambda priority: orders.where(F.col("o_orderpriority") == priority).select(
        F.col("o_orderkey").cast("string").alias("patent_id")
    )
    garbage = orders.select(F.concat(F.lit("x"), F.col("o_orderstatus")).alias("patent_id")).distinct()
    rows = patents.inventional_classes(_classes(spark, sf_dir)).join(
        orders.select(F.col("o_orderkey").alias("patent_id"), F.year("o_orderdate").alias("grant_year")), "patent_id"
    ).withColumn("cpc_section", F.left("cpc_class", F.lit(7)))
    return metadata.patent_metadata([chosen("1-URGENT"), chosen("3-MEDIUM"), garbage], rows)


@query("validated_join", """
SELECT o_orderkey, o_custkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def validated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal"
    )
    return patents.join_many_to_one(orders, customers, "o_custkey", "left").select(
        "o_orderkey", "o_custkey", "c_name", "c_acctbal"
    )


@query("patent_wide", with_sql("""
SELECT o.o_orderkey AS patent_id, cpc_sequence, cpc_class, cpc_subclass, cpc_subclass_title,
       coalesce(cpc_class IN ('Brand#1', 'Brand#12', 'Brand#2') OR cpc_subclass IN ('Brand#25/SMALL', 'Brand#7/PROMO'), FALSE)
         AS is_computer_science_patent,
       c_name AS patent_abstract,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END AS flag_patent,
       CASE WHEN year(o_orderdate) <> 1998 THEN o_orderpriority END AS summary_text
FROM orders o JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT c.*, title AS cpc_subclass_title FROM classes c JOIN titles USING (cpc_class, cpc_subclass)) k
  ON k.patent_id = o.o_orderkey
WHERE o_orderstatus <> 'P'""", CLASSES, """titles AS (
  SELECT p_brand AS cpc_class, p_brand || '/' || p_type AS cpc_subclass, lower(p_type) AS title FROM part
  WHERE p_type <> 'LARGE' GROUP BY ALL)"""))
def patent_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utility orders with their brand classes, titles, texts and flags."""
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part").where(F.col("p_type") != "LARGE")
    titles = parts.select(
        F.col("p_brand").alias("cpc_class"),
        F.concat_ws("/", "p_brand", "p_type").alias("cpc_subclass"),
        F.lower("p_type").alias("cpc_subclass_title"),
    )
    key = F.col("o_orderkey").alias("patent_id")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    abstracts = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key, F.col("c_name").alias("patent_abstract")
    )
    ai = orders.where(F.col("o_orderpriority") == "2-HIGH").select(key, F.lit(1).alias("flag_patent"))
    summaries = orders.where(F.year("o_orderdate") != 1998).select(key, F.col("o_orderpriority").alias("summary_text"))
    wide = patents.patent_table(
        patents.utility_patents(_patents(spark, sf_dir)).drop("patent_date"),
        patents.inventional_classes(_classes(spark, sf_dir)),
        titles, abstracts, ai, summaries, TAXONOMY,
    )
    return wide


@query("text_fetch", with_sql("""
SELECT w.id AS paper_paragraph_id, p.paragraph_text FROM (
  SELECT DISTINCT id FROM (
    SELECT doc_id || '_p0' AS id FROM labels UNION ALL SELECT doc_id || '_p1' FROM labels
    UNION ALL SELECT doc_id || '_p2' FROM labels UNION ALL SELECT doc_id || '_x' FROM labels)) w
LEFT JOIN paragraphs p ON p.paper_paragraph_id = w.id""", fx.PARAGRAPHS))
def text_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second paragraph of every labelled document with both neighbours; each
    document is also asked for an id that does not exist."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc"))
    wanted = labels.select(F.explode(F.array(
        F.concat("doc", F.lit("_p1")), F.concat("doc", F.lit("_x"))
    )).alias("paper_paragraph_id"))
    store = fx.paragraphs(spark, sf_dir)
    copies = store.unionByName(store.withColumn("shard", F.col("shard") + 8))
    return corpus.fetch_texts(wanted, copies, neighbours=True)


@query("context_merge", with_sql("""
SELECT p.paper_paragraph_id,
       CASE WHEN short THEN coalesce('[Previous paragraph]: ' || nullif(b.paragraph_text, '') || chr(10) || chr(10), '')
                 || p.paragraph_text
                 || coalesce(chr(10) || chr(10) || '[Next paragraph]: ' || nullif(a.paragraph_text, ''), '')
            ELSE p.paragraph_text END AS paragraph_text,
       short AND (coalesce(b.paragraph_text, '') <> '' OR coalesce(a.paragraph_text, '') <> '') AS merged
FROM (SELECT *, length(paragraph_text) < 200 AND paragraph_text <> '' AS short FROM paragraphs) p
LEFT JOIN paragraphs b ON b.corpusid = p.corpusid AND b.para_num = p.para_num - 1
LEFT JOIN paragraphs a ON a.corpusid = p.corpusid AND a.para_num = p.para_num + 1""", fx.PARAGRAPHS))
def context_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fx.paragraphs(spark, sf_dir).select("paper_paragraph_id", "paragraph_text")
    return corpus.merge_context(texts, texts)


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run that judged the paragraphs the current rows left open."""
    rows = fx.reviews(spark, sf_dir).where(F.col("paragraph_id").isNotNull())
    opened = F.col("contains_answer").isNull() & (F.col("rank") <= 2)
    return rows.withColumns({
        "contains_answer": F.when(opened, F.when(F.col("rank") == 1, "Y").otherwise("N")),
        "answer": F.when(opened, F.lit("earlier")),
        "error": F.when(opened & (F.col("rank") == 2), F.lit("lost call")),
    })


@query("prior_merge", with_sql("""
SELECT patent_id, qtype, q_idx, question, paper_idx, paper_id, para_idx, paragraph_id, rank, paragraph_text,
       CASE WHEN opened AND rank = 1 THEN 'Y' WHEN opened THEN 'N' ELSE contains_answer END AS contains_answer,
       CASE WHEN opened THEN 'earlier' ELSE answer END AS answer,
       CASE WHEN opened AND rank = 2 THEN 'lost call' ELSE error END AS error, rerank_score
FROM (SELECT *, coalesce(contains_answer IS NULL AND rank <= 2, FALSE) AS opened FROM reviews)""", fx.REVIEWS))
def prior_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.merge_prior(fx.reviews(spark, sf_dir), _prior(spark, sf_dir))


STATUS = """asked AS (
  SELECT f.*, s.yes AS second_yes, s.found AS second_found FROM
    (SELECT patent_id, qtype, q_idx, max(paper_idx) AS last_paper,
            bool_or(coalesce(contains_answer = 'Y', FALSE)) AS yes FROM reviews GROUP BY ALL) f
  JOIN (SELECT patent_id, qtype, q_idx, count(paper_id) AS found,
               bool_or(coalesce(contains_answer = 'Y', FALSE)) AS yes FROM second GROUP BY ALL) s
    USING (patent_id, qtype, q_idx)),
statuses AS (
  SELECT patent_id, qtype, q_idx, last_paper,
         CASE WHEN yes AND second_yes THEN 'both' WHEN yes THEN 'first_only'
              WHEN second_yes THEN 'second_only' ELSE 'neither' END AS status
  FROM asked WHERE second_found > 0)"""


@query("method_merge", with_sql("""
SELECT patent_id, qtype, q_idx, paper_idx, paper_id, para_idx, paragraph_id, contains_answer FROM reviews
UNION ALL
SELECT s.patent_id, s.qtype, s.q_idx, coalesce(t.last_paper + 1, 0), s.paper_id, s.para_idx, s.paragraph_id, s.contains_answer
FROM second s JOIN statuses t ON t.status = 'second_only' AND s.patent_id = t.patent_id AND s.qtype = t.qtype AND s.q_idx = t.q_idx
JOIN (SELECT patent_id, qtype, q_idx, min(paper_idx) AS paper_idx FROM second WHERE contains_answer = 'Y' GROUP BY ALL) y
  ON s.patent_id = y.patent_id AND s.qtype = y.qtype AND s.q_idx = y.q_idx AND s.paper_idx = y.paper_idx""",
    fx.REVIEWS, fx.SECOND, STATUS))
def method_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = verdicts.merge_methods(fx.reviews(spark, sf_dir), fx.second_opinion(spark, sf_dir))
    return merged.select(*POSITION_KEY, "paper_id", "paragraph_id", "contains_answer")


@query("pending_work", with_sql("""
SELECT DISTINCT patent_id, qtype, q_idx FROM reviews r
WHERE NOT EXISTS (SELECT 1 FROM second s WHERE s.patent_id = r.patent_id AND s.qtype = r.qtype AND s.q_idx = r.q_idx)""",
    fx.REVIEWS, fx.SECOND))
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = fx.reviews(spark, sf_dir).select("patent_id", "qtype", "q_idx").distinct()
    return verdicts.pending(todo, fx.second_opinion(spark, sf_dir), ["patent_id", "qtype", "q_idx"])


def review_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Patents and papers of the reviews; some are unknown, some patents known
    without a year."""
    orders, parts = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    facts = orders.groupBy(F.floor(F.col("o_orderkey") / 6).cast("string").alias("patent_id")).agg(
        F.max(F.year("o_orderdate")).alias("grant_year"), F.min("o_orderstatus").alias("cpc_section")
    ).where(F.col("grant_year") < 2001).withColumn("grant_year", F.when(F.col("grant_year") != 1997, F.col("grant_year")))
    papers = parts.groupBy(F.replace("p_brand", F.lit("#"), F.lit("")).alias("paper_id")).agg(
        F.when(F.min("p_retailprice") < 905, 1990 + F.min("p_size")).alias("paper_year"),
        F.min("p_type").alias("paper_category"),
    )
    return facts, papers


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with brand and order facts."""
    facts, papers = review_facts(spark, sf_dir)
    return metadata.enrich(fx.reviews(spark, sf_dir), papers, facts)


ENRICHED = """patent_facts AS (
  SELECT CAST(o_orderkey // 6 AS VARCHAR) AS patent_id, CAST(nullif(max(year(o_orderdate)), 1997) AS INTEGER) AS grant_year,
         min(o_orderstatus) AS cpc_section, TRUE AS known FROM orders GROUP BY 1 HAVING max(year(o_orderdate)) < 2001),
paper_facts AS (
  SELECT replace(p_brand, '#', '') AS paper_id, CAST(CASE WHEN min(p_retailprice) < 905 THEN 1990 + min(p_size) END AS INTEGER) AS paper_year,
         min(p_type) AS paper_category FROM part GROUP BY 1),
enriched AS (
  SELECT r.*, known, grant_year, cpc_section, paper_year, paper_category FROM reviews r
  LEFT JOIN patent_facts USING (patent_id) LEFT JOIN paper_facts USING (paper_id))"""


@query("enrich_results", with_sql("""
SELECT patent_id, qtype, q_idx, paper_idx, para_idx, paragraph_id, grant_year, cpc_section, paper_year, paper_category
FROM enriched""", fx.REVIEWS, ENRICHED))
def enrich_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select(
        *POSITION_KEY, "paragraph_id", "grant_year", "cpc_section", "paper_year", "paper_category"
    )


@query("enrich_counts", with_sql("""
SELECT (SELECT count(DISTINCT patent_id) FROM enriched WHERE known) AS enriched_patents,
       (SELECT count(DISTINCT patent_id) FROM enriched) AS total_patents,
       (SELECT count(*) FROM (SELECT DISTINCT patent_id, qtype, q_idx, paper_idx FROM enriched
                              WHERE paper_id IS NOT NULL AND paper_year IS NOT NULL)) AS enriched_papers,
       (SELECT count(*) FROM (SELECT DISTINCT patent_id, qtype, q_idx, paper_idx FROM enriched
                              WHERE paper_id IS NOT NULL)) AS total_papers""", fx.REVIEWS, ENRICHED))
def enrich_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.enrichment_counts(_enriched(spark, sf_dir))
