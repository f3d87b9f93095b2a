"""Projections, filters, prompts and response parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagekit.functions import filters, ids, parse, prompts
from passagekit.operators import patents
from passagekit.operators.ranking import slice_questions
from passagekit.plans import fixtures as fx
from passagekit.plans.fixtures import table, with_sql
from passagekit.plans.registry import query


@query("paragraph_keys", with_sql("""
SELECT id, split_part(id, '_', 1) AS paper_id, num AS para_num,
       CASE WHEN num > 0 THEN split_part(id, '_', 1) || '_p' || (num - 1) END AS prev_id,
       split_part(id, '_', 1) || '_p' || (num + 1) AS next_id
FROM (SELECT id, TRY_CAST(nullif(split_part(id, '_p', 2), '') AS INTEGER) AS num FROM (
  SELECT paper_paragraph_id AS id FROM paragraphs
  UNION ALL SELECT source || '_' || lang FROM documents
  UNION ALL SELECT lang || '_p' || source FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM documents))""", fx.PARAGRAPHS))
def paragraph_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all paragraphs, and three malformed ones per document."""
    docs = table(spark, sf_dir, "documents")
    malformed = docs.select(F.explode(F.array(
        F.concat_ws("_", "source", "lang"),
        F.concat(F.col("lang"), F.lit("_p"), F.col("source")),
        F.col("doc_id").cast("string"),
    )).alias("id"))
    every = fx.paragraphs(spark, sf_dir).select(F.col("paper_paragraph_id").alias("id")).unionByName(malformed)
    return ids.with_paragraph_keys(every, "id")


@query("numeric_ids", """
SELECT TRY_CAST(id AS BIGINT) AS patent_id, p_name FROM (
  SELECT CASE WHEN p_size = 1 THEN 'D' WHEN p_size = 2 THEN 'RE' ELSE '' END || p_partkey
         || CASE WHEN p_size = 3 THEN 'x' ELSE '' END AS id, p_name FROM part)
WHERE NOT regexp_matches(id, '^[^0-9]')""")
def numeric_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys, some with letters before or after the digits."""
    size = F.col("p_size")
    before = F.when(size == 1, "D").when(size == 2, "RE").otherwise("")
    after = F.when(size == 3, "x").otherwise("")
    rows = table(spark, sf_dir, "part").select(
        F.concat(before, F.col("p_partkey").cast("string"), after).alias("patent_id"), "p_name"
    )
    return ids.numeric_ids(rows, "patent_id")


def _patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as patents, with the columns the type filter removes."""
    unused = ["filename", "withdrawn", "num_claims", "wipo_kind"]
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("patent_id"),
        F.when(F.col("o_orderstatus") == "F", "utility").when(F.col("o_orderstatus") == "O", "utility")
        .otherwise("design").alias("patent_type"),
        F.to_date("o_orderdate").alias("patent_date"),
        *[F.lit(None).cast("string").alias(name) for name in unused],
    )


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as class rows of a patent."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    return lines.select(
        F.col("l_orderkey").alias("patent_id"),
        F.col("l_linenumber").alias("cpc_sequence"),
        F.col("p_brand").alias("cpc_class"),
        F.concat_ws("/", "p_brand", "p_type").alias("cpc_subclass"),
        F.col("l_suppkey").alias("cpc_group"),
        F.when(F.col("l_returnflag") == "N", "additional").otherwise("inventional").alias("cpc_type"),
    )


CLASSES = """classes AS (
  SELECT DISTINCT l_orderkey AS patent_id, l_linenumber AS cpc_sequence, p_brand AS cpc_class,
         p_brand || '/' || p_type AS cpc_subclass
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N')"""


@query("type_filters", with_sql("""
SELECT 'patent' AS kind, o_orderkey AS patent_id, NULL AS cpc_sequence, NULL AS cpc_class FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'class', patent_id, cpc_sequence, cpc_class FROM (SELECT * FROM classes)
UNION ALL SELECT 'flag', o_orderkey, NULL, NULL FROM orders WHERE o_orderpriority = '2-HIGH'""", CLASSES))
def type_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    utility = patents.utility_patents(_patents(spark, sf_dir)).select(F.lit("patent").alias("kind"), "patent_id")
    classes = patents.inventional_classes(_classes(spark, sf_dir)).select(
        F.lit("class").alias("kind"), "patent_id", "cpc_sequence", "cpc_class"
    )
    predictions = table(spark, sf_dir, "orders").select(
        F.lit("flag").alias("kind"), F.col("o_orderkey").alias("patent_id"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0).alias("flag_patent"),
    )
    ai = patents.flagged(predictions).drop("flag_patent")
    return utility.unionByName(classes, True).unionByName(ai, True)


@query("date_parts", """
SELECT o_orderkey AS patent_id, CAST(o_orderdate AS DATE) AS patent_date,
       CAST(year(o_orderdate) AS INTEGER) AS grant_year, CAST(month(o_orderdate) AS INTEGER) AS grant_month,
       strftime(o_orderdate, '%Y-%m') AS grant_year_month
FROM orders""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _patents(spark, sf_dir).select("patent_id", "patent_date")
    return ids.with_date_parts(rows, "patent_date", "grant_")


# Brands in the role of the code taxonomy: two sections, as classes and subclasses.
TAXONOMY = {"first": ["Brand#1", "Brand#12"], "second": ["Brand#2", "Brand#25/SMALL", "Brand#7/PROMO"]}


@query("domain_flag", """
SELECT p_partkey AS patent_id, p_brand AS cpc_class, p_brand || '/' || p_type AS cpc_subclass,
       p_brand IN ('Brand#1', 'Brand#12', 'Brand#2') OR p_brand || '/' || p_type IN ('Brand#25/SMALL', 'Brand#7/PROMO')
         AS is_computer_science_patent
FROM part""")
def domain_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("patent_id"),
        F.col("p_brand").alias("cpc_class"),
        F.concat_ws("/", "p_brand", "p_type").alias("cpc_subclass"),
    )
    return patents.flag_domain(rows, TAXONOMY)


@query("usable_passages", with_sql("""
SELECT patent_id, qtype, q_idx, rank, paragraph_id, NOT has_text AS fallback FROM (
  SELECT *, bool_or(ok) OVER (PARTITION BY patent_id, qtype, q_idx) AS has_text FROM (
    SELECT *, coalesce(trim(paragraph_text) <> '', FALSE) AS ok FROM reviews WHERE paragraph_id IS NOT NULL))
WHERE ok OR NOT has_text""", fx.REVIEWS))
def usable_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.reviews(spark, sf_dir).where(F.col("paragraph_id").isNotNull())
    kept = filters.usable_passages(rows, ["patent_id", "qtype", "q_idx"])
    return kept.select("patent_id", "qtype", "q_idx", "rank", "paragraph_id", "fallback")


@query("hits_normalise", """
SELECT page_id, 'web_' || page_id AS paper_id, 'web_' || page_id || '_p0' AS paragraph_id,
       CAST(page_id + 1 AS INTEGER) AS rank, paragraph_text
FROM (SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN url WHEN url LIKE 'http://%' THEN html
             WHEN length(html) < 3000 THEN '   ' || url || '   ' ELSE html END AS paragraph_text FROM pages)
WHERE length(trim(paragraph_text)) >= 50""")
def hits_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as search hits whose text sits in different fields."""
    url, html = F.col("url"), F.col("html")
    mobile, plain, brief = url.startswith("https://m."), url.startswith("http://"), F.length("html") < 3000
    hits = table(spark, sf_dir, "pages").select(
        "page_id",
        F.col("page_id").alias("position"),
        F.when(mobile | (brief & ~plain), "").otherwise(html).alias("raw_content"),
        F.when(~mobile, F.concat(F.lit("   "), url, F.lit("   "))).alias("content"),
        url.alias("snippet"),
    )
    return filters.normalise_hits(hits).select("page_id", "paper_id", "paragraph_id", "rank", "paragraph_text")


@query("question_slice", with_sql("""
SELECT patent_id, qtype, query_id FROM (
  SELECT *, row_number() OVER (ORDER BY qtype, query_id) - 1 AS place FROM questions)
WHERE place >= 5 AND place < 30""", fx.QUESTIONS))
def question_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions 5 to 29 of the two levels in turn."""
    asked = fx.questions(spark, sf_dir)
    levels = [asked.where(F.col("qtype") == level) for level in ("remembering", "understanding")]
    return slice_questions(levels, ["query_id"], 5, 30).select("patent_id", "qtype", "query_id")


@query("prompt_assembly", with_sql(f"""
SELECT patent_id, qtype, q_idx, rank,
       '{prompts.SEARCH_FORMAT.split(chr(10))[0].replace("%s", prompts.SEARCH_TASK)}' || chr(10) || 'Query: ' || question AS search,
       'Patent Title: ' || title || chr(10) || 'Patent Abstract: ' || abstract || chr(10) || 'Question: ' || question AS context,
       'Question:' || question || ' (context:' || title || ')' AS web,
       'Decide whether the paragraph below answers the question about the patent.' || chr(10) || 'Title: ' || title
         || chr(10) || 'Abstract: ' || abstract || chr(10) || 'Question: ' || question || chr(10) || 'Paragraph: '
         || coalesce(paragraph_text, '') || chr(10) || 'Reply with two lines:' || chr(10) || 'CONTAINS_ANSWER: Y or N'
         || chr(10) || 'ANSWER: the answer, or N/A' AS verdict,
       'Patent title: ' || title || chr(10) || 'Patent abstract: ' || abstract || chr(10) || 'Write 3 questions at the '
         || qtype || ' level that this patent''s field should be able to answer.' || chr(10)
         || 'Reply as JSON: {{"1": "...", "2": "...", "3": "..."}}' AS generation,
       'Title: ' || title || chr(10) || 'Abstract: ' || abstract || chr(10) || 'Question: ' || question || chr(10)
         || 'List the search keywords for this question as search_query=[...]' AS keywords
FROM (SELECT *, 'patent ' || patent_id AS title, 'about ' || qtype AS abstract FROM reviews)""", fx.REVIEWS))
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.reviews(spark, sf_dir)
    title = F.concat(F.lit("patent "), F.col("patent_id"))
    abstract = F.concat(F.lit("about "), F.col("qtype"))
    question = F.col("question")
    return rows.select(
        "patent_id", "qtype", "q_idx", "rank",
        prompts.search_prompt(question).alias("search"),
        prompts.rerank_context(title, abstract, question).alias("context"),
        prompts.web_query(question, title).alias("web"),
        prompts.verdict_prompt(title, abstract, question, F.col("paragraph_text")).alias("verdict"),
        prompts.question_prompt(title, abstract, F.col("qtype")).alias("generation"),
        prompts.keyword_prompt(title, abstract, question).alias("keywords"),
    )


@query("verdict_parse", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_linenumber IN (1, 3, 7) THEN 'Y' ELSE 'N' END AS contains_answer,
       CASE WHEN l_linenumber IN (1, 5, 7) THEN 'part: ' || l_partkey END AS answer,
       CASE WHEN l_linenumber = 6 THEN 'Model produced no structured output' END AS error
FROM lineitem""")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven forms of a response, chosen by line number."""
    line = F.col("l_linenumber")
    part = F.concat(F.lit("ANSWER: part: "), F.col("l_partkey").cast("string"))
    reply = (
        F.when(line == 1, F.concat(F.lit("\nCONTAINS_ANSWER: y \n"), part, F.lit("  \n")))
        .when(line == 2, "CONTAINS_ANSWER: N\nANSWER: N/A")
        .when(line == 3, "CONTAINS_ANSWER: yes, it does\n ANSWER: indented")
        .when(line == 4, "CONTAINS_ANSWER: [Y]\nANSWER:N/A")
        .when(line == 5, F.concat(F.lit("CONTAINS_ANSWER: Y.\n"), part))
        .when(line == 6, " \n")
        .otherwise(F.concat(F.lit("CONTAINS_ANSWER: N\nANSWER: first\nCONTAINS_ANSWER: Y\n"), part, F.lit("\nANSWER: N/A")))
    )
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", reply.alias("response")
    )
    return parse.parse_verdicts(rows).drop("response")


@query("question_parse", """
SELECT p_partkey, 'question' AS kind, q.n AS question_id, 'What is ' || p_name || ' ' || q.n || '?' AS question
FROM part, (SELECT unnest(['1', '2', '3']) AS n) q WHERE p_size > 15
UNION ALL SELECT p_partkey, 'reject', NULL, NULL FROM part WHERE p_size <= 15""")
def question_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as responses: two, four or broken entries, or three as asked."""
    size = F.col("p_size")
    entry = lambda n: F.concat(F.lit(f'"{n}": "What is '), F.col("p_name"), F.lit(f' {n}?"'))
    block = lambda count, end="}": F.concat(
        F.lit("Sure:\n{"), F.concat_ws(",\n", *[entry(n) for n in range(1, count + 1)]), F.lit(end + " done {x}")
    )
    reply = (
        F.when(size <= 5, block(2)).when(size <= 10, block(4)).when(size <= 12, block(3, ",]}"))
        .when(size <= 15, F.col("p_name")).otherwise(block(3))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", reply.alias("response"))
    good, bad = parse.parse_questions(rows)
    return good.withColumn("kind", F.lit("question")).unionByName(
        bad.select("p_partkey", F.lit("reject").alias("kind")), allowMissingColumns=True
    )


@query("keyword_parse", """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN '' ELSE p_name || '|' || p_type END AS keywords,
       CAST(CASE WHEN p_size <= 10 THEN 0 ELSE 2 END AS INTEGER) AS keyword_count
FROM part""")
def keyword_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword lists in single or double quotes, cut off, or absent."""
    size = F.col("p_size")
    form = lambda q, end: F.concat(
        F.lit(f"search_query=[{q}"), F.col("p_name"), F.lit(f"{q}, {q}"), F.col("p_type"), F.lit(f"{q}{end}")
    )
    reply = (
        F.when(size <= 5, F.col("p_name")).when(size <= 10, form("'", "")).when(size <= 30, form("'", "] [x]"))
        .otherwise(form('"', "]\n"))
    )
    words = parse.keyword_list(F.col("response"))
    rows = table(spark, sf_dir, "part").select("p_partkey", reply.alias("response"))
    return rows.select(
        "p_partkey", F.array_join(words, "|").alias("keywords"), F.size(words).alias("keyword_count")
    )
