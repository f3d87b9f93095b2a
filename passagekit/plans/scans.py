"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagekit import schemas
from passagekit.operators.patents import stratified_cap
from passagekit.plans import fixtures as fx
from passagekit.plans.fixtures import table, with_sql
from passagekit.plans.registry import query
from passagekit.scale import lists_by_one_sort, shared_dir, shuffles_dropped
from passagekit.sources import readers, writers
from passagekit.sources.results import (
    documents_from_maps, flatten_results, merge_shards, nest_results, read_results, read_shards,
    without_verdicts,
)


@query("paragraphs", with_sql(
    "SELECT paper_paragraph_id, paragraph_text, corpusid, arxiv, shard FROM paragraphs", fx.PARAGRAPHS))
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> str:
        path = shared_dir(spark, "corpus")
        fx.paragraphs(spark, sf_dir).drop("para_num").write.partitionBy("shard").parquet(path)
        return path

    path = fx.once(spark, sf_dir, "corpus", make)
    return readers.read_paragraphs(spark, path).select(
        "paper_paragraph_id", "paragraph_text", "corpusid", "arxiv", "shard"
    )


@query("scan_tolerant", """
SELECT 'read' AS state, o_orderpriority AS item, count(*) AS rows FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'skipped', 'unreadable', 1""")
def scan_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders next to one file that is no Parquet and one without rows."""
    orders = table(spark, sf_dir, "orders")
    path = shared_dir(spark, "damaged")
    orders.write.parquet(f"{path}/good")
    orders.where(F.lit(False)).coalesce(1).write.parquet(f"{path}/empty")
    spark.createDataFrame([("no parquet file",)], "value string").coalesce(1).write.text(f"{path}/bad")
    rows, skipped = readers.read_tolerant(spark, f"{path}/*", orders.schema)
    good = rows.groupBy(F.lit("read").alias("state"), F.col("o_orderpriority").alias("item")).agg(
        F.count("*").alias("rows")
    )
    bad = skipped.groupBy(F.lit("skipped").alias("state"), F.col("state").alias("item")).agg(
        F.count("*").alias("rows")
    )
    return good.unionByName(bad)


@query("tsv_years", """
SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice, o_orderpriority,
       CAST(year(o_orderdate) AS INTEGER) AS source_year
FROM orders WHERE year(o_orderdate) <> 1998""")
def tsv_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one tab-separated file set per year; 1998 was not delivered."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    kept = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "year")
    path = shared_dir(spark, "years")
    kept.where(F.col("year") != 1998).write.partitionBy("year").csv(path, sep="\t", header=True)
    schema = "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"
    rows, missing = readers.read_tsv_years(spark, path + "/year={year}", range(1995, 2002), schema)
    assert missing == [1998], missing
    return rows


@query("questions_union", with_sql("""
SELECT patent_id, question_id, question, level FROM (
  SELECT patent_id, CAST(query_id AS VARCHAR) AS question_id, question, qtype AS level FROM questions
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), text, 'applying' FROM conversations)""", fx.QUESTIONS))
def questions_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question files of three levels, texts with line breaks included."""
    none = lambda kind="string": F.lit(None).cast(kind)
    full = lambda df: df.select(
        "patent_id", none().alias("patent_title"), none().alias("patent_abstract"), none().alias("cpc_class"),
        none("boolean").alias("is_computer_science_patent"), "question_id", "question",
    )
    asked = fx.questions(spark, sf_dir).withColumn("question_id", F.col("query_id").cast("string"))
    talk = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("patent_id"),
        F.col("turn").cast("string").alias("question_id"),
        F.col("text").alias("question"),
    )
    path = shared_dir(spark, "questions")
    for level in schemas.LEVELS:
        writers.write_results(full(asked.where(F.col("qtype") == level)), f"{path}/questions_{level}.csv", "csv")
    writers.write_results(full(talk), f"{path}/questions_applying.csv", "csv")
    return readers.read_questions(spark, f"{path}/questions_*.csv").select(
        "patent_id", "question_id", "question", "level"
    )


FLAT_COLUMNS = ", ".join(schemas.FLAT_COLUMNS)


@query("results_flat", with_sql(f"SELECT {FLAT_COLUMNS} FROM reviews", fx.REVIEWS))
def results_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents as JSON maps of patents, flattened."""
    documents = nest_results(fx.reviews(spark, sf_dir))
    body = F.struct("cpc", "grant_year", "patent_title", "patent_abstract", "first_question", "question_types")
    maps = documents.select(F.to_json(F.create_map("patent_id", body)).alias("document"))
    return flatten_results(documents_from_maps(maps, "document"))


@query("results_nest", with_sql(f"SELECT {FLAT_COLUMNS} FROM reviews", fx.REVIEWS))
def results_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows nested, stored as compressed JSON lines, read back and flattened.

    Two questions per document make every patent continue in a second one.
    """
    path = shared_dir(spark, "documents")
    documents = nest_results(fx.reviews(spark, sf_dir), questions_per_document=2)
    with lists_by_one_sort(spark), shuffles_dropped(spark):
        writers.write_results(documents, path, compression="gzip")
    return flatten_results(read_results(spark, path))


@query("class_sink", """
SELECT p_brand AS cpc_class, bool_and(p_size > 1) AS is_cs, count(*) AS rows, min(p_partkey) AS first_part
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42' || p_partkey), p_partkey) AS place FROM part)
WHERE place <= 50 GROUP BY p_brand""")
def class_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped class samples written per class and read back."""
    parts = table(spark, sf_dir, "part").withColumn("wide", F.col("p_size") > 1)
    sample = stratified_cap(parts, "p_brand", 50, "42", "p_partkey", "wide").withColumnsRenamed(
        {"p_brand": "cpc_class", "class_is_cs": "is_cs"}
    )
    path = shared_dir(spark, "classes")
    writers.write_by_class(sample, path, "cpc_class", "is_cs", "p_partkey")
    stored = spark.read.parquet(path)
    return stored.groupBy("cpc_class").agg(
        F.bool_and("is_cs").alias("is_cs"), F.count("*").alias("rows"), F.min("p_partkey").alias("first_part")
    )


@query("result_sinks", """
SELECT fmt, CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal, c_mktsegment
FROM customer, (SELECT unnest(['csv', 'json']) AS fmt)""")
def result_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through both sinks."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = shared_dir(spark, "sinks")
    for fmt in ("csv", "json"):
        writers.write_results(rows, f"{path}/{fmt}", fmt)
    stored = {
        "csv": spark.read.csv(f"{path}/csv", header=True, schema=rows.schema),
        "json": spark.read.schema(rows.schema).json(f"{path}/json"),
    }
    parts = [df.select(F.lit(fmt).alias("fmt"), *rows.columns) for fmt, df in stored.items()]
    return parts[0].unionByName(parts[1])


@query("shard_merge", with_sql("""
SELECT patent_id, CAST(shard AS INTEGER) AS shard, shard = 1 AS is_checkpoint,
       count(paragraph_id) AS paragraphs,
       CAST(count_if(coalesce(contains_answer = 'Y', FALSE)) AS BIGINT) AS yes
FROM (SELECT *, CASE WHEN CAST(patent_id AS BIGINT) % 5 = 0 THEN 3 ELSE CAST(patent_id AS BIGINT) % 3 END AS shard
      FROM reviews)
GROUP BY patent_id, shard
UNION ALL SELECT '(missing)', 4, NULL, NULL, NULL""", fx.REVIEWS))
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five shards: 1 left only a checkpoint, 2 also a stale one, 3 repeats
    patents of the others, 4 delivered nothing."""
    documents = nest_results(fx.reviews(spark, sf_dir))
    number = F.col("patent_id").cast("long")
    shard = (number % 3).cast("int")
    name = lambda n, suffix="": F.concat(F.lit("results_verified_shard_"), n.cast("string"), F.lit(suffix))
    copy = lambda when, file, stale=False: F.when(when, F.struct(file.alias("file"), F.lit(stale).alias("stale")))
    # The documents are nested once; their copies are made where they lie.
    copies = F.array_compact(F.array(
        copy(F.lit(True), F.when(shard == 1, name(shard, "_checkpoint")).otherwise(name(shard))),
        copy(shard == 2, name(shard, "_checkpoint"), True),
        copy(number % 5 == 0, name(F.lit(3))),
    ))
    levels = F.when(F.col("stale"), without_verdicts(documents)).otherwise(F.col("question_types"))
    outputs = documents.select("*", F.inline(copies)).withColumn("question_types", levels).drop("stale")
    path = shared_dir(spark, "shards")
    outputs.write.partitionBy("file").json(path, compression="gzip")
    files = read_shards(spark, path)
    merged, missing = merge_shards(files, 5)
    # Counted where the files are read: only counts and ids are moved.
    version = ["patent_id", "shard", "is_checkpoint"]
    counts = flatten_results(files, version[1:]).groupBy(*version).agg(
        F.count("paragraph_id").alias("paragraphs"),
        F.count_if(F.coalesce(F.col("contains_answer") == "Y", F.lit(False))).alias("yes"),
    )
    rows = merged.select(*version).distinct().join(counts, version)
    absent = missing.select(F.lit("(missing)").alias("patent_id"), "shard")
    return rows.unionByName(absent, allowMissingColumns=True)
