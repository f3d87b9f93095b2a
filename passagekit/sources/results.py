"""The nested result document, its flat working form, and shard outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagekit import schemas

_BODY_FIELDS = ["cpc", "grant_year", "patent_title", "patent_abstract", "first_question", "question_types"]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents written as JSON lines, one patent (part) per line."""
    return spark.read.schema(schemas.RESULT_DOCUMENT).json(path)


def documents_from_maps(df: DataFrame, column: str) -> DataFrame:
    """Result documents out of text holding one ``{patent_id: {...}}`` map."""
    parsed = F.from_json(column, f"map<string,{schemas.RESULT_BODY}>")
    rows = df.select(F.explode(parsed).alias("patent_id", "body"))
    return rows.select("patent_id", *[F.col(f"body.{name}") for name in _BODY_FIELDS])


def flatten_results(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per retrieved paragraph, with its position in the document.

    A question without papers stays as one row with null paper columns. Columns of the
    documents named in ``keep`` follow.
    """
    start = F.coalesce("first_question", F.lit(0))
    by_level = documents.select("patent_id", *keep, start.alias("_start"), F.explode("question_types").alias("qtype", "questions"))
    by_question = by_level.select(
        "patent_id", *keep, "qtype", "_start", F.posexplode("questions").alias("_pos", "_q")
    )
    by_paper = by_question.select(
        "patent_id",
        *keep,
        "qtype",
        (F.col("_start") + F.col("_pos")).alias("q_idx"),
        F.col("_q.question").alias("question"),
        F.posexplode_outer("_q.retrieved_papers").alias("paper_idx", "_paper"),
    )
    by_paragraph = by_paper.select(
        "patent_id", *keep, "qtype", "q_idx", "question", "paper_idx",
        F.col("_paper.paper_id").alias("paper_id"),
        F.posexplode_outer("_paper.paragraphs").alias("para_idx", "_para"),
    )
    fields = [
        "paragraph_id", "rank", "paragraph_text", "contains_answer", "answer", "error", "rerank_score",
    ]
    return by_paragraph.select(
        "patent_id", "qtype", "q_idx", "question", "paper_idx", "paper_id", "para_idx",
        *[F.col(f"_para.{name}").alias(name) for name in fields], *keep,
    )


def _ordered(fields: Column, position: str) -> Column:
    """Collected structs in position order, without the position."""
    placed = F.struct(F.col(position).alias("_at"), fields.alias("_item"))
    collected = F.collect_list(placed)
    # Entries hold maps, which have no order of their own.
    return F.transform(
        F.array_sort(collected, lambda a, b: a["_at"] - b["_at"]), lambda entry: entry["_item"]
    )


def nest_results(
    flat: DataFrame,
    patents: DataFrame | None = None,
    papers: DataFrame | None = None,
    questions_per_document: int = 1000,
) -> DataFrame:
    """Flat rows back into documents, one per patent.

    Levels are the keys of a map; whichever occur are kept. A row without a level
    belongs to no question and is left out.
    A patent with more than ``questions_per_document`` questions per level is
    continued in further documents that start at ``first_question``, so no
    document grows without bound; ``flatten_results`` restores the positions.
    A question's own list is bounded by the retrieval cut-off. All three
    grouping levels share one shuffle.

    ``patents`` (patent_id, cpc, grant_year, patent_title, patent_abstract)
    and ``papers`` (paper_id, metadata map) are joined in when given.
    """
    width = F.lit(questions_per_document)
    rows = flat.withColumn("first_question", (F.floor(F.col("q_idx") / width) * width).cast("int"))
    if papers is not None:
        rows = rows.join(papers.select("paper_id", "metadata"), "paper_id", "left")
    else:
        rows = rows.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    document = ["patent_id", "first_question"]
    rows = rows.repartition(*document)

    paragraph = F.struct(
        "paragraph_id",
        "rank",
        F.lit(True).alias("has_paragraph"),
        "paragraph_text",
        "contains_answer",
        "answer",
        F.lit(None).cast("string").alias("paragraph_type"),
        "rerank_score",
        "error",
    )
    question = [*document, "qtype", "q_idx"]
    by_paper = rows.groupBy(*question, "question", "paper_idx", "paper_id").agg(
        F.first("metadata").alias("metadata"),
        F.filter(
            _ordered(paragraph, "para_idx"), lambda entry: entry["paragraph_id"].isNotNull()
        ).alias("paragraphs"),
    )
    by_question = by_paper.groupBy(*question, "question").agg(
        F.filter(
            _ordered(F.struct("paper_id", "metadata", "paragraphs"), "paper_idx"),
            lambda entry: entry["paper_id"].isNotNull(),
        ).alias("retrieved_papers")
    )
    stats = F.create_map(
        F.lit("retrieved_papers"), F.size("retrieved_papers").cast("bigint")
    )
    entry = F.struct("question", "retrieved_papers", stats.alias("stats"))
    by_level = by_question.where(F.col("qtype").isNotNull()).groupBy(*document, "qtype").agg(
        _ordered(entry, "q_idx").alias("_questions")
    )
    nested = by_level.groupBy(*document).agg(
        F.map_from_entries(F.collect_list(F.struct("qtype", "_questions"))).alias("question_types")
    )
    if patents is not None:
        nested = nested.join(
            patents.select("patent_id", "cpc", "grant_year", "patent_title", "patent_abstract"),
            "patent_id",
            "left",
        )
    else:
        for name, kind in [("cpc", "string"), ("grant_year", "int"),
                           ("patent_title", "string"), ("patent_abstract", "string")]:
            nested = nested.withColumn(name, F.lit(None).cast(kind))
    return nested.select("patent_id", *_BODY_FIELDS)


def without_verdicts(documents: DataFrame) -> Column:
    """``question_types`` of nested documents with every ``contains_answer`` null."""
    paragraph = lambda p: p.withField("contains_answer", F.lit(None).cast("string"))
    paper = lambda p: p.withField("paragraphs", F.transform(p["paragraphs"], paragraph))
    question = lambda q: q.withField("retrieved_papers", F.transform(q["retrieved_papers"], paper))
    return F.transform_values(documents["question_types"], lambda _, questions: F.transform(questions, question))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all shard outputs with ``shard`` and ``is_checkpoint``.

    Both come from the file's path: ``..._shard_<n>`` or
    ``..._shard_<n>_checkpoint``.
    """
    pattern = r"_shard_(\d+)(_checkpoint)?"
    file_path = F.col("_metadata.file_path")
    return (
        spark.read.schema(schemas.RESULT_DOCUMENT)
        .json(path)
        .withColumn("shard", F.regexp_extract(file_path, pattern, 1).cast("int"))
        .withColumn("is_checkpoint", F.regexp_extract(file_path, pattern, 2) != "")
    )


def merge_shards(documents: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """One version of every patent, and the shards that delivered nothing.

    A shard's checkpoint counts only when its final output is absent; when
    several shards hold a patent, the later shard wins.
    """
    found = documents.groupBy("shard").agg(F.bool_and("is_checkpoint").alias("_only_checkpoint"))
    # At most ``shards`` rows.
    current = documents.join(F.broadcast(found), "shard").where(
        F.col("is_checkpoint") == F.col("_only_checkpoint")
    )
    # Only ids are aggregated; the parts of a patent never have to meet.
    winner = current.groupBy("patent_id").agg(F.max("shard").alias("shard"))
    merged = current.join(winner, ["patent_id", "shard"], "left_semi").drop("_only_checkpoint")
    spark = documents.sparkSession
    expected = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    return merged, expected.join(found, "shard", "left_anti")
