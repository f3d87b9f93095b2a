"""Verdict rows: resume, merging of methods, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagekit.scale import stage
from passagekit.schemas import POSITION_KEY, QUESTION_KEY


def is_yes() -> Column:
    return F.coalesce(F.col("contains_answer") == "Y", F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """Percentage, null on an empty whole."""
    return F.round(F.try_divide(part * 100.0, whole), 6)


def merge_prior(current: DataFrame, prior: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Copy earlier verdicts onto the same positions of the current rows.

    With ``retry_errors`` a verdict that came from a failed call is not
    carried over, so the paragraph is scored again.
    """
    done = prior.where(F.col("contains_answer").isNotNull())
    if retry_errors:
        done = done.where(F.col("error").isNull())
    done = done.select(
        *POSITION_KEY,
        F.lit(True).alias("_done"),
        F.col("contains_answer").alias("_verdict"),
        F.col("answer").alias("_answer"),
        F.col("error").alias("_error"),
    )
    joined = current.join(done, POSITION_KEY, "left")
    taken = F.col("_done").isNotNull()
    return (
        joined.withColumn("contains_answer", F.when(taken, F.col("_verdict")).otherwise(F.col("contains_answer")))
        .withColumn("answer", F.when(taken, F.col("_answer")).otherwise(F.col("answer")))
        .withColumn("error", F.when(taken, F.coalesce("_error", "error")).otherwise(F.col("error")))
        .select(*current.columns)
    )


def pending(todo: DataFrame, done: DataFrame, keys: str | list[str]) -> DataFrame:
    """Work not yet present in ``done``."""
    names = [keys] if isinstance(keys, str) else keys
    return todo.join(done.select(*names).distinct(), names, "left_anti")


def question_yes(flat: DataFrame) -> DataFrame:
    """Number of yes verdicts per question with paragraphs, and whether there is one."""
    return flat.where(F.col("paragraph_id").isNotNull()).groupBy(*QUESTION_KEY).agg(
        F.count_if(is_yes()).alias("yes_count"), F.bool_or(is_yes()).alias("has_yes")
    )


def _question_summary(flat: DataFrame) -> DataFrame:
    return flat.groupBy(*QUESTION_KEY).agg(
        F.count("paper_id").alias("paragraphs"), F.count_if(is_yes()).alias("yes")
    )


def verification_stats(flat: DataFrame) -> DataFrame:
    """Questions and paragraphs with a yes, as counts and percentages."""
    totals = _question_summary(flat).agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("paragraphs") > 0).alias("questions_with_papers"),
        F.count_if(F.col("yes") > 0).alias("questions_with_yes"),
        F.coalesce(F.sum("paragraphs"), F.lit(0)).alias("paragraphs"),
        F.coalesce(F.sum("yes"), F.lit(0)).alias("paragraphs_with_yes"),
    )
    return (
        totals.withColumn(
            "pct_of_questions_with_papers",
            percent(F.col("questions_with_yes"), F.col("questions_with_papers")),
        )
        .withColumn("pct_of_questions", percent(F.col("questions_with_yes"), F.col("questions")))
        .withColumn("pct_of_paragraphs", percent(F.col("paragraphs_with_yes"), F.col("paragraphs")))
    )


def run_report(flat: DataFrame) -> DataFrame:
    """Processed, verified, failed and missing-text paragraphs of a run.

    A paragraph without text was never judged: it counts as missing, and neither as
    verified nor as an error, whatever a run wrote into its row.
    """
    rows = flat.where(F.col("paragraph_id").isNotNull())
    judged = F.col("paragraph_text").isNotNull()
    return rows.agg(
        F.count("*").alias("processed"),
        F.count_if(judged & F.col("contains_answer").isNotNull()).alias("verified"),
        F.count_if(judged & F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("paragraph_text").isNull()).alias("missing_texts"),
        F.count_if(judged & is_yes()).alias("yes"),
    ).withColumn("yes_pct", percent(F.col("yes"), F.greatest("verified", F.lit(1))))


def method_status(first: DataFrame, second: DataFrame) -> DataFrame:
    """Status of every question for which the second method found papers."""
    summary = lambda df, name: _question_summary(df).select(
        *QUESTION_KEY, F.col("paragraphs").alias(f"{name}_rows"), (F.col("yes") > 0).alias(f"{name}_yes")
    )
    both = summary(first, "first").join(summary(second, "second"), QUESTION_KEY)
    status = (
        F.when(F.col("first_yes") & F.col("second_yes"), "both")
        .when(F.col("first_yes"), "first_only")
        .when(F.col("second_yes"), "second_only")
        .otherwise("neither")
    )
    return both.where(F.col("second_rows") > 0).select(*QUESTION_KEY, status.alias("status"))


def merge_methods(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first method, plus the second's first paper holding a yes
    for every question only the second method answered."""
    status = method_status(first, second)
    gaps = stage(status.where(F.col("status") == "second_only").select(*QUESTION_KEY), "gaps")
    wanted = (
        second.where(F.col("contains_answer") == "Y")
        .join(gaps, QUESTION_KEY, "left_semi")
        .groupBy(*QUESTION_KEY)
        .agg(F.min("paper_idx").alias("paper_idx"))
    )
    last = first.groupBy(*QUESTION_KEY).agg((F.max("paper_idx") + 1).alias("_next"))
    added = (
        second.join(wanted, [*QUESTION_KEY, "paper_idx"], "left_semi")
        .join(last, QUESTION_KEY, "left")
        .withColumn("paper_idx", F.coalesce("_next", F.lit(0)))
        .drop("_next")
    )
    # A question that had no paper gives up its empty row for the added paper.
    empty = first.where(F.col("paper_id").isNull()).join(gaps, QUESTION_KEY, "left_anti")
    kept = first.where(F.col("paper_id").isNotNull())
    return kept.unionByName(empty).unionByName(added.select(*first.columns))


def method_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """Answered questions by method, with success rates."""
    of = lambda name: F.count_if(F.col("status") == name)
    # All questions of the patents that both methods have.
    shared = first.select("patent_id").distinct().join(second.select("patent_id").distinct(), "patent_id", "left_semi")
    asked = first.select(*QUESTION_KEY).distinct().join(shared, "patent_id", "left_semi")
    counts = method_status(first, second).agg(
        asked.agg(F.count("*").alias("n")).scalar().alias("questions"),
        F.count("*").alias("compared"),
        of("first_only").alias("first_only"),
        of("second_only").alias("second_only"),
        of("both").alias("both"),
        of("neither").alias("neither"),
    )
    answered = F.col("first_only") + F.col("second_only") + F.col("both")
    return (
        counts.withColumn("combined_pct", percent(answered, F.col("compared")))
        .withColumn("first_pct", percent(F.col("first_only") + F.col("both"), F.col("compared")))
        .withColumn("second_pct", percent(F.col("second_only") + F.col("both"), F.col("compared")))
    )


def answered_by_both(first: DataFrame, second: DataFrame, limit: int = 20) -> DataFrame:
    """The first questions both methods answered, with their text."""
    texts = first.groupBy(*QUESTION_KEY).agg(F.max("question").alias("question"))
    return (
        method_status(first, second)
        .where(F.col("status") == "both")
        .join(texts, QUESTION_KEY)
        .orderBy(*QUESTION_KEY)
        .limit(limit)
    )


def error_log(flat: DataFrame) -> DataFrame:
    """Paragraphs whose verdict could not be obtained, and why."""
    return flat.where(F.col("error").isNotNull()).select(*POSITION_KEY, "paragraph_id", "error")


def results_summary(flat: DataFrame) -> DataFrame:
    """Questions of every patent, in all and per level that occurs."""
    counts = flat.select(*QUESTION_KEY).distinct().groupBy("patent_id", "qtype").agg(F.count("*").alias("_n"))
    counts = stage(counts, "question-counts")
    levels = [row.qtype for row in counts.select("qtype").distinct().orderBy("qtype").collect() if row.qtype is not None]
    return counts.groupBy("patent_id").agg(
        F.sum("_n").alias("questions"),
        *[F.coalesce(F.sum(F.when(F.col("qtype") == level, F.col("_n"))), F.lit(0)).alias(level) for level in levels],
    )


def paper_listing(flat: DataFrame, papers: int = 5) -> DataFrame:
    """Per question: number of papers and the first few with their paragraphs.

    A question's papers are bounded by the retrieval cut-off.
    """
    listed = (
        flat.where(F.col("paper_id").isNotNull())
        .groupBy(*QUESTION_KEY, "paper_idx", "paper_id")
        .agg(F.sort_array(F.collect_list(F.struct("para_idx", "paragraph_id"))).alias("_paras"))
    )
    names = F.array_join(F.col("_paras.paragraph_id"), ", ")
    entries = listed.withColumn("_line", F.concat_ws(": ", "paper_id", names))
    grouped = entries.groupBy(*QUESTION_KEY).agg(
        F.count("*").alias("papers"),
        F.sort_array(F.collect_list(F.struct("paper_idx", "_line"))).alias("_all"),
    )
    shown = F.array_join(F.slice(F.col("_all._line"), 1, papers), " | ")
    return grouped.select(*QUESTION_KEY, "papers", shown.alias("top_papers"))
