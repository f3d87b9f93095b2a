"""Turning model responses into columns."""

from pyspark.sql import Column, DataFrame, functions as F

# Markers of the response format and the messages stored on failure.
VERDICT_MARK = "CONTAINS_ANSWER:"
ANSWER_MARK = "ANSWER:"
NO_ANSWER = "N/A"
EMPTY_RESPONSE = "Model produced no structured output"
MISSING_TEXT = "Paragraph text not found"

BLANKS = " \t\r\n\f\x0b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _last_marked(lines: Column, mark: str, drop: str | None = None) -> Column:
    """Trimmed remainder of the last line that starts with ``mark``."""
    values = F.transform(
        F.filter(lines, lambda line: line.startswith(mark)),
        lambda line: strip(F.substring(line, len(mark) + 1, F.length(line))),
    )
    if drop is not None:
        values = F.filter(values, lambda value: value != drop)
    return F.get(values, F.size(values) - 1)


def parse_verdicts(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``contains_answer``, ``answer`` and ``error`` parsed from a response.

    The last verdict line counts. A verdict other than exactly Y or N means Y
    only when it contains "yes". The last answer line that is not "N/A" is
    kept whatever the verdict. An empty response is an N with an error.
    """
    text = strip(F.coalesce(F.col(response), F.lit("")))
    lines = F.split(text, "\n")
    raw = F.upper(_last_marked(lines, VERDICT_MARK))
    verdict = (
        F.when(raw.isNull(), "N")
        .when(raw.isin("Y", "N"), raw)
        .when(raw.contains("YES"), "Y")
        .otherwise("N")
    )
    empty = text == ""
    return (
        df.withColumn("contains_answer", verdict)
        .withColumn("answer", _last_marked(lines, ANSWER_MARK, drop=NO_ANSWER))
        .withColumn("error", F.when(empty, F.lit(EMPTY_RESPONSE)))
    )


def question_map(response: str | Column) -> Column:
    """First ``{...}`` block of a response as a map; null when it is no JSON."""
    block = F.regexp_extract(response, r"(?s)\{.*?\}", 0)
    return F.from_json(block, "map<string,string>")


def parse_questions(
    df: DataFrame, response: str = "response", expected: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Questions (one row each) and the responses that did not parse.

    A response counts only when it holds exactly ``expected`` questions.
    """
    parsed = df.withColumn("_questions", question_map(response))
    good = F.coalesce(F.size("_questions") == expected, F.lit(False))
    kept = [name for name in df.columns if name != response]
    questions = parsed.where(good).select(
        *kept, F.explode("_questions").alias("question_id", "question")
    )
    return questions, parsed.where(~good).drop("_questions")


def keyword_list(response: str | Column) -> Column:
    """First ``[...]`` block of a response as strings, else an empty list."""
    block = F.regexp_extract(response, r"(?s)\[.*?\]", 0)
    return F.coalesce(F.from_json(block, "array<string>"), F.array().cast("array<string>"))
