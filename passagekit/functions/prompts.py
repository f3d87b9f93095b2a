"""Prompt and query text assembled from columns."""

from pyspark.sql import Column, functions as F

# Formats the scorers and the retrieval stages agree on.
SEARCH_TASK = "Given a web search query, retrieve relevant passages that answer the query"
SEARCH_FORMAT = "Instruct: %s\nQuery: %s"
CONTEXT_FORMAT = "Patent Title: %s\nPatent Abstract: %s\nQuestion: %s"
WEB_FORMAT = "Question:%s (context:%s)"

VERDICT_FORMAT = (
    "Decide whether the paragraph below answers the question about the patent.\n"
    "Title: %s\nAbstract: %s\nQuestion: %s\nParagraph: %s\n"
    "Reply with two lines:\nCONTAINS_ANSWER: Y or N\nANSWER: the answer, or N/A"
)
QUESTION_FORMAT = (
    "Patent title: %s\nPatent abstract: %s\n"
    "Write %d questions at the %s level that this patent's field should be able to answer.\n"
    'Reply as JSON: {"1": "...", "2": "...", "3": "..."}'
)
KEYWORD_FORMAT = (
    "Title: %s\nAbstract: %s\nQuestion: %s\n"
    "List the search keywords for this question as search_query=[...]"
)


def _filled(template: str, *columns: Column) -> Column:
    """``format_string`` with nulls shown as empty text."""
    return F.format_string(template, *[F.coalesce(c, F.lit("")) for c in columns])


def search_prompt(question: Column, task: str = SEARCH_TASK) -> Column:
    return _filled(SEARCH_FORMAT, F.lit(task), question)


def rerank_context(title: Column, abstract: Column, question: Column) -> Column:
    return _filled(CONTEXT_FORMAT, title, abstract, question)


def web_query(question: Column, title: Column) -> Column:
    return _filled(WEB_FORMAT, question, title)


def verdict_prompt(title: Column, abstract: Column, question: Column, paragraph: Column) -> Column:
    return _filled(VERDICT_FORMAT, title, abstract, question, paragraph)


def question_prompt(title: Column, abstract: Column, level: Column, number: int = 3) -> Column:
    return F.format_string(QUESTION_FORMAT, title, abstract, F.lit(number), level)


def keyword_prompt(title: Column, abstract: Column, question: Column) -> Column:
    return _filled(KEYWORD_FORMAT, title, abstract, question)
