"""Tokenising and word-set expressions, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Token pattern and prompt markers shared with the result contract.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
PREVIOUS_MARK = "[Previous paragraph]: "
NEXT_MARK = "[Next paragraph]: "


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits; null text has no tokens."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))),
        F.lit(TOKEN_PATTERN),
        F.lit(0),
    )


def without_words(words: Sequence[str]) -> Callable[[str | Column], Column]:
    """Like ``tokens``, leaving out the given (stop) words."""
    unwanted = list(words)
    return lambda text: F.filter(tokens(text), lambda token: ~token.isin(unwanted))


def word_set(text: str | Column) -> Column:
    """Distinct lower-cased whitespace-separated words."""
    words = F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"\s+")
    return F.array_distinct(F.filter(words, lambda word: word != ""))


def overlap(left: Column, right: Column) -> Column:
    """``|L ∩ R| / max(|L|, |R|, 1)`` of two word sets."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    return shared / F.greatest(F.size(left), F.size(right), F.lit(1))


def coverage(needed: Column, offered: Column) -> Column:
    """Share of ``needed`` found in ``offered``; null when nothing is needed."""
    shared = F.size(F.array_intersect(needed, offered)).cast("double")
    return F.try_divide(shared, F.size(needed).cast("double"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A column used inside a lambda may be inlined by the optimizer and then be
    computed per element; a lambda variable cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run_lengths(ordered: Column) -> Column:
    """``array<struct<term,tf>>`` of a sorted, non-empty token array."""
    positions = F.sequence(F.lit(0), F.size(ordered) - 1)
    starts = F.filter(
        positions, lambda at: (at == 0) | (F.get(ordered, at) != F.get(ordered, at - 1))
    )
    entries = lambda begin: F.transform(
        begin,
        lambda at, nth: F.struct(
            F.get(ordered, at).alias("term"),
            (F.coalesce(F.get(begin, nth + 1), F.size(ordered)) - at).alias("tf"),
        ),
    )
    return _let(starts, entries)


def with_term_counts(
    df: DataFrame, text: str, analyse: Callable[[str | Column], Column] = tokens
) -> DataFrame:
    """Add ``doc_len`` and ``terms array<struct<term,tf>>`` without a shuffle.

    Sorting the tokens of a row puts equal terms next to each other; run
    starts then give the counts, in time linear in the row after the sort.
    """
    found = analyse(text)
    counted = F.when(F.size(found) > 0, _let(F.sort_array(found), _run_lengths))
    return df.withColumn("doc_len", F.size(found)).withColumn("terms", counted)


def head_tail(df: DataFrame, text: str, max_tokens: int) -> DataFrame:
    """Split a text of more than ``max_tokens`` words into its two ends.

    One row per kept piece: ``part`` 0 is the head (or the whole text), 1 the
    tail; ``weight`` is the piece's token count, 1 for an empty text. A piece
    of a long text is its tokens joined by one space.
    """
    half = max_tokens // 2
    marked = df.withColumn("_tokens", tokens(text))
    count = F.size("_tokens")
    piece = lambda part, start: F.struct(
        F.lit(part).alias("part"),
        F.array_join(F.slice("_tokens", start, F.lit(half)), " ").alias("chunk"),
        F.lit(half).alias("weight"),
    )
    whole = F.struct(
        F.lit(0).alias("part"),
        F.col(text).alias("chunk"),
        F.greatest(count, F.lit(1)).alias("weight"),
    )
    # A long text has more than max_tokens >= half tokens, so start is positive.
    pieces = F.when(
        count > max_tokens,
        F.array(piece(0, F.lit(1)), piece(1, F.greatest(count - half + 1, F.lit(1)))),
    ).otherwise(F.array(whole))
    kept = [name for name in df.columns if name != text]
    return marked.select(*kept, F.inline(pieces))
