"""Quality rules by distribution divergence, in DataFrame expressions only.

A language reference is a histogram over character classes and one over the
language's most common words, both summed over all documents of the language; every
language that has a word gets one, however rare it is. Every document, whatever its
language is said to be, is compared with every reference, and passes when the
Jensen-Shannon distances of its own two histograms to at least one of them stay below
their limits. Texts too short for a histogram are not judged by it. A base rule rejects
short texts and texts that repeat themselves.

References are a table with a row per language and are joined in blocks of languages, not
collected.

Defined results: null text is empty and fails the base rule; without any reference the
base rule decides alone; the distances of a document whose own language is null or has no
reference are null; each input row gives one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from passagekit.llm.common import SPACE, fresh, table, text_of
from passagekit.plans.registry import query
from passagekit.scale import broadcast_if_small, stage

# Fixed values of the result contract.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

#: Character classes, taken away from the text in this order.
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", f"[{SPACE}]+"),
    ("letter", r"[^\x00-\x7F]+"),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
    ("stop", "[.,]+"),
    ("mark", r"[;:!?'\x22()-]+"),
)
OTHER = "other"

COMMON_WORDS = 60

#: Different repeated windows of a text up to which its windows are looked for among them.
FEW_REPEATS = 32

#: Languages that a row is compared with at a time, and in all blocks that are broadcast.
BLOCK_LANGUAGES = 16
BROADCAST_LANGUAGES = 10_000

#: Guards: shorter texts are not judged by the histogram.
MIN_CHARS_JUDGED = 200
MIN_WORDS_JUDGED = 100

MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.39


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters (ASCII letters and all beyond ASCII)."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x60\x7B-\x7F]+"), "")


def class_counts(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with a struct ``out``: code points of each character class.

    Each class is taken out of what the classes before it left, so that only the first
    pattern runs over the whole text; it takes blanks along, which are counted apart.
    """
    left = [fresh(df.columns, f"_{out}_{i}") for i in range(len(CLASSES) + 1)]
    blanks = fresh([*df.columns, *left], f"_{out}_blanks")
    df = df.withColumn(left[0], text_of(text_col))
    size = lambda name: F.length(name).cast("long")
    # Blanks lie between most words; with them taken away, whole sentences are one run.
    df = df.withColumn(blanks, size(left[0]) - F.length(F.replace(left[0], F.lit(" "), F.lit(""))))
    df = df.withColumn(left[1], F.regexp_replace(left[0], "[a-z ]+", ""))
    for i, (_, pattern) in enumerate(CLASSES[1:], 1):
        df = df.withColumn(left[i + 1], F.regexp_replace(left[i], pattern, ""))
    taken = {name: size(a) - size(b) for a, b, (name, _) in zip(left, left[1:], CLASSES)}
    taken |= {"lower": taken["lower"] - F.col(blanks), "space": taken["space"] + F.col(blanks)}
    symbols = size(F.regexp_replace(left[-1], f"[^{SYMBOLS}]+", "")).alias("symbols")
    fields = [value.alias(name) for name, value in taken.items()]
    return df.withColumn(out, F.struct(*fields, size(left[-1]).alias(OTHER), symbols)).drop(*left, blanks)


def window_hashes(words: Column, window: int) -> Column:
    """Hashes of all runs of ``window`` words; null for a text with fewer."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, window)]))
    return F.when(F.size(words) >= window, F.slice(hashes, F.lit(1), F.size(words) - (window - 1)))


def repeated_words(hashes: Column, window: int = 3) -> Column:
    """Words that lie in a window of words found twice or more."""

    def starts(hashes: Column, repeats: Column) -> Column:
        """Places of windows found twice or more; few different ones are looked for one by one."""
        at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        few = F.filter(at, lambda x: F.array_contains(repeats, x["h"]))
        ordered = lambda s: F.filter(s, lambda x, k: (
            (F.get(s, k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        ))
        many = F.sort_array(F.transform(let(F.sort_array(at), ordered), lambda x: x["i"]))
        return F.when(F.size(repeats) <= FEW_REPEATS, F.transform(few, lambda x: x["i"])).otherwise(many)

    def covered(hashes: Column) -> Column:
        repeats = let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, k: F.coalesce(h == F.get(s, k + 1), F.lit(False))))
        step = lambda acc, at: F.struct(
            at.alias("last"), (acc["n"] + F.least(F.lit(window), at - acc["last"])).alias("n")
        )
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(let(F.array_distinct(repeats), lambda r: starts(hashes, r)), start, step, lambda acc: acc["n"])

    again = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(hashes.isNotNull() & again, covered(hashes)).otherwise(F.lit(0)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def term_counts(ordered: Column) -> Column:
    """array<struct<word, n>> of a sorted array of words."""

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        first = F.filter(
            F.transform(ordered, lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
            lambda x: (x["at"] == 0) | (F.get(ordered, x["at"] - 1) != x["word"]),
        )
        return let(first, lambda f: F.transform(f, lambda x, k: F.struct(
            x["word"].alias("word"), (F.coalesce(F.get(f, k + 1)["at"], size) - x["at"]).alias("n")
        )))

    return runs(ordered)


def _bucket(word: Column, buckets: int) -> Column:
    """``buckets`` is a power of two."""
    return F.hash(word).bitwiseAND(F.lit(buckets - 1))


def in_bucket(dealt: Column, word: Column, buckets: int) -> Column:
    """Whether the array of arrays ``dealt`` holds the word in its bucket."""
    return F.array_contains(F.get(dealt, _bucket(word, buckets)), word)


def language_references(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON_WORDS
) -> DataFrame:
    """A stored table with a row per language that has a word.

    ``classes`` holds the shares of the character classes, ``words`` the share of each of
    the ``common`` most frequent words, ``covered`` their sum.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text")).where(F.col("lang").isNotNull())
    classes = [name for name, _ in CLASSES] + [OTHER]
    sums = class_counts(texts, "text", "chars").groupBy("lang").agg(*[F.sum(F.col("chars")[c]).alias(c) for c in classes])
    counts = stage(
        texts.select("lang", F.explode(F.split(F.lower("text"), r"[\x00-\x60\x7B-\x7F]+")).alias("word")).where(F.col("word") != "").groupBy("lang", "word").agg(F.count("*").alias("n")),
        "word-counts",
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common)
    # At most ``common`` words per language.
    words = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("top"))
    chars = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    share = F.transform("top", lambda t: t["n"].cast("double") / F.col("total"))
    made = sums.join(totals, "lang").join(words, "lang").select(
        "lang", F.array(*[F.col(c).cast("double") / chars for c in classes]).alias("classes"),
        F.map_from_arrays(F.transform("top", lambda t: t["word"]), share).alias("words"),
        F.aggregate(share, F.lit(0.0), lambda a, x: a + x).alias("covered"),
    )
    return stage(made, "language-references")


def _half(p: Column, q: Column) -> Column:
    """Share of one bin in the divergence, in bits; ``p`` and ``q`` are not negative."""
    m = (p + q) / 2
    left = F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    right = F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))
    return (left + right) / 2


def char_distance(own: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of the shares of the character classes."""
    bins = [_half(F.get(own, F.lit(i)), F.get(shares, F.lit(i))) for i in range(len(CLASSES) + 1)]
    return F.sqrt(F.greatest(sum(bins[1:], bins[0]), F.lit(0.0)))


def word_distance(terms: Column, place: Column, covered: Column) -> Column:
    """Jensen-Shannon distance of the common words, all other words in one bin.

    ``terms`` holds the share ``p`` of each common word that the text has and its shares
    ``q`` in all languages of a block, of which the one at ``place`` counts, each with
    ``e``, the share times its logarithm. A common word that the text lacks adds half its
    share. A word of both adds (p + q + p log p + q log q - (p + q) log(p + q)) / 2, so that
    the shares ``q`` add up to half of ``covered`` with those of the words that it lacks.
    """
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("e"))

    def step(acc: Column, t: Column) -> Column:
        said = F.get(t["q"], place)
        both = t["p"] + said["q"]
        more = F.struct((acc["p"] + t["p"]).alias("p"), (acc["e"] + (t["e"] + said["e"] - both * F.log2(both))).alias("e"))
        return F.when(said["q"] > 0, more).otherwise(acc)

    rest = lambda acc: (covered + acc["p"] + acc["e"]) / 2 + _half(
        F.greatest(1 - acc["p"], F.lit(0.0)), F.greatest(1 - covered, F.lit(0.0))
    )
    return F.sqrt(F.greatest(F.aggregate(terms, zero, step, rest), F.lit(0.0)))


def _with_log(share: Column) -> Column:
    return F.when(share > 0, share * F.log2(share)).otherwise(F.lit(0.0))


def reference_blocks(references: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """A stored table (block, book) with the languages dealt into blocks by hash.

    A book has its languages in order, their common words dealt into ``buckets`` arrays,
    so that a look-up compares few of them, and at the same places the words' shares in
    every language of the block.
    """
    block = F.pmod(F.xxhash64("lang"), F.lit(blocks)).cast("int").alias("block")
    # About BLOCK_LANGUAGES languages to a block.
    books = references.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("lang", "classes", "covered"))).alias("languages"), F.sort_array(
        F.collect_list(F.struct("lang", F.map_keys("words").alias("words"), F.map_values("words").alias("shares")))
    ).alias("said"))
    words = F.array_distinct(F.flatten(F.transform("said", lambda s: s["words"])))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.filter(words, lambda w: _bucket(w, buckets) == i))
    found = lambda w, s: F.coalesce(F.get(s["shares"], F.array_position(s["words"], w).cast("int") - 1), F.lit(0.0))
    share = lambda w: F.transform(F.transform("said", lambda s: found(w, s)), lambda q: F.struct(q.alias("q"), _with_log(q).alias("e")))
    books = books.withColumn("dealt", dealt).withColumn("shares", F.transform("dealt", lambda b: F.transform(b, share)))
    return stage(books.select("block", F.struct("languages", "dealt", "shares").alias("book")), "reference-blocks")


def compared(
    df: DataFrame, books: DataFrame, blocks: int, buckets: int, chars: str, size: Column, letters: str, lang: Column,
    out: str, min_chars: int, min_words: int, passes,
) -> DataFrame:
    """``df``, each row once per block, with a struct ``out`` over the languages of the block.

    ``passes`` is the condition on two distances.
    """
    place, ref, known, terms, near = (fresh([*df.columns, out], f"_{x}") for x in ("block", "book", "known", "terms", "near"))
    side = books.select(F.col("block").alias(place), F.col("book").alias(ref))
    df = df.withColumn(place, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(side, place, "left")
    book = F.col(ref)
    df = df.withColumn(known, F.sort_array(F.filter(letters, lambda w: in_bucket(book["dealt"], w, buckets))))
    total = F.size(letters)

    def looked_up(t: Column) -> Column:
        bucket = _bucket(t["word"], buckets)
        at = F.array_position(F.get(book["dealt"], bucket), t["word"]).cast("int") - 1
        return F.struct((t["n"] / total).alias("p"), _with_log(t["n"] / total).alias("e"), F.get(F.get(book["shares"], bucket), at).alias("q"))

    df = df.withColumn(terms, F.transform(term_counts(F.col(known)), looked_up))
    judged_chars, judged_words = size >= max(min_chars, 1), total >= max(min_words, 1)
    names = [name for name, _ in CLASSES] + [OTHER]
    own = F.struct(F.col(terms).alias("terms"), let(size, lambda n: F.array(*[F.try_divide(F.col(chars)[c], n) for c in names])).alias("classes"))
    # Worked out before the languages are gone through, not again for each of them.
    df = df.withColumn(near, let(own, lambda o: F.transform(book["languages"], lambda r, i: F.struct(
        F.when(judged_chars, char_distance(o["classes"], r["classes"])).otherwise(F.lit(0.0)).alias("char"),
        F.when(judged_words, word_distance(o["terms"], i, r["covered"])).otherwise(F.lit(0.0)).alias("word"),
        r["lang"].alias("lang"),
    ))))
    found = F.struct(
        F.get(F.filter(near, lambda d: d["lang"] == lang), F.lit(0)).alias("own"),
        F.size(F.filter(near, lambda d: passes(d["char"], d["word"]))).cast("long").alias("n_passing"),
        F.array_min(F.transform(near, lambda d: F.struct(
            (d["char"] + d["word"]).alias("sum"), d["char"].alias("char"), d["word"].alias("word"), d["lang"].alias("lang")
        ))).alias("nearest"),
    )
    return df.withColumn(out, F.when(book.isNotNull(), found)).drop(place, ref, known, terms, near)


def assess(
    docs: DataFrame,
    references: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    out: str = "quality",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS_JUDGED,
    min_words: int = MIN_WORDS_JUDGED,
) -> DataFrame:
    """``docs`` with a struct ``out``: counts, distances and the verdict ``kept``.

    ``references`` is a stored table. ``language`` and the distances are those of the
    document's own language, null without a reference; ``n_passing`` is the number of
    references that are near enough, ``nearest`` the language with the smallest sum of
    both distances.
    """
    plain = list(docs.columns)
    name = lambda base: fresh(plain, base)
    languages = references.count()
    blocks = max(1, -(-languages // BLOCK_LANGUAGES))
    buckets = 1 << (COMMON_WORDS * min(max(languages, 1), BLOCK_LANGUAGES) - 1).bit_length()
    books = reference_blocks(references, blocks, buckets)
    books = F.broadcast(books) if languages <= BROADCAST_LANGUAGES else books
    chars, base, row, judged = name("_chars"), name("_base"), name("_row"), name("_judged")
    words, hashes, letters = (name(x) for x in ("_words", "_windows", "_letters"))
    text, lang = text_of(text_col), F.col(lang_col).cast("string")
    total = sum((F.col(chars)[c] for c, _ in CLASSES[1:]), F.col(chars)[CLASSES[0][0]]) + F.col(chars)[OTHER]
    size = total.cast("long")
    passes = lambda char, word: (char <= max_char_distance) & (word <= max_word_distance)
    near = lambda df: compared(
        class_counts(df, text_col, chars).withColumn(letters, letter_words(text)),
        books, blocks, buckets, chars, size, letters, lang, judged, min_chars, min_words, passes,
    )
    if blocks == 1:
        df = near(docs)
    else:
        # Rows meet every block; what they found there comes together by their number.
        held = stage(docs.withColumn(row, F.monotonically_increasing_id()), "quality-rows")
        met = near(held).groupBy(row).agg(F.struct(
            F.max(f"{judged}.own").alias("own"), F.sum(f"{judged}.n_passing").alias("n_passing"),
            F.min(f"{judged}.nearest").alias("nearest"),
        ).alias(judged))
        df = class_counts(held.join(met, row), text_col, chars)
    # Columns of their own, so that each is computed once and compiled where it can be.
    df = df.withColumn(words, F.array_remove(F.split(text, f"[{SPACE}]+"), ""))
    df = df.withColumn(hashes, window_hashes(F.col(words), 3))
    df = df.withColumn(base, F.struct(
        F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(F.col(hashes)).alias("n_repeat_words")).alias("counted"),
        repeated_lines(text).alias("n_dup_lines"),
    ))
    n_words, n_repeat = F.col(base)["counted"]["n_words"], F.col(base)["counted"]["n_repeat_words"]
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    verdict = let(F.col(judged), lambda d: F.struct(
        n_words.alias("n_words"),
        (size - F.col(chars)["space"]).alias("word_chars"),
        F.col(chars)["symbols"].alias("n_symbols"),
        F.col(base)["n_dup_lines"].alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & F.coalesce(d["n_passing"] > 0, F.lit(True))).alias("kept"),
        d["own"]["lang"].alias("language"),
        d["own"]["char"].alias("char_distance"),
        d["own"]["word"].alias("word_distance"),
        d["n_passing"].alias("n_passing"),
        d["nearest"]["lang"].alias("nearest"),
    ))
    kept = [c for c in plain if c != out]
    # Always true, but not known to be: a filter on the verdict then stays above it
    # instead of being pushed down with copies of all the expressions.
    once = F.when(F.monotonically_increasing_id() >= 0, verdict)
    return df.select(*kept, once.alias(out))


def without_rejected(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """The documents that pass, in their own columns."""
    out = fresh(docs.columns, "quality")
    judged = assess(docs, language_references(docs, text_col, lang_col), text_col, lang_col, out, **limits)
    return judged.where(F.col(out)["kept"]).select(*docs.columns)


def _half_sql(p: str, q: str) -> str:
    side = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0.0 END"
    return f"({side(p)} + {side(q)}) / 2"


def _classes_sql() -> str:
    """The text after each class is taken away: t0 to t7."""
    steps = "SELECT *, coalesce(text, '') AS t0 FROM numbered"
    for i, (_, pattern) in enumerate(CLASSES):
        steps = f"SELECT *, regexp_replace(t{i}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS t{i + 1} FROM ({steps})"
    return steps


_SIZES = ", ".join([f"length(t{i}) - length(t{i + 1})" for i in range(len(CLASSES))] + [f"length(t{len(CLASSES)})"])
_BINS = len(CLASSES) + 1

SQL = f"""
WITH numbered AS (SELECT doc_id, lang, text, row_number() OVER () AS r FROM documents),
split AS (
  SELECT doc_id, lang, r, [{_SIZES}] AS bins, length(t0) AS chars,
         length(regexp_replace(t{len(CLASSES)}, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
         regexp_extract_all(t0, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split_regex(lower(t0), '[\\x00-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS letters,
         list_filter(string_split(t0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM ({_classes_sql()})),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_slice(w, 1, len(w) - 2)) AS a,
               unnest(list_slice(w, 2, len(w) - 1)) AS b, unnest(list_slice(w, 3, len(w))) AS c
        FROM split WHERE len(w) >= 3)),
again AS (
  SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY r),
base AS (
  SELECT split.*, len(w) AS n_words, chars - bins[2] AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat, 0) AS n_repeat_words,
         len(w) < {MIN_WORDS} OR 100 * coalesce(n_repeat, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed
  FROM split LEFT JOIN again ON again.r = split.r),
languages AS (
  SELECT lang, [{', '.join(f'sum(bins[{i}])' for i in range(1, _BINS + 1))}] AS sums, sum(chars) AS chars, sum(len(letters)) AS words
  FROM split WHERE lang IS NOT NULL GROUP BY lang HAVING sum(len(letters)) > 0),
word_counts AS (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(letters) AS word FROM split WHERE lang IS NOT NULL) GROUP BY lang, word),
common AS (
  SELECT c.lang, word, n / words AS q FROM word_counts c JOIN languages l ON l.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang ORDER BY n DESC, word) <= {COMMON_WORDS}),
covered AS (SELECT lang, sum(q) AS all_q FROM common GROUP BY lang),
terms AS (
  SELECT r, word, count(*) / any_value(size) AS p
  FROM (SELECT r, len(letters) AS size, unnest(letters) AS word FROM split) GROUP BY r, word),
met AS (
  SELECT r, lang, sum({_half_sql('p', 'q')}) AS d, sum(p) AS p, sum(q) AS q
  FROM terms JOIN common ON common.word = terms.word GROUP BY r, lang),
distances AS (
  SELECT b.r, l.lang, b.lang = l.lang AS own,
         CASE WHEN b.chars >= {MIN_CHARS_JUDGED} THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, {_BINS + 1}),
           lambda i: {_half_sql('(b.bins[i] / b.chars)', '(l.sums[i] / l.chars)')})))) ELSE 0.0 END AS cd,
         CASE WHEN len(b.letters) >= {MIN_WORDS_JUDGED} THEN sqrt(greatest(0.0,
           coalesce(m.d, 0.0) + (all_q - coalesce(m.q, 0.0)) / 2
           + {_half_sql('greatest(1 - coalesce(m.p, 0.0), 0.0)', 'greatest(1 - all_q, 0.0)')})) ELSE 0.0 END AS wd
  FROM base b CROSS JOIN languages l JOIN covered v ON v.lang = l.lang LEFT JOIN met m ON m.r = b.r AND m.lang = l.lang),
judged AS (
  SELECT r, count(*) FILTER (cd <= {MAX_CHAR_DISTANCE} AND wd <= {MAX_WORD_DISTANCE}) AS n_passing,
         max(lang) FILTER (own) AS lang, max(cd) FILTER (own) AS cd, max(wd) FILTER (own) AS wd,
         arg_min(lang, struct_pack(s := cd + wd, cd := cd, wd := wd, lang := lang)) AS nearest
  FROM distances GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(n_passing > 0, TRUE) AS kept, j.lang AS language,
       round(cd, 6) AS char_distance, round(wd, 6) AS word_distance, n_passing, nearest
FROM base LEFT JOIN judged j ON j.r = base.r
"""


@query("op1_quality", SQL)
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = assess(docs, language_references(docs))
    return judged.select("doc_id", "quality.*").withColumns({
        name: F.round(name, 6) for name in ("char_distance", "word_distance")
    })
