"""Licence texts found by canonical digests, in DataFrame expressions only.

A whole text is brought into a canonical form: lower case, no copyright lines, one
spelling for equivalent words, words between single spaces. Its SHA-256 is joined
with the digests of known licences.

Defined results: null text is empty; a text without words has no digest and matches
nothing; several licences with one digest are listed in order; each input row gives
one output row, also when rows repeat.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagekit.llm.common import fresh, table, text_of
from passagekit.llm.licence_texts import TERMS_END, TITLE, known_forms, long_texts, short_forms
from passagekit.llm.quality import let
from passagekit.plans.registry import query
from passagekit.scale import broadcast_if_small

#: A line that names a holder or a year, in lower case.
COPYRIGHT_LINE = (
    r"(?m)^[ \t/*#;.-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|[<\[{])|(\(c\)|©)[ \t]*[0-9<\[{]|all rights reserved[. \t]*$)[^\n]*$"
)

#: Everything that stands between words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F©®«»–—‘’“”„…]+"

# Equivalent spellings, each with the one that is kept.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("customised", "customized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
)


def canonical(text: str | Column) -> Column:
    """Canonical form: words between single spaces.

    Single words are looked up one by one; the few texts that hold one of the phrases
    go through a replacement of phrases.
    """
    bare = F.regexp_replace(F.lower(text_of(text)), COPYRIGHT_LINE, "")
    single = {old: new for old, new in SPELLINGS if " " not in old}
    phrases = [(old, new) for old, new in SPELLINGS if " " in old]
    kept = F.create_map(*[F.lit(x) for pair in single.items() for x in pair])
    words = F.transform(
        F.filter(F.split(bare, BETWEEN), lambda w: w != ""),
        lambda w: F.when(w.isin(list(single)), F.element_at(kept, w)).otherwise(w),
    )

    def with_phrases(joined: Column) -> Column:
        found = [F.contains(joined, F.lit(f" {old} ")) for old, _ in phrases]
        # Two spaces, so that neighbouring phrases can both be replaced.
        wide = F.replace(joined, F.lit(" "), F.lit("  "))
        for old, new in phrases:
            old, new = ("  ".join(x.split()) for x in (old, new))
            wide = F.replace(wide, F.lit(f" {old} "), F.lit(f" {new} "))
        narrow = F.regexp_replace(wide, " +", " ")
        return F.trim(F.when(reduce(or_, found), narrow).otherwise(joined))

    return let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), with_phrases)


def digest(text: str | Column) -> Column:
    """SHA-256 of the words in canonical form; null if there is none."""
    return let(canonical(text), lambda words: F.when(words != "", F.sha2(words, 256)))


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(licence_id, text) of the given texts, by default the included ones in all forms."""
    rows = known_forms() if texts is None else list(texts.items())
    return spark.createDataFrame(rows, "licence_id string, text string")


def find_licences(
    docs: DataFrame, licences: DataFrame, text_col: str = "text", licence_id: str = "licence_id",
    licence_text: str = "text", out: str = "licence",
) -> DataFrame:
    """``docs`` with a struct ``out``: digest and the ids of the licences it is.

    The table of licences is sent to all workers while it is small.
    """
    key = fresh(docs.columns, "_digest")
    found = (
        licences.select(digest(licence_text).alias(key), F.col(licence_id).cast("string").alias("id"))
        .where(F.col(key).isNotNull() & F.col("id").isNotNull())
        .groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("_licences"))
    )
    joined = docs.drop(out).withColumn(key, digest(text_col)).join(broadcast_if_small(found), key, "left")
    none = F.array().cast("array<string>")
    made = F.struct(F.col(key).alias("digest"), F.coalesce("_licences", none).alias("licences"))
    return joined.select(*[c for c in docs.columns if c != out], made.alias(out))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_rows(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in rows)


def _digest_sql(column: str) -> str:
    bare = f"regexp_replace(lower(coalesce({column}, '')), {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    words = f"'  ' || regexp_replace({bare}, {_sql_text(BETWEEN)}, '  ', 'g') || '  '"
    for spelling, kept in SPELLINGS:
        old, new = ("  ".join(x.split()) for x in (spelling, kept))
        words = f"replace({words}, ' {old} ', ' {new} ')"
    return f"nullif(trim(regexp_replace({words}, ' +', ' ', 'g')), '')"


SQL = f"""
WITH long AS (
  SELECT * FROM (VALUES {_sql_rows(long_texts())}) v(licence_id, text)),
titled AS (SELECT * FROM long UNION ALL SELECT licence_id, regexp_replace(text, {_sql_text(TITLE)}, '') FROM long),
forms AS (
  SELECT * FROM titled
  UNION ALL SELECT licence_id, regexp_replace(text, '{TERMS_END}[\\s\\S]*', '{TERMS_END}') FROM titled
  UNION ALL SELECT licence_id, regexp_replace(text, '{TERMS_END}[\\s\\S]*', '') FROM titled
  UNION ALL SELECT * FROM (VALUES {_sql_rows(short_forms())}) v(licence_id, text)),
known AS (
  SELECT sha256({_digest_sql('text')}) AS digest, list_sort(list(DISTINCT licence_id)) AS licences
  FROM forms GROUP BY 1),
docs AS (SELECT doc_id, {_digest_sql('text')} AS words FROM documents)
SELECT doc_id, sha256(words) AS digest, coalesce(array_to_string(licences, ','), '') AS licences,
       licences IS NOT NULL AS is_licence
FROM docs LEFT JOIN known ON known.digest = sha256(words)
"""


@query("op4_licence", SQL)
def op4_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document, and the licences whose text it is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_licences(docs, known_licences(spark))
    return found.select(
        "doc_id", "licence.digest", F.array_join("licence.licences", ",").alias("licences"),
        (F.size("licence.licences") > 0).alias("is_licence"),
    )
