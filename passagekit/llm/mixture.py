"""Mixing sources to target weights by repeating documents.

Tokens are summed per source, the total is shared out by weight, and the share of a
source divided by its size is the repetition rate of its documents: floor(rate)
copies, and one more with a probability equal to the fraction, drawn from a seeded
hash of the document's id and text and of its number among equal rows, so that reruns and
lost executors give the same mix, and repeated or missing ids draw on their own.

Defined results: null text has size 0; documents without a source form the source
null; repeated rows are documents of their own, each with its own draw; a source of
size 0 gets the target 0; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagekit.llm.common import fresh, table, text_of, word_count
from passagekit.plans.registry import query
from passagekit.scale import broadcast_if_small, row_index, stage

MAX_REPEAT = 3
SEED = "mix"

#: Fixed values of the result contract: weights of the ordered sources, repeating.
WEIGHTS = (5, 2, 1)


def source_sizes(docs: DataFrame, source_col: str, size: Column) -> DataFrame:
    """(source, source_size), one row per source; a narrow stored table."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size")
    )
    return stage(sizes, "source-sizes")


def ranked_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources in code-point order, null last, with the weights dealt in turn."""
    keyed = sizes.withColumn("_null", F.col("source").isNull())
    placed = row_index(keyed, ["_null", "source"], "_place")
    turn = F.pmod("_place", F.lit(len(weights)))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), turn.cast("int"))
    return placed.select("source", "source_size", weight.cast("long").alias("weight"))


def targets(sized: DataFrame, total: float | None = None, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sized`` (source, source_size, weight) with ``target``.

    ``total`` (default: the sum of all sizes) is shared by weight. A source whose
    share is above ``max_repeat`` times its size stops there and the excess is
    shared by the others. Each round is one aggregation over the sources; the share
    per weight only rises, and rounds end when it rises no more.
    """
    limit = F.col("source_size") * max_repeat
    level = None
    while True:
        full = F.lit(False) if level is None else limit < F.lit(level) * F.col("weight")
        row = sized.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if not row.open:
            break
        share = ((row["all"] if total is None else total) - row.full) / row.open
        if level is not None and share <= level:
            break
        level = share
    share = limit if level is None else F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    return sized.withColumn("target", share.cast("double"))


def text_print(text: str | Column) -> Column:
    return F.md5(text_of(text).cast("binary"))


def numbered(docs: DataFrame, key: str, out: str) -> DataFrame:
    """``docs`` with ``out``: 0, 1, ... among the rows of one ``key``.

    Only the keys are shuffled to find the repeated ones. Rows of these are numbered by
    their place in a sort over all of them, in which a hot key is spread over tasks.
    """
    several = docs.groupBy(key).agg(F.count("*").alias(out)).where(F.col(out) > 1).select(key)
    several = stage(several, "repeated-keys")
    if several.isEmpty():
        return docs.withColumn(out, F.lit(0).cast("long"))
    several = broadcast_if_small(several)
    spread, place, first = (fresh([*docs.columns, out], name) for name in ("_spread", "_place", "_first"))
    copies = docs.join(several, key, "left_semi").withColumn(spread, F.monotonically_increasing_id())
    # Stored, so that a lost executor finds the same spread again.
    copies = row_index(stage(copies, "repeated-rows"), [key, spread], place)
    starts = broadcast_if_small(copies.groupBy(key).agg(F.min(place).alias(first)))
    copies = copies.join(starts, key).withColumn(out, F.col(place) - F.col(first))
    alone = docs.join(several, key, "left_anti").withColumn(out, F.lit(0).cast("long"))
    return alone.unionByName(copies.select(*alone.columns))


def draw(key: str, number: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on id and text (in ``key``), the number and the seed."""
    parts = F.coalesce(F.col(f"{key}.id").cast("string"), F.lit("")), F.col(f"{key}.print"), F.col(number).cast("string")
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def with_copies(
    docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", source_col: str = "source",
    seed: str = SEED, out: str = "mix", text_col: str = "text", text_print_col: str | None = None,
) -> DataFrame:
    """``docs`` with a struct ``out``: source_size, target, copies.

    ``text_print_col`` names a column that already holds ``text_print``; without that and
    without ``text_col`` ids alone tell rows apart. The table of sources is joined by broadcast while it is small, else by a
    shuffle whose hot source Spark splits.
    """
    docs = docs.drop(out)
    columns = docs.columns
    key, row, number = (fresh(columns, name) for name in ("_source_key", "_row_key", "_number"))
    plan = fresh([*columns, key, row, number], out)
    if text_print_col is not None:
        printed = F.col(text_print_col)
    else:
        printed = text_print(text_col) if text_col in columns else F.lit("")
    row_key = F.struct(F.col(id_col).alias("id"), printed.alias("print"), F.col(source_col).alias("source"))
    docs = numbered(docs.withColumn(row, row_key), row, number)
    # A null source is a source: both sides carry it as a struct field.
    shares = mix.select(F.struct("source").alias(key), F.struct("source_size", "target").alias("_share"))
    joined = docs.withColumn(key, F.struct(F.col(source_col).alias("source"))).join(
        broadcast_if_small(shares), key, "left"
    )
    rate = F.coalesce(F.try_divide(F.col("_share.target"), F.col("_share.source_size")), F.lit(0.0))
    extra = (draw(row, number, seed) < rate - F.floor(rate)).cast("long")
    made = F.struct(
        F.col("_share.source_size"), F.col("_share.target"), (F.floor(rate) + extra).cast("long").alias("copies")
    )
    return joined.select(*columns, made.alias(plan)).withColumnRenamed(plan, out)


def mixed(
    docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED,
    text_col: str = "text",
) -> DataFrame:
    """Every document as often as the mix takes it, in its own columns."""
    out = fresh(docs.columns, "mix")
    planned = with_copies(docs, mix, id_col, source_col, seed, out, text_col).where(F.col(f"{out}.copies") > 0)
    times = F.explode(F.sequence(F.lit(1), F.col(f"{out}.copies")))
    return planned.select(*docs.columns, times.alias(out)).drop(out)


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(coalesce(text, '')) AS print FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, {MAX_REPEAT} * source_size AS cap,
         coalesce(sum({MAX_REPEAT} * source_size) OVER o, 0) AS before,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open
  FROM sources
  WINDOW o AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max(((SELECT sum(source_size) FROM sources) - before) / open) AS share FROM ordered),
planned AS (
  SELECT source, source_size, least(CAST({MAX_REPEAT} * source_size AS DOUBLE), share * weight) AS target
  FROM sources, level),
counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, print, source) - 1 AS number FROM sized),
rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || print || ':' || number), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS draw
  FROM counted JOIN planned ON planned.source IS NOT DISTINCT FROM counted.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


def contract_mix(docs: DataFrame, size: Column, source_col: str = "source") -> DataFrame:
    """Sources with the weights and targets that the result contract names."""
    return targets(ranked_weights(source_sizes(docs, source_col, size)))


@query("op9_mixture", SQL)
def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = table(spark, sf_dir, "documents")
    # The texts are read once; what follows needs their sizes only.
    sized = stage(docs.select("doc_id", "source", word_count("text").alias("size"), text_print("text").alias("print")), "sizes")
    planned = with_copies(sized, contract_mix(sized, F.col("size")), text_print_col="print")
    return planned.select(
        "doc_id", "size", "mix.source_size", "mix.target",
        (F.col("size") * F.col("mix.copies")).alias("taken"),
    )
