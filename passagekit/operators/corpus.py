"""Paragraph fetch, neighbour context and length profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from passagekit.functions.ids import with_paragraph_keys
from passagekit.functions.text import NEXT_MARK, PREVIOUS_MARK
from passagekit.scale import broadcast_if_small, stage, top_k

# Percentiles and length limits of the reports.
PERCENTILES = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
SHORT_LIMITS = [10, 25, 50, 100, 200]
CDF_LIMITS = [50, 100, 200, 500, 1000]

#: Paragraph numbers of one paper that a task orders together.
CONTEXT_BLOCK = 1_000

#: Size parameter of a KLL sketch.
SKETCH_SIZE = 800


def single_copy(corpus: DataFrame, id_col: str = "paper_paragraph_id") -> DataFrame:
    """One row per id: the smallest (shard, text).

    Each task forwards one row per id, so an id with very many copies is
    reduced before the shuffle.
    """
    order = [F.col("shard"), F.col("paragraph_text")]
    return top_k(corpus, [id_col], order, 1, "_copy").drop("_copy")


def fetch_texts(
    ids: DataFrame,
    corpus: DataFrame,
    id_col: str = "paper_paragraph_id",
    neighbours: bool = False,
) -> DataFrame:
    """Texts of the wanted ids; an id the corpus lacks keeps a null text.

    With ``neighbours`` the ids before and after are fetched as well. The
    distinct ids filter the corpus in its scan stage while they are few.
    """
    wanted = ids.select(id_col).distinct()
    if neighbours:
        keyed = with_paragraph_keys(wanted, id_col)
        around = F.array_compact(F.array(id_col, "prev_id", "next_id"))
        wanted = keyed.select(F.explode(around).alias(id_col)).distinct()
    reduced = corpus.select(id_col, "shard", "paragraph_text").join(
        broadcast_if_small(wanted), id_col, "left_semi"
    )
    texts = single_copy(reduced, id_col).select(id_col, "paragraph_text")
    return wanted.join(texts, id_col, "left")


def merge_context(targets: DataFrame, texts: DataFrame, min_length: int = 200) -> DataFrame:
    """Complete short paragraphs with the paragraphs before and after.

    Both inputs have (paper_paragraph_id, paragraph_text); neighbours are
    always the original texts, of several copies the smallest text. Adds ``merged``
    where something was added.

    Texts are shuffled once, by paper and block of ``CONTEXT_BLOCK`` paragraph numbers,
    and a window over the numbers before and after finds both neighbours; a gap in the
    numbers is no neighbour. A text at the edge of a block is in the next one, too, so a
    paper of any length is spread over many tasks.
    """
    id_col = "paper_paragraph_id"
    text = F.col("paragraph_text")
    short = F.coalesce((F.length(text) < min_length) & (text != ""), F.lit(False))
    block = lambda number: F.floor(number / CONTEXT_BLOCK)
    keyed = with_paragraph_keys(texts.where(text != "").select(id_col, "paragraph_text"), id_col)
    # Only an id in the plain form is the neighbour of another.
    given = keyed.where(F.col(id_col) == F.concat("paper_id", F.lit("_p"), F.col("para_num").cast("string")))
    given = given.where(F.col("para_num") >= 0)
    # The blocks of the two paragraphs that it stands beside.
    at = F.array_distinct(F.array(block(F.col("para_num") - 1), block(F.col("para_num") + 1)))
    offered = given.select(
        "paper_id", "para_num", F.explode(at).alias("_block"), text.alias("_offered"), F.lit(None).cast(targets.schema).alias("_row"),
    )
    # First paragraphs and malformed ids may have no neighbour; they stay in the table.
    asked = with_paragraph_keys(targets.where(short).select(id_col, F.struct(*targets.columns).alias("_row")), id_col)
    asked = asked.select(
        "paper_id", "para_num", block(F.col("para_num")).alias("_block"), F.lit(None).cast("string").alias("_offered"), "_row"
    )
    order = W.partitionBy("paper_id", "_block").orderBy("para_num")
    beside = lambda step: F.min("_offered").over(order.rangeBetween(step, step))
    both = offered.unionByName(asked.where(F.col("para_num").isNotNull()))
    found = both.select("_row", beside(-1).alias("_prev"), beside(1).alias("_next")).where(F.col("_row").isNotNull())
    alone = asked.where(F.col("para_num").isNull()).select("_row", *[F.lit(None).cast("string").alias(n) for n in ("_prev", "_next")])
    merged = F.concat_ws(
        "\n\n",
        F.concat(F.lit(PREVIOUS_MARK), "_prev"),
        F.col("_row")["paragraph_text"],
        F.concat(F.lit(NEXT_MARK), "_next"),
    )
    grown = found.unionByName(alone).select(
        *[F.col("_row")[name].alias(name) for name in targets.columns if name != "paragraph_text"],
        merged.alias("paragraph_text"),
        (F.col("_prev").isNotNull() | F.col("_next").isNotNull()).alias("merged"),
    )
    rest = targets.where(~short).withColumn("merged", F.lit(False))
    return rest.unionByName(grown)


# -- length profile ---------------------------------------------------------


def length_counts(corpus: DataFrame, text: str = "paragraph_text") -> DataFrame:
    """Number of paragraphs per length: the one pass over the corpus that all
    profiles below share. It is a written table, bounded by the longest
    paragraph, so that they do not repeat the pass."""
    lengths = corpus.where(F.col(text).isNotNull()).select(F.length(text).alias("length"))
    return stage(lengths.groupBy("length").agg(F.count("*").alias("n")), "lengths")


def length_summary(corpus: DataFrame, text: str = "paragraph_text") -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum."""
    length = F.length(text)
    return corpus.where(F.col(text).isNotNull()).agg(
        F.count("*").alias("n"),
        F.round(F.avg(length), 6).alias("mean"),
        F.round(F.stddev(length), 6).alias("stddev"),
        F.min(length).alias("min"),
        F.max(length).alias("max"),
    )


def _labels(percentages: Sequence[float]) -> list[str]:
    return [f"p{round(100 * p):02d}" for p in percentages]


def length_quantiles(counts: DataFrame, percentages: Sequence[float] = PERCENTILES) -> DataFrame:
    """Exact quantiles, one column each."""
    exact = F.percentile("length", [float(p) for p in percentages], F.col("n"))
    picked = counts.agg(exact.alias("_q"))
    return picked.select(
        *[F.round(F.col("_q")[at], 6).alias(name) for at, name in enumerate(_labels(percentages))]
    )


def length_sketches(corpus: DataFrame, by: str = "shard", size: int = SKETCH_SIZE) -> DataFrame:
    """(by, sketch): one KLL sketch of the lengths per shard.

    Sketches are small and can be stored: new shards are sketched alone and merged with
    those that are there.
    """
    lengths = corpus.where(F.col("paragraph_text").isNotNull()).select(by, F.length("paragraph_text").cast("long").alias("length"))
    return lengths.groupBy(by).agg(F.kll_sketch_agg_bigint("length", F.lit(size)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, percentages: Sequence[float] = PERCENTILES) -> DataFrame:
    """Quantiles of everything that ``sketches`` stand for, one column each."""
    merged = sketches.agg(F.kll_merge_agg_bigint("sketch").alias("_all"))
    return merged.select(*[
        F.when(F.kll_sketch_get_n_bigint("_all") > 0, F.kll_sketch_get_quantile_bigint("_all", F.lit(float(p)))).alias(name)
        for p, name in zip(percentages, _labels(percentages))
    ])


def length_quantiles_approx(corpus: DataFrame, percentages: Sequence[float] = PERCENTILES) -> DataFrame:
    """Quantiles within about 0.4 % of rank, from one mergeable sketch per shard."""
    return sketch_quantiles(length_sketches(corpus), percentages)


def _below(limit: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("length") < limit, F.col("n"))), F.lit(0))


def short_counts(counts: DataFrame, limits: Sequence[int] = SHORT_LIMITS) -> DataFrame:
    """Paragraphs shorter than each limit, and their percentage."""
    total = F.sum("n")
    wide = counts.agg(
        F.array(
            *[
                F.struct(
                    F.lit(limit).alias("threshold"),
                    _below(limit).alias("n"),
                    F.round(F.try_divide(_below(limit) * 100.0, total), 6).alias("pct"),
                )
                for limit in limits
            ]
        ).alias("_rows")
    )
    return wide.select(F.inline("_rows"))


def length_histogram(counts: DataFrame, cap: int, inclusive: bool, bins: int = 100) -> DataFrame:
    """Equal-width bins between the extremes of the lengths up to ``cap``.

    The last bin includes its right edge; empty bins are present. The overall
    mean and median come along as markers.
    """
    kept = counts.where(F.col("length") <= cap if inclusive else F.col("length") < cap)
    ends = kept.agg(F.min("length").alias("_low"), F.max("length").alias("_high"))
    marks = counts.agg(
        F.round(F.try_divide(F.sum(F.col("length") * F.col("n")).cast("double"), F.sum("n")), 6).alias("mean_marker"),
        F.round(F.percentile("length", 0.5, F.col("n")), 6).alias("median_marker"),
    )
    low, high = ends.select("_low").scalar(), ends.select("_high").scalar()
    slot = F.floor((F.col("length") - low) * F.lit(bins) / F.greatest(high - low, F.lit(1)))
    filled = kept.groupBy(F.least(slot, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    spine = ends.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.col("_low"),
        (F.greatest(F.col("_high") - F.col("_low"), F.lit(1)) / F.lit(float(bins))).alias("_width"),
    )
    edge = lambda step: F.round(F.col("_low") + (F.col("bin") + step) * F.col("_width"), 6)
    return spine.join(filled, "bin", "left").select(
        "bin",
        edge(0).alias("left_edge"),
        edge(1).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
        marks.select("mean_marker").scalar().alias("mean_marker"),
        marks.select("median_marker").scalar().alias("median_marker"),
    )


def length_cdf(counts: DataFrame, block: int = 4096) -> DataFrame:
    """Cumulative percentage per distinct length.

    Running totals are taken inside blocks of lengths and shifted by the
    totals of earlier blocks, so no single task sees all lengths.
    """
    blocked = counts.withColumn("_block", F.floor(F.col("length") / block))
    inside = W.partitionBy("_block").orderBy("length")
    upto = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    # One row per block: longest length / block.
    starts = blocked.groupBy("_block").agg(F.sum("n").alias("_n")).select(
        "_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before")
    )
    total = counts.agg(F.sum("n").alias("total")).scalar()
    running = blocked.withColumn("_run", F.sum("n").over(inside)).join(F.broadcast(starts), "_block")
    return running.select(
        "length", "n", F.round((F.col("_run") + F.col("_before")) * 100.0 / total, 6).alias("cum_pct")
    )


def cdf_marks(counts: DataFrame, limits: Sequence[int] = CDF_LIMITS) -> DataFrame:
    return short_counts(counts, limits)


def length_box(counts: DataFrame, cap: int = 2000) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and the number of
    paragraphs beyond the cap."""
    kept = counts.where(F.col("length") <= cap)
    quartiles = kept.agg(F.percentile("length", [0.25, 0.5, 0.75], F.col("n")).alias("_q"))
    at = lambda place: quartiles.select(F.col("_q")[place].alias("v")).scalar()
    low, high = at(0), at(2)
    reach = (high - low) * 1.5
    inside = lambda condition: F.when(condition, F.col("length"))
    return kept.agg(
        F.sum("n").alias("n"),
        F.round(F.max(low), 6).alias("q1"),
        F.round(F.max(at(1)), 6).alias("median"),
        F.round(F.max(high), 6).alias("q3"),
        F.min(inside(F.col("length") >= low - reach)).alias("low_whisker"),
        F.max(inside(F.col("length") <= high + reach)).alias("high_whisker"),
        F.max(
            F.coalesce(
                counts.where(F.col("length") > cap).agg(F.sum("n").alias("n")).scalar(), F.lit(0)
            )
        ).alias("excluded"),
    )


def bounded_sample(df: DataFrame, cap: int, seed: int = 42, total: int | None = None) -> DataFrame:
    """Bernoulli sample of about ``cap`` rows when the table has more."""
    rows = df.count() if total is None else total
    return df if rows <= cap else df.sample(fraction=cap / rows, seed=seed)
