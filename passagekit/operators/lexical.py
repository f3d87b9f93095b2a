"""BM25 index and search, overlap reranking, and the retrieval cascade."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window as W

from passagekit.functions.lexical import Weights, chunks
from passagekit.functions.text import overlap, tokens, with_term_counts, word_set
from passagekit.scale import BROADCAST_ROWS, broadcast_if_small, fits, one_per_id, salt, stage, top_k

# Saturation and length normalisation of the ranking formula.
K1 = 1.5
B = 0.75

#: Postings of one term that may meet in one task before the term is salted.
ROWS_PER_SALT = 200_000


#: Pairs of a passage and a document that may be sent to all workers, with the passage.
MAX_PASSAGES = 50_000

#: Passages without an inner word that are looked for in one scan.
SHORT_PASSAGES = 200

Analyser = Callable[[str | Column], Column]


@dataclass(frozen=True)
class LexicalIndex:
    """``postings`` (term, doc_id, tf, doc_len), ``terms`` (term, df) and the
    one-row ``stats`` (docs, total_len, avg_len). A stored index also has the
    postings' term ``bucket`` and the number of ``buckets``."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def build_index(
    docs: DataFrame, id_col: str, text_col: str, analyse: Analyser = tokens
) -> LexicalIndex:
    """Index of ``docs``; null text is an empty document.

    Of several rows with one id the first by shard (if there is one) and text is
    indexed, as everywhere. Term counts are taken inside each row, so postings need no
    shuffle; frequent terms are pre-aggregated before the document frequencies are.
    ``analyse`` turns text into tokens, e.g. without stop words; a search
    must be given the same.
    """
    order = [c for c in ("shard", text_col) if c in docs.columns]
    docs = one_per_id(docs.select(id_col, *order), id_col, order)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_col)
    counted = with_term_counts(texts, text_col, analyse)
    postings = counted.select("doc_id", "doc_len", F.inline("terms")).select(
        "term", "doc_id", "tf", "doc_len"
    )
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return LexicalIndex(postings, terms, _stats(docs.agg(F.count("*").alias("docs")), postings))


def _buckets_of(index: LexicalIndex, weights: DataFrame) -> DataFrame:
    """Postings of the buckets that hold a query term.

    The number of buckets bounds the collected values.
    """
    if "bucket" not in index.postings.columns:
        return index.postings
    buckets = index.stats.select("buckets").scalar()
    number = F.pmod(F.xxhash64("term"), buckets).cast("int").alias("bucket")
    wanted = [row.bucket for row in weights.select(number).distinct().collect()]
    return index.postings.where(F.col("bucket").isin(wanted))


def _stats(doc_count: DataFrame, postings: DataFrame) -> DataFrame:
    """Corpus statistics; a document without tokens counts, with length 0."""
    total = F.coalesce(postings.agg(F.sum("tf").alias("total_len")).scalar(), F.lit(0))
    return doc_count.select("docs", total.alias("total_len")).withColumn(
        "avg_len", F.try_divide("total_len", "docs")
    )


def write_index(index: LexicalIndex, path: str, buckets: int = 64) -> None:
    """Store the index as three Parquet tables below ``path``.

    Postings are partitioned by term bucket, so a search opens only the
    buckets of its terms. Each task writes its documents' part of every bucket, so
    postings are not moved and a very frequent term lies in as many files as there
    are tasks.
    """
    bucketed = index.postings.withColumn("bucket", salt(["term"], buckets))
    bucketed.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    # Frequencies and lengths come from the stored postings, so the texts are
    # tokenised once.
    stored = index.postings.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
    stats = _stats(index.stats.select("docs"), stored)
    stats.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/stats")


def with_frequencies(index: LexicalIndex, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Postings with the term's document frequency ``df``.

    The most frequent terms are sent to all workers, as many as may be, so that only
    postings of rarer ones are moved.
    """
    bounds = [1 << i for i in range(48)]
    counts = index.terms.agg(*[F.count_if(F.col("df") >= n) for n in bounds]).first()
    least = next((n for n, count in zip(bounds, counts) if count <= max_broadcast_rows), bounds[-1])
    frequent = F.broadcast(index.terms.where(F.col("df") >= least))
    postings = index.postings.drop("bucket")
    known = postings.join(frequent, "term")
    if least == 1:
        return known
    rare = index.terms.where(F.col("df") < least)
    return known.unionByName(postings.join(frequent, "term", "left_anti").join(rare, "term"))


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(
        spark.read.parquet(f"{path}/postings"),
        spark.read.parquet(f"{path}/terms"),
        spark.read.parquet(f"{path}/stats"),
    )


def query_weights(
    index: LexicalIndex, queries: DataFrame, query_col: str, text_col: str, analyse: Analyser = tokens
) -> DataFrame:
    """(query, term, weight): idf times the term's occurrences in the query."""
    occurrences = (
        queries.select(query_col, F.explode(analyse(text_col)).alias("term"))
        .groupBy(query_col, "term")
        .agg(F.count("*").alias("qtf"))
    )
    docs = index.stats.select("docs").scalar()
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = occurrences.join(index.terms, "term")
    return known.select(query_col, "term", "df", (idf * F.col("qtf")).alias("weight"))


def bm25_topk(
    index: LexicalIndex,
    queries: DataFrame,
    k: int,
    query_col: str = "query_id",
    text_col: str = "question",
    k1: float = K1,
    b: float = B,
    max_broadcast_rows: int = BROADCAST_ROWS,
    analyse: Analyser = tokens,
) -> DataFrame:
    """Top ``k`` documents of every query: (query, doc_id, score, rank).

    While the query terms are few they are broadcast: postings are reduced to
    the wanted terms, shuffled once by document, and scored for all queries
    without another shuffle, so the data moved does not grow with the number
    of queries. A first pass only counts scores per query, which gives a bound that
    at least ``k`` documents reach; the second lets nothing below it out of a task. More
    query terms than that are joined by term, with the postings of frequent terms salted
    over several tasks.
    """
    # A written table: used three times below, and its size is then known.
    weights = stage(query_weights(index, queries, query_col, text_col, analyse), "query-weights")
    average = index.stats.select("avg_len").scalar()
    saturation = F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / average)
    postings = _buckets_of(index, weights).select(
        "term", "doc_id", (F.col("tf") / saturation).alias("part")
    )

    if fits(weights.select("term"), max_broadcast_rows):
        scored = _scored_by_document(weights, postings, k, query_col)
    else:
        splits = F.ceil(F.col("df") / ROWS_PER_SALT).cast("int")
        spread_terms = weights.withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1)))
        # Only the few terms above the bound are looked up, so that no posting of a
        # frequent term is moved before it has its salt.
        frequent = weights.where(F.col("df") > ROWS_PER_SALT).select("term", splits.alias("_splits")).distinct()
        salted = (
            postings.join(broadcast_if_small(frequent), "term", "left")
            .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), "_splits").cast("int"), F.lit(0)))
            .drop("_splits")
        )
        pairs = salted.join(spread_terms.drop("df"), ["term", "_salt"])
        scored = _summed(pairs, query_col)
    return top_k(scored, [query_col], [F.desc("score"), F.asc("doc_id")], k)


def _summed(pairs: DataFrame, query_col: str) -> DataFrame:
    return pairs.groupBy(query_col, "doc_id").agg(
        F.round(F.sum(F.col("weight") * F.col("part")), 6).alias("score")
    )


def _scored_by_document(weights: DataFrame, postings: DataFrame, k: int, query_col: str) -> DataFrame:
    """(query, doc_id, score) of at least the best ``k`` documents of every query.

    The rows of ``weights`` were counted and may be collected.
    """
    spark = weights.sparkSession
    known = weights.select(query_col, "term", "weight").orderBy(query_col, "term").toArrow()
    asked = known.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
    terms = known.column(1).combine_chunks().dictionary_encode()
    table = Weights(
        asked.indices.to_numpy(), terms.indices.to_numpy(), known.column(2).to_numpy(), len(asked.dictionary), len(terms.dictionary)
    )
    shared, names = spark.sparkContext.broadcast(table), asked.dictionary
    numbers = F.broadcast(spark.createDataFrame(
        list(zip(terms.dictionary.to_pylist(), range(len(terms.dictionary)))), "term string, _no int"
    ))
    wanted = postings.join(numbers, "term")
    # A document has at most one posting for each query term.
    entry = F.sort_array(F.collect_list(F.struct("_no", "part"))).alias("entries")
    by_doc = stage(wanted.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(entry), "query-postings")

    def parts(batch: pa.RecordBatch):
        entries = batch.column(batch.schema.get_field_index("entries"))
        flat, sizes = entries.flatten(), np.diff(entries.offsets.to_numpy())
        return sizes, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shared.value
        counts = np.zeros((local.queries, local.bins), np.int64)
        for batch in batches:
            for _, scores in chunks(local, *parts(batch)):
                docs, which = np.nonzero(scores)
                np.add.at(counts, (which, local.bin_of(which, scores[docs, which])), 1)
        which, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(counts[which, place])], ["query", "bin", "n"]
        )

    counted = by_doc.mapInArrow(count, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
    above = W.partitionBy("query").orderBy(F.desc("bin"))
    reached = counted.withColumn("n", F.sum("n").over(above)).where(F.col("n") >= k)
    bounds = np.zeros(table.queries)
    # One row per query.
    for row in reached.groupBy("query").agg(F.max("bin").alias("bin")).collect():
        bounds[row.query] = table.edge(row.query, row.bin)

    schema = T.StructType([weights.schema[query_col], by_doc.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for start, scores in chunks(local, *parts(batch)):
                docs, which = np.nonzero((scores > 0) & (scores >= bounds))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(which)), ids.take(pa.array(docs + start)), pa.array(scores[docs, which])], schema.names
                )

    scored = by_doc.mapInArrow(score, schema).withColumn("score", F.round("score", 6))
    # Rows without an id count as one document, of any size.
    alone = wanted.where(F.col("doc_id").isNull()).drop("_no").join(F.broadcast(weights.drop("df")), "term")
    return scored.unionByName(_summed(alone, query_col))


def with_document_values(
    candidates: DataFrame, corpus: DataFrame, id_col: str, value: Column, name: str
) -> DataFrame:
    """Candidates with a value computed once per candidate document.

    Few documents are picked out in the corpus scan; many are met by a
    shuffle on the document id. The candidates are read twice. Of several rows with
    one id the first by its other columns counts; a candidate that the corpus lacks
    keeps a null.
    """
    docs = corpus.withColumnRenamed(id_col, "doc_id")
    wanted = broadcast_if_small(candidates.select("doc_id").distinct())
    reduced = docs.join(wanted, "doc_id", "left_semi")
    order = [F.asc(c) for c in ("shard", "paragraph_text") if c in docs.columns]
    if not order:
        reduced, value, order = reduced.select("doc_id", value.alias(name)), F.col(name), [F.asc(name)]
    # The value is made where the rows of a document have met: a set of words is longer than its text.
    found = top_k(reduced, ["doc_id"], order, 1, "_copy").select("doc_id", value.alias(name))
    return candidates.join(found, "doc_id", "left")


def overlap_rerank(
    candidates: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_col: str = "query_id",
    text_col: str = "question",
    id_col: str = "paper_paragraph_id",
    corpus_text: str = "paragraph_text",
) -> DataFrame:
    """Top ``k`` candidates per query by word-set overlap.

    Only word sets travel to the comparison and only ids and scores leave it.
    A candidate that the corpus lacks scores 0, like one without text. The candidates
    should be a written table.
    """
    asked = queries.select(query_col, word_set(text_col).alias("_asked"))
    none = F.array().cast("array<string>")
    offered = with_document_values(
        candidates.select(query_col, "doc_id"), corpus, id_col, F.coalesce(word_set(corpus_text), none), "_offered"
    ).withColumn("_offered", F.coalesce("_offered", none))
    scored = offered.join(asked, query_col).select(
        query_col, "doc_id", F.round(overlap(F.col("_asked"), F.col("_offered")), 6).alias("score")
    )
    return top_k(scored, [query_col], [F.desc("score"), F.asc("doc_id")], k)


def cascade(
    index: LexicalIndex,
    queries: DataFrame,
    corpus: DataFrame,
    rerank: Callable[[DataFrame], DataFrame],
    cuts: tuple[int, int] = (30_000, 1_000),
    staged: bool = True,
    **names: str,
) -> DataFrame:
    """Lexical search, overlap cut, then ``rerank`` on what is left.

    With ``staged`` every cut is a written table, so that the stages can run
    as separate jobs and a lost executor never repeats an earlier one.
    """
    boundary = stage if staged else (lambda df, _: df)
    query_col = names.get("query_col", "query_id")
    text_col = names.get("text_col", "question")
    first = boundary(bm25_topk(index, queries, cuts[0], query_col, text_col), "stage-lexical")
    second = boundary(
        overlap_rerank(
            first, queries, corpus, cuts[1], query_col, text_col,
            names.get("id_col", "paper_paragraph_id"), names.get("corpus_text", "paragraph_text"),
        ),
        "stage-overlap",
    )
    return rerank(second)


def containing_documents(
    index: LexicalIndex,
    passages: DataFrame,
    docs: DataFrame,
    passage_id: str,
    passage_text: str,
    doc_id: str,
    doc_text: str,
    owner: Callable[[str], Column] = F.col,
) -> DataFrame:
    """(passage, document) pairs where the document holds the passage verbatim.

    A word strictly inside the passage is a word of every containing
    document, so only documents with the passage's rarest inner word are
    compared. ``index`` covers the documents, or parts of them when ``owner``
    maps an indexed id to its document. Passages of fewer than three words have no
    inner word; they are looked for in one scan of the texts for every
    ``SHORT_PASSAGES`` of them.
    """
    texts = docs.select(F.col(doc_id).cast("string").alias(doc_id), F.col(doc_text).alias("_text"))
    sized = passages.select(passage_id, passage_text, tokens(passage_text).alias("_words"))
    short = sized.where(F.size("_words") < 3).where(F.col(passage_text).isNotNull()).select(passage_id, passage_text)
    words = sized.where(F.size("_words") >= 3).select(passage_id, "_words")
    inside = F.slice("_words", 2, F.greatest(F.size("_words") - 2, F.lit(0)))
    inner = words.select(passage_id, F.explode(inside).alias("term")).distinct()
    known = inner.join(index.terms, "term")
    # One row per passage; few of them leave the postings and the texts where they are.
    rarest = broadcast_if_small(top_k(known, [passage_id], [F.asc("df"), F.asc("term")], 1, "_pick").select(passage_id, "term"))
    candidates = (
        _buckets_of(index, rarest).join(rarest, "term")
        .select(passage_id, owner("doc_id").alias(doc_id))
        .distinct()
    )
    asked = candidates.join(passages.select(passage_id, F.col(passage_text).alias("_passage")), passage_id)
    pairs = (
        texts.join(broadcast_if_small(asked, MAX_PASSAGES), doc_id)
        .where(F.contains("_text", "_passage"))
        .select(passage_id, doc_id)
    )
    short = stage(short, "short-passages")
    blocks = -(-short.count() // SHORT_PASSAGES)
    for number in range(blocks):
        # A block holds about SHORT_PASSAGES passages.
        block = short.where(F.pmod(F.xxhash64(passage_id), F.lit(blocks)) == number).collect()
        if not block:
            continue
        kind = f"array<struct<id:{short.schema[passage_id].dataType.simpleString()},text:string>>"
        listed = F.array(*[F.struct(F.lit(r[0]).alias("id"), F.lit(r[1]).alias("text")) for r in block]).cast(kind)
        found = texts.where(F.col("_text").isNotNull()).select(doc_id, F.explode(
            F.filter(listed, lambda p: F.contains(F.col("_text"), p["text"]))
        ).alias("_found"))
        pairs = pairs.unionByName(found.select(F.col("_found.id").alias(passage_id), doc_id))
    return pairs
