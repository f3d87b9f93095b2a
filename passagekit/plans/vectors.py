"""Vector retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from passagekit.functions.text import head_tail
from passagekit.operators import metrics, quantise, scoring, vector
from passagekit.plans import fixtures as fx
from passagekit.plans.fixtures import table, with_sql
from passagekit.plans.registry import query
from passagekit.scale import shared_dir, stage


def exact_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return vector.knn_exact(fx.vector_queries(spark, sf_dir), fx.vectors(spark, sf_dir), k, skip_same_id=True)


@query("knn_exact", with_sql("SELECT query_id, vec_id, distance, rank FROM nearest", fx.DISTANCES,
    fx.nearest_sql("nearest", "distances", 10)))
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_hits(spark, sf_dir, 10)


@query("vector_ids", """
SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS vector_no FROM embeddings""")
def vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.vector_ids(fx.vectors(spark, sf_dir))


@query("train_sample", """
SELECT vec_id, label FROM (SELECT *, row_number() OVER (ORDER BY md5('1234' || vec_id), vec_id) AS place FROM embeddings)
WHERE place <= 300""")
def train_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.training_sample(fx.vectors(spark, sf_dir), 300).select("vec_id", "label")


def lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors assigned to the mean of each label, and these means."""
    base = fx.vectors(spark, sf_dir)
    centroids = stage(vector.label_centroids(base, "label"), "centroids")
    return vector.ivf_assign(base, centroids), centroids


CENTROIDS = """centroids AS (
  SELECT label AS cid, list(m ORDER BY d) AS c FROM (
    SELECT label, d, avg(x) AS m FROM (
      SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vecs) GROUP BY label, d) GROUP BY label),
to_centroids AS (
  SELECT vec_id, v, cid, c,
         round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS gap
  FROM vecs CROSS JOIN centroids),
assigned AS (
  SELECT vec_id, v, cid, c FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY gap, cid) AS place FROM to_centroids) WHERE place = 1)"""


@query("ivf_assign", with_sql("SELECT vec_id, cid FROM assigned", fx.DISTANCES, CENTROIDS))
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir)[0].select("vec_id", "cid")


@query("ivf_fit")
def ivf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per list after fitting the centroids by k-means."""
    base = fx.vectors(spark, sf_dir)
    centroids = vector.ivf_fit(vector.training_sample(base), 16)
    return vector.ivf_assign(base, centroids).groupBy("cid").agg(F.count("*").alias("vectors"))


@query("ivf_search", with_sql("SELECT query_id, vec_id, distance, rank FROM nearest", fx.DISTANCES, CENTROIDS, """
probes AS (
  SELECT vec_id AS query_id, cid FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY gap, cid) AS place FROM to_centroids) WHERE place <= 3),
probed AS (
  SELECT d.query_id, d.vec_id, d.distance FROM distances d
  JOIN assigned a ON a.vec_id = d.vec_id JOIN probes p ON p.query_id = d.query_id AND p.cid = a.cid)""",
    fx.nearest_sql("nearest", "probed", 10)))
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = lists(spark, sf_dir)
    return vector.ivf_search(fx.vector_queries(spark, sf_dir), assigned, centroids, 3, 10, skip_same_id=True)


PARTS, WORDS = 8, 16


@query("pq_encode", with_sql(f"""
SELECT vec_id, cid, string_agg(code, ';' ORDER BY part) AS codes FROM (
  SELECT vec_id, cid, part, CAST(word AS VARCHAR) AS code FROM (
    SELECT s.vec_id, s.cid, s.part, b.word,
           row_number() OVER (PARTITION BY s.vec_id, s.part ORDER BY
             round(list_sum(list_transform(list_zip(s.r, b.r), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), b.word) AS place
    FROM pieces s JOIN (SELECT part, r, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS word FROM pieces
                        WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {WORDS})) b ON b.part = s.part)
  WHERE place = 1) GROUP BY vec_id, cid""", fx.DISTANCES, CENTROIDS, f"""
pieces AS (
  SELECT vec_id, cid, part, list_slice(list_transform(list_zip(v, c), lambda z: z[1] - z[2]), part * 8 + 1, part * 8 + 8) AS r
  FROM assigned CROSS JOIN (SELECT unnest(range({PARTS})) AS part))"""))
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes under a fixed book: the residuals of the first 16 vectors."""
    assigned, centroids = lists(spark, sf_dir)
    first = assigned.orderBy("vec_id").limit(WORDS).toPandas()
    middle = {row.cid: np.asarray(row.centroid) for row in centroids.collect()}
    rest = np.stack([np.asarray(v, dtype=np.float64) - middle[c] for v, c in zip(first["vector"], first["cid"])])
    books = rest.reshape(len(rest), PARTS, -1).transpose(1, 0, 2)
    coded = quantise.pq_encode(assigned, centroids, books)
    return coded.select("vec_id", "cid", F.array_join(F.col("codes").cast("array<string>"), ";").alias("codes"))


@query("pq_search")
def pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over trained codes."""
    assigned, centroids = lists(spark, sf_dir)
    books = quantise.pq_fit(assigned, centroids, PARTS, 64, iterations=5)
    coded = stage(quantise.pq_encode(assigned, centroids, books).select("vec_id", "codes", "cid"), "codes")
    return quantise.pq_search(fx.vector_queries(spark, sf_dir), coded, centroids, books, 5, 10, skip_same_id=True)


@query("vector_rerank", with_sql("SELECT query_id, vec_id, distance, rank FROM nearest", fx.DISTANCES,
    fx.nearest_sql("wide", "distances", 50), """
candidates AS (
  SELECT w.query_id, w.vec_id, w.distance FROM wide w JOIN embeddings q ON q.vec_id = w.query_id
  JOIN embeddings b ON b.vec_id = w.vec_id AND b.label = q.label)""",
    fx.nearest_sql("nearest", "candidates", 5)))
def vector_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered candidates of the query's own label, best five by distance."""
    base, asked = fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    labels = base.select("vec_id", "label")
    candidates = exact_hits(spark, sf_dir, 50).select("query_id", "vec_id").join(labels, "vec_id").join(
        labels.toDF("query_id", "label"), ["query_id", "label"]
    )
    return vector.vector_rerank(candidates, asked, base, 5)


@query("rerank_topk", with_sql("""
SELECT query_id, doc_id, score AS rerank_score, rank FROM hits""", fx.DISTANCES,
    fx.nearest_sql("candidates", "distances", 50), """
cosines AS (
  SELECT c.query_id, c.vec_id AS doc_id,
         round(list_sum(list_transform(list_zip(q.v, b.v), lambda z: z[1] * z[2])), 6) AS score
  FROM candidates c JOIN vecs q ON q.vec_id = c.query_id JOIN vecs b ON b.vec_id = c.vec_id)""",
    fx.ranked_sql("hits", "cosines", 10)))
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 50 by distance, reranked by a batch scorer (inner product)."""
    base, asked = fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    hits = exact_hits(spark, sf_dir, 50)
    pairs = hits.select("query_id", F.col("vec_id").alias("doc_id")).join(
        base.select(F.col("vec_id").alias("doc_id"), F.col("vector").alias("stored")), "doc_id"
    ).join(asked.select("query_id", F.col("vector").alias("asked")), "query_id")

    def scorer(batches):
        for batch in batches:
            left, right = np.stack(batch["asked"]).astype(float), np.stack(batch["stored"]).astype(float)
            yield batch.assign(score=(left * right).sum(axis=1))

    return scoring.rerank(pairs, scorer, 10).select("query_id", "doc_id", "rerank_score", "rank")


@query("head_tail_split", """
WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)
SELECT doc_id, 0 AS part, text AS chunk, CAST(greatest(len(w), 1) AS INTEGER) AS weight FROM t WHERE len(w) <= 200
UNION ALL SELECT doc_id, 0, array_to_string(list_slice(w, 1, 100), ' '), 100 FROM t WHERE len(w) > 200
UNION ALL SELECT doc_id, 1, array_to_string(list_slice(w, len(w) - 99, len(w)), ' '), 100 FROM t WHERE len(w) > 200""")
def head_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return head_tail(docs, "text", 200)


@query("vector_pool", """
WITH vecs AS (SELECT vec_id, label, vec_id % 7 + 1 AS weight, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
means AS (
  SELECT label, d, sum(x * weight) / sum(weight) AS m
  FROM (SELECT label, weight, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vecs) GROUP BY label, d)
SELECT label AS owner, CAST(d - 1 AS INTEGER) AS dim,
       round(m / (SELECT sqrt(sum(n.m * n.m)) FROM means n WHERE n.label = means.label), 6) AS value FROM means""")
def vector_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fx.vectors(spark, sf_dir).select(
        F.col("label").alias("owner"), "vector", (F.col("vec_id") % 7 + 1).alias("weight")
    )
    pooled = vector.pool_vectors(chunks, "owner")
    return pooled.select("owner", F.posexplode("vector").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query("embed_batches")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages encoded in two runs; the second adds what the first lacks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text", "lang")
    path = shared_dir(spark, "encoded")
    encoder = scoring.hashing_encoder()
    scoring.embed_batches(docs.where(F.col("lang") == "en"), path, encoder, "text_id")
    stored = scoring.embed_batches(docs, path, encoder, "text_id")
    norm = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return stored.select("text_id", F.size("vector").alias("dims"), F.round(F.sqrt(norm), 3).alias("norm"))


LABELS = """labelled AS (SELECT n.*, b.label FROM nearest n JOIN embeddings b ON b.vec_id = n.vec_id)"""


@query("unique_at_k", with_sql("""
SELECT query_id, """ + ", ".join(
    f"count(DISTINCT CASE WHEN rank <= {k} THEN label END) AS unique_at_{k}" for k in metrics.CUTOFFS
) + " FROM labelled GROUP BY query_id", fx.DISTANCES, fx.nearest_sql("nearest", "distances", 100), LABELS))
def unique_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = exact_hits(spark, sf_dir, 100).join(fx.vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return metrics.unique_at_k(hits, "query_id", "label")


@query("mean_unique_at_k", with_sql("SELECT count(*) AS questions, " + ", ".join(
    f"round(avg(u{k}), 6) AS unique_at_{k}" for k in metrics.CUTOFFS
) + " FROM (SELECT query_id, " + ", ".join(
    f"count(DISTINCT CASE WHEN rank <= {k} THEN label END) AS u{k}" for k in metrics.CUTOFFS
) + " FROM labelled GROUP BY query_id)", fx.DISTANCES, fx.nearest_sql("nearest", "distances", 100), LABELS))
def mean_unique_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_unique_at_k(unique_at_k(spark, sf_dir))


@query("ann_recall", with_sql("""
SELECT e.query_id, count(*) AS expected, count(a.vec_id) AS found, round(count(a.vec_id) / count(*), 6) AS overlap
FROM exact e LEFT JOIN approx a ON a.query_id = e.query_id AND a.vec_id = e.vec_id GROUP BY e.query_id""",
    fx.DISTANCES, CENTROIDS, fx.nearest_sql("exact", "distances", 10), """
probed AS (
  SELECT d.query_id, d.vec_id, d.distance FROM distances d
  JOIN assigned a ON a.vec_id = d.vec_id JOIN assigned q ON q.vec_id = d.query_id AND q.cid = a.cid)""",
    fx.nearest_sql("approx", "probed", 10)))
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the search in one list with the exact result."""
    assigned, centroids = lists(spark, sf_dir)
    near = vector.ivf_search(fx.vector_queries(spark, sf_dir), assigned, centroids, 1, 10, skip_same_id=True)
    return metrics.ann_recall(near, exact_hits(spark, sf_dir, 10), "query_id", "vec_id", 10)


@query("topk_export", with_sql("""
SELECT query_id,
       string_agg(CAST(vec_id AS VARCHAR), ';' ORDER BY rank) FILTER (rank <= 10) AS top_ids,
       string_agg(CAST(CAST(round(CAST(distance AS DECIMAL(18, 6)), 4) AS DECIMAL(18, 4)) AS VARCHAR), ';' ORDER BY rank)
         FILTER (rank <= 10) AS top_scores,
       (SELECT string_agg(CAST(label AS VARCHAR), ';' ORDER BY first) FROM (
          SELECT label, min(rank) AS first FROM labelled l WHERE l.query_id = labelled.query_id GROUP BY label)) AS papers
FROM labelled GROUP BY query_id""", fx.DISTANCES, fx.nearest_sql("nearest", "distances", 100), LABELS))
def topk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = exact_hits(spark, sf_dir, 100).join(fx.vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return metrics.export_topk(hits, "query_id", "vec_id", "label", "distance")
