"""Exact and cluster-pruned nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from passagekit.functions import vectors as kernel
from passagekit.scale import hash_sample, row_index, salt, stage, top_k

#: Query vectors (as float64) that may be broadcast; above it they are joined.
MAX_QUERY_BYTES = 128 * 1024 * 1024
#: Base vectors and queries that may meet in one block.
BLOCK_ROWS = 20_000
QUERY_ROWS = 16_000
#: Queries compared with one Arrow batch at a time, as far as their matrix is bounded.
QUERY_SLICE = 512
#: Bytes of one hit while it is held and merged.
HIT_BYTES = 72


def _hit_schema(queries: DataFrame, base: DataFrame) -> str:
    query_type = queries.schema["query_id"].dataType.simpleString()
    base_type = base.schema["vec_id"].dataType.simpleString()
    return f"query_id {query_type}, vec_id {base_type}, distance double"


def _hits(query_ids, base_ids, values) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query_ids, "vec_id": base_ids, "distance": values})


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, ["query_id"], [F.asc("distance"), F.asc("vec_id")], k)


def _small_enough(queries: DataFrame, k: int, max_bytes: int) -> bool:
    """Whether the queries and ``k`` hits of each may be held by every task."""
    width = queries.select(F.size("vector").alias("d")).first()
    if width is None:
        return True
    limit = max_bytes // (8 * max(width.d, 1) + HIT_BYTES * k)
    return queries.select("query_id").limit(limit + 1).count() <= limit


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` queries whose distances to ``width`` vectors fit in one matrix."""
    size = max(1, min(QUERY_SLICE, kernel.MATRIX_CELLS // max(width, 1)))
    return (slice(start, start + size) for start in range(0, rows, size))


def _begun(ids: np.ndarray, matrix: np.ndarray, k: int, skip_same_id: bool) -> list[kernel.Best]:
    return [kernel.Best(ids[part], matrix[part], k, skip_same_id) for part in _slices(len(ids), 1)]


def _found(best: list[kernel.Best], *kinds: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Hits with ids of the given types; numpy has none for numbers with nulls."""
    for hits in (part.found() for part in best):
        if hits:
            columns = [pa.array(column, from_pandas=True).cast(kind) for column, kind in zip(hits, [*kinds, pa.float64()])]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "distance"])


def knn_exact(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    skip_same_id: bool = False,
    max_query_bytes: int = MAX_QUERY_BYTES,
) -> DataFrame:
    """``k`` nearest base vectors (squared L2) of every query.

    ``queries`` is (query_id, vector), ``base`` (vec_id, vector). A query set
    that is below the byte limit together with its hits is broadcast and the base is
    scanned once, each task keeping ``k`` hits per query. A larger one is cut into chunks
    of bounded size, one to a task. The base streams past each chunk, which keeps ``k`` hits per query,
    so that only these leave a task.
    """
    schema = _hit_schema(queries, base)
    if _small_enough(queries, k, max_query_bytes):
        local = queries.select("query_id", "vector").toArrow().combine_chunks()
        shared = base.sparkSession.sparkContext.broadcast(local)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            if not wanted.num_rows:
                return
            ids, vectors = (column.combine_chunks() for column in wanted.columns)
            best = _begun(ids.to_numpy(zero_copy_only=False), kernel.matrix_of(vectors), k, skip_same_id)
            for batch in batches:
                kind = batch.column(0).type
                kernel.offer_vectors(best, batch.column(0).to_numpy(zero_copy_only=False), kernel.matrix_of(batch.column(1)))
            yield from _found(best, ids.type, kind) if best[0].seen else ()

        return _ranked(base.select("vec_id", "vector").mapInArrow(scan, schema), k)

    rows = queries.count()
    tasks = 2 * base.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-rows // QUERY_ROWS), min(tasks, rows // QUERY_SLICE))
    query_type, base_type = queries.schema["query_id"].dataType, base.schema["vec_id"].dataType
    left = queries.select(
        salt(["query_id"], chunks).alias("chunk"), F.lit(0).alias("side"), "query_id", F.lit(None).cast(base_type).alias("vec_id"), "vector"
    )
    right = base.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("side"),
        F.lit(None).cast(query_type).alias("query_id"), "vec_id", "vector",
    )
    # One chunk to a task: by hash some tasks would get several and others none.
    met = left.unionByName(right).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "side")
    return _ranked(met.mapInArrow(_stream_search(k, skip_same_id), schema), k)


def _stream_search(k: int, skip_same_id: bool):
    """Hits of each chunk from rows ordered by chunk, its queries before all base vectors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, asked, best, kinds = None, [], [], ()
        for batch in batches:
            kinds = batch.column(2).type, batch.column(3).type
            chunks, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(sides) != 0)) + 1
            for start, stop in zip(np.r_[0, edges], np.r_[edges, len(chunks)]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if chunks[start] != chunk:
                    yield from _found(best, *kinds)
                    chunk, asked, best = chunks[start], [], []
                vectors = kernel.matrix_of(part.column(4))
                if sides[start] == 0:
                    asked.append((part.column(2).to_numpy(zero_copy_only=False), vectors))
                    continue
                if asked:
                    best = _begun(*(np.concatenate(column) for column in zip(*asked)), k, skip_same_id)
                    asked = []
                if best:
                    kernel.offer_vectors(best, part.column(3).to_numpy(zero_copy_only=False), vectors)
        yield from _found(best, *kinds)

    return search


def _cogrouped(left: DataFrame, right: DataFrame, keys: list[str]):
    """Both sides by key; fresh column names let them come from one table."""
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def _block_search(k: int, skip_same_id: bool):
    def search(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or stored.empty:
            return _hits([], [], [])
        ids, base_ids = asked["query_id"].to_numpy(), stored["vec_id"].to_numpy()
        matrix, base_matrix = kernel.stack(asked["vector"]), kernel.stack(stored["vector"])
        best = _begun(ids, matrix, k, skip_same_id)
        kernel.offer_vectors(best, base_ids, base_matrix)
        parts = [_hits(*hits) for hits in (slice_.found() for slice_ in best) if hits]
        return pd.concat(parts, ignore_index=True) if parts else _hits([], [], [])

    return search


# -- ids, samples, clusters -------------------------------------------------


def vector_ids(base: DataFrame, order: Sequence[str] = ("vec_id",)) -> DataFrame:
    """Dense surrogate number of every vector id, in order."""
    return row_index(base.select(*order), list(order), "vector_no")


def training_sample(base: DataFrame, n: int = 1_000_000, seed: str = "1234") -> DataFrame:
    """Seeded sample of exactly ``n`` vectors over the whole table."""
    return hash_sample(base, n, "vec_id", seed)


def label_centroids(base: DataFrame, label: str) -> DataFrame:
    """Mean vector per label as (cid, centroid); means are pre-aggregated."""
    mean = Summarizer.mean(array_to_vector("vector"))
    return base.groupBy(F.col(label).cast("int").alias("cid")).agg(
        vector_to_array(mean).alias("centroid")
    )


def ivf_fit(sample: DataFrame, lists: int, seed: int = 1234, iterations: int = 20) -> DataFrame:
    """Coarse centroids (cid, centroid) from k-means over a training sample."""
    model = KMeans(k=lists, seed=seed, maxIter=iterations).fit(
        sample.select(array_to_vector("vector").alias("features"))
    )
    rows = [(place, [float(x) for x in centre]) for place, centre in enumerate(model.clusterCenters())]
    return sample.sparkSession.createDataFrame(rows, "cid int, centroid array<double>")


def _centres(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centroids on the driver, bounded by the number of lists."""
    local = centroids.orderBy("cid").toPandas()
    return local["cid"].to_numpy(), kernel.stack(local["centroid"])


def ivf_assign(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``cid``, the nearest centroid; the lowest id wins a tie."""
    cids, matrix = _centres(centroids)
    shared = base.sparkSession.sparkContext.broadcast((cids, matrix))

    @pandas_udf("int")
    def nearest_list(batch: pd.Series) -> pd.Series:
        names, centres = shared.value
        return pd.Series(names[kernel.closest(kernel.stack(batch), centres)])

    return base.withColumn("cid", nearest_list("vector"))


def ivf_probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """One row per query and probed list."""
    cids, matrix = _centres(centroids)
    shared = queries.sparkSession.sparkContext.broadcast((cids, matrix))

    @pandas_udf("array<int>")
    def nearest_lists(batch: pd.Series) -> pd.Series:
        names, centres = shared.value
        return pd.Series(kernel.closest_few(kernel.stack(batch), centres, names, nprobe))

    return queries.withColumn("cid", F.explode(nearest_lists("vector")))


def write_lists(lists: DataFrame, path: str, salts: int = 8) -> None:
    """Store assigned (or encoded) vectors partitioned by list.

    The salt spreads a list that holds most of the vectors over several files.
    """
    lists.repartition(F.col("cid"), salt(["vec_id"], salts)).write.partitionBy("cid").parquet(path)


def probed_only(probes: DataFrame, lists: DataFrame) -> DataFrame:
    """The lists some query probes, as a static filter on ``cid``.

    Stored partitioned by ``cid``, the other lists are then never opened. The
    number of lists bounds the collected values.
    """
    wanted = [row.cid for row in probes.select("cid").distinct().collect()]
    return lists.where(F.col("cid").isin(wanted))


def paired_blocks(probes: DataFrame, lists: DataFrame):
    """Queries and stored vectors of the same list in blocks of bounded size.

    A list with very many vectors is cut into fragments, one probed by very
    many queries into chunks; every chunk meets every fragment of its list.
    Both tables of sizes have one row per list.
    """
    cuts = lambda df, size, name: df.groupBy("cid").agg(
        F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name)
    )
    sizes = cuts(lists, BLOCK_ROWS, "_fragments").join(cuts(probes, QUERY_ROWS, "_chunks"), "cid")
    sizes = F.broadcast(sizes)
    copies = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    place = lambda id_col, name: F.pmod(F.xxhash64(id_col), F.col(name)).cast("int")
    left = (
        probes.join(sizes, "cid")
        .withColumn("chunk", place("query_id", "_chunks"))
        .withColumn("fragment", copies("_fragments"))
    )
    right = (
        lists.join(sizes, "cid")
        .withColumn("fragment", place("vec_id", "_fragments"))
        .withColumn("chunk", copies("_chunks"))
    )
    drop = ["_fragments", "_chunks"]
    return _cogrouped(left.drop(*drop), right.drop(*drop), ["cid", "chunk", "fragment"])


def ivf_search(
    queries: DataFrame,
    lists: DataFrame,
    centroids: DataFrame,
    nprobe: int,
    k: int,
    skip_same_id: bool = False,
) -> DataFrame:
    """Exact distances to the vectors of the ``nprobe`` nearest lists only.

    ``lists`` is (vec_id, vector, cid), best as stored by ``write_lists``.
    """
    probes = stage(ivf_probes(queries.select("query_id", "vector"), centroids, nprobe), "probes")
    blocks = paired_blocks(probes, probed_only(probes, lists.select("vec_id", "vector", "cid")))
    schema = _hit_schema(queries, lists)
    return _ranked(blocks.applyInPandas(_block_search(k, skip_same_id), schema), k)


def vector_rerank(
    candidates: DataFrame,
    queries: DataFrame,
    base: DataFrame,
    k: int,
) -> DataFrame:
    """Candidates (query_id, vec_id) re-ordered by vector distance."""
    pairs = candidates.select("query_id", "vec_id").join(
        base.select("vec_id", F.col("vector").alias("_stored")), "vec_id"
    ).join(queries.select("query_id", F.col("vector").alias("_asked")), "query_id")

    @pandas_udf("double")
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        difference = kernel.stack(left) - kernel.stack(right)
        return pd.Series(np.round((difference * difference).sum(axis=1), kernel.DECIMALS))

    scored = pairs.withColumn("distance", distance("_asked", "_stored"))
    return _ranked(scored.select("query_id", "vec_id", "distance"), k)


def pool_vectors(chunks: DataFrame, owner: str, vector: str = "vector", weight: str = "weight") -> DataFrame:
    """Weighted mean of an owner's chunk vectors, scaled to unit length.

    A zero vector stays as it is. Sums are pre-aggregated in every task.
    """
    mean = Summarizer.mean(array_to_vector(vector), F.col(weight).cast("double"))
    pooled = chunks.groupBy(owner).agg(mean.alias("_mean"))
    scaled = Normalizer(inputCol="_mean", outputCol="_unit", p=2.0).transform(pooled)
    return scaled.select(owner, vector_to_array("_unit").alias("vector"))
