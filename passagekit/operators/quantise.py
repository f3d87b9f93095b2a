"""Product quantisation of list residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from passagekit.functions import vectors as kernel
from passagekit.operators.vector import (
    QUERY_SLICE, _centres, _hit_schema, _hits, _ranked, ivf_probes, paired_blocks, probed_only,
)
from passagekit.scale import hash_sample, stage


def _residuals(vectors: np.ndarray, cids: np.ndarray, names: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return vectors - centres[np.searchsorted(names, cids)]


def _codes(residuals: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Nearest code word per sub-space; ``books`` is (parts, words, width)."""
    parts, _, width = books.shape
    split = residuals.reshape(len(residuals), parts, width)
    return np.stack([kernel.closest(split[:, m], books[m]) for m in range(parts)], axis=1)


def pq_fit(
    lists: DataFrame,
    centroids: DataFrame,
    parts: int = 64,
    words: int = 256,
    iterations: int = 10,
    seed: str = "1234",
    sample: int = 1_000_000,
) -> np.ndarray:
    """Code books (parts, words, width) of the residuals, by Lloyd's method.

    All sub-spaces are refined together: every task sums the residuals per
    (part, word), Spark adds the sums, and only the books (parts x words
    rows) come back to the driver, one job per iteration.
    """
    names, centres = _centres(centroids)
    spark = lists.sparkSession
    # Written once: every iteration reads it.
    training = stage(
        hash_sample(lists.select("vec_id", "vector", "cid"), sample, "vec_id", seed), "training"
    )
    start = hash_sample(training, words, "vec_id", seed + "-words").toPandas().sort_values("vec_id")
    seeds = _residuals(kernel.stack(start["vector"]), start["cid"].to_numpy(), names, centres)
    width = seeds.shape[1] // parts
    if seeds.shape[1] != parts * width:
        raise ValueError(f"{seeds.shape[1]} dimensions do not split into {parts} parts")
    books = seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()

    for _ in range(iterations):
        shared = spark.sparkContext.broadcast((names, centres, books))

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            labels, middles, current = shared.value
            sums = np.zeros_like(current)
            counts = np.zeros(current.shape[:2])
            for batch in batches:
                if batch.empty:
                    continue
                rest = _residuals(kernel.stack(batch["vector"]), batch["cid"].to_numpy(), labels, middles)
                codes = _codes(rest, current)
                split = rest.reshape(len(rest), current.shape[0], -1)
                for m in range(current.shape[0]):
                    np.add.at(sums[m], codes[:, m], split[:, m])
                    counts[m] += np.bincount(codes[:, m], minlength=current.shape[1])
            used = np.argwhere(counts > 0)
            flat = np.arange(current.shape[2])
            if len(used):
                yield pd.DataFrame({
                    "part": np.repeat(used[:, 0], len(flat)),
                    "word": np.repeat(used[:, 1], len(flat)),
                    "dim": np.tile(flat, len(used)),
                    "total": sums[used[:, 0], used[:, 1]].ravel(),
                    "n": np.repeat(counts[used[:, 0], used[:, 1]], len(flat)),
                })

        moved = (
            training.mapInPandas(partial, "part int, word int, dim int, total double, n double")
            .groupBy("part", "word", "dim")
            .agg((F.sum("total") / F.sum("n")).alias("value"))
            .toPandas()
        )
        books = books.copy()
        books[moved["part"], moved["word"], moved["dim"]] = moved["value"]
    return books


def pq_encode(lists: DataFrame, centroids: DataFrame, books: np.ndarray) -> DataFrame:
    """Add ``codes``, one code word per sub-space of the residual."""
    names, centres = _centres(centroids)
    shared = lists.sparkSession.sparkContext.broadcast((names, centres, books))

    @pandas_udf("array<smallint>")
    def encode(vector: pd.Series, cid: pd.Series) -> pd.Series:
        labels, middles, current = shared.value
        codes = _codes(_residuals(kernel.stack(vector), cid.to_numpy(), labels, middles), current)
        return pd.Series(list(codes.astype(np.int16)))

    return lists.withColumn("codes", encode("vector", "cid"))


def _code_search(shared, k: int, skip_same_id: bool):
    """Hits of a block of queries and codes; ``shared`` holds list names, centroids and books."""

    def search(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or stored.empty:
            return _hits([], [], [])
        labels, middles, current = shared.value
        parts, _, width = current.shape
        codes = np.stack([np.asarray(c, dtype=np.int64) for c in stored["codes"]])
        base_ids = stored["vec_id"].to_numpy()
        # The sum of table entries is the distance to the vector that the codes stand for.
        meant = np.concatenate([current[m][codes[:, m]] for m in range(parts)], axis=1)
        cuts = list(kernel.blocks(len(codes)))
        screens = [kernel.Screen(meant[block]) for block in cuts]
        found = []
        for start in range(0, len(asked), QUERY_SLICE):
            some = asked.iloc[start : start + QUERY_SLICE]
            rest = _residuals(kernel.stack(some["vector"]), some["cid"].to_numpy(), labels, middles)
            split = rest.reshape(len(rest), parts, width)
            tables = [kernel.squared_distances(split[:, m], current[m]) for m in range(parts)]
            best = kernel.Best(some["query_id"].to_numpy(), rest, k, skip_same_id)
            for block, screen in zip(cuts, screens):
                mine = codes[block]
                best.offer(
                    base_ids[block], screen, lambda _: sum(table[:, mine[:, m]] for m, table in enumerate(tables)),
                    lambda _, rows, cols: sum(table[rows, mine[cols, m]] for m, table in enumerate(tables)),
                )
            hits = best.found()
            if hits:
                found.append(_hits(*hits))
        return pd.concat(found, ignore_index=True) if found else _hits([], [], [])

    return search


def pq_search(
    queries: DataFrame,
    encoded: DataFrame,
    centroids: DataFrame,
    books: np.ndarray,
    nprobe: int,
    k: int,
    skip_same_id: bool = False,
) -> DataFrame:
    """Search over codes: the distance is a sum of table entries.

    The stored vectors are not read; a query brings one table per probed list.
    """
    names, centres = _centres(centroids)
    shared = queries.sparkSession.sparkContext.broadcast((names, centres, books))
    probes = stage(ivf_probes(queries.select("query_id", "vector"), centroids, nprobe), "probes")
    blocks = paired_blocks(probes, probed_only(probes, encoded.select("vec_id", "codes", "cid")))

    return _ranked(blocks.applyInPandas(_code_search(shared, k, skip_same_id), _hit_schema(queries, encoded)), k)
