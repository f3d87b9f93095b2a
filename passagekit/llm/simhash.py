"""SimHash near-duplicates through tables of pivot distances.

Every document gets a 64-bit fingerprint of its word shingles. Each distinct
fingerprint is stored with its Hamming distances to fixed reference fingerprints
(pivots). Two fingerprints that differ in at most k bits have distances to each pivot
that differ by at most k, so pairs whose largest difference is above k are discarded
without looking at the bits; the survivors are verified.

The tables alone would compare everything with everything. Fingerprints are therefore
dealt by blocks of bits first: with k differing bits, k + c blocks leave at least c
blocks untouched, so linked fingerprints share a choice of c blocks and no link is
lost. c grows with the number of fingerprints, which keeps the groups short. A large
group is dealt once more, by pairs of its slices. Groups return a spanning forest,
never all their pairs.

Defined results: null, empty and blank text has the fingerprint 0, which links like
any other; a text with fewer words than a shingle is one shingle; rows with equal ids
are documents of their own; null ids never name a component unless it has no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagekit.llm.common import fresh, table
from passagekit.llm.components import components
from passagekit.llm.shingles import SEED, SHINGLE, shingle_hashes  # noqa: F401
from passagekit.llm.similar import similar_links, with_keys
from passagekit.plans.registry import query
from passagekit.scale import broadcast_if_small, stage

# Fixed values of the result contract.
MAX_BITS = 4

PIVOTS = 16
PIVOT_SEED = 20_201

#: Fingerprints of one group that are compared in one task, and rows of a task.
MAX_GROUP = 4_096
TASK_ROWS = 60_000

#: Pairs held at once while a group is compared.
PAIRS_AT_ONCE = 1 << 20


def fingerprint(hashes: np.ndarray, rows_at_once: int = 1 << 16) -> int:
    """Bits set in more than half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), rows_at_once):
        part = hashes[start:start + rows_at_once].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer."""
    source = docs.drop(out)
    schema = T.StructType([*source.schema, T.StructField(out, T.LongType())])
    at = source.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(shingle_hashes(t.as_py(), size)) for t in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], [f.name for f in schema])

    return source.mapInArrow(run, schema)


def pivots(count: int = PIVOTS, seed: int = PIVOT_SEED) -> np.ndarray:
    """The reference fingerprints: fixed random bits."""
    return np.random.default_rng(seed).integers(0, 1 << 64, count, np.uint64)


def _distances(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :])


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, distances): one byte for each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            rows = _distances(values.view(np.uint64)).astype(np.uint8).tobytes()
            made = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(values), [None, pa.py_buffer(rows)])
            yield pa.RecordBatch.from_arrays([batch.column(0), made.cast(pa.binary())], ["fp", "distances"])

    return fps.select("fp").mapInArrow(run, "fp long, distances binary")


def block_masks(total: int, max_bits: int = MAX_BITS, wanted: int = 512) -> list[int]:
    """Masks of the bits that a group shares, as few as keep groups near ``wanted``."""
    kept = 1
    while kept < max_bits and total / 2 ** (64 * kept / (max_bits + kept)) > wanted:
        kept += 1
    count = max_bits + kept
    edges = [64 * i // count for i in range(count + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(count)]
    return [sum(choice) for choice in combinations(blocks, kept)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def dealt(tables: DataFrame, masks: list[int], max_group: int = MAX_GROUP) -> DataFrame:
    """(group, fp, distances): rows to be compared within each group.

    A group with more than ``max_group`` rows is cut into slices, and each pair of
    slices becomes a group.
    """
    shared = F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)
    ])
    rows = tables.select("fp", "distances", F.inline(shared))
    large = (
        tables.select(F.inline(shared)).groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > max_group)
        .select("t", "k", F.ceil(F.col("n") / (max_group // 2)).cast("int").alias("slices"))
    )
    # One row per large group: at most total * masks / max_group rows.
    joined = rows.join(broadcast_if_small(large), ["t", "k"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: s != own)
    pairs = F.transform(others, lambda s: F.least(own, s).cast("long") * F.col("slices") + F.greatest(own, s))
    turns = F.coalesce(pairs, F.array(F.lit(-1).cast("long")))
    return joined.select("fp", "distances", "t", "k", F.explode(turns).alias("pair")).select(
        F.xxhash64("t", "k", "pair").alias("group"), "fp", "distances"
    )


def _roots(count: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """``labels`` after uniting each a with its b."""
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while not np.array_equal(labels, labels[labels]):
            labels = labels[labels]
        if np.array_equal(before, labels):
            return labels


def linked(groups: np.ndarray, fps: np.ndarray, table_: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within groups: arrays of fingerprints (a, b)."""
    order = np.lexsort((table_[:, 0], groups))
    groups, fps, table_ = groups[order], fps[order], table_[order].astype(np.int16)
    number = np.cumsum(np.r_[0, groups[1:] != groups[:-1]])
    # Rows of a group stand by their first distance: partners lie in one range.
    place = number * 1_000 + table_[:, 0]
    last = np.searchsorted(place, place + max_bits, "right")
    first = np.arange(len(fps)) + 1
    sizes = np.maximum(last - first, 0)
    labels = np.arange(len(fps))
    done, ends = 0, np.cumsum(sizes)
    while done < len(fps):
        base = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
        count = sizes[done:stop]
        a = np.repeat(np.arange(done, stop), count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + first[a]
        for pivot in range(1, table_.shape[1]):
            near = np.abs(table_[a, pivot] - table_[b, pivot]) <= max_bits
            a, b = a[near], b[near]
        true = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        if true.any():
            labels = _roots(len(fps), a[true], b[true], labels)
        done = stop
    leaf = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[leaf], fps[labels[leaf]]


def find_links(
    fps: DataFrame, total: int, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP, masks: list[int] | None = None
) -> DataFrame:
    """(a, b): links that connect whatever is within ``max_bits`` of each other.

    ``total`` is the number of rows of ``fps``; it sets the masks if none are given.
    """
    tables = stage(pivot_table(fps), "pivot-table")
    masks = block_masks(total, max_bits) if masks is None else masks
    tasks = max(1, -(-total * len(masks) // TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        groups = rows.column("group").to_numpy()
        values = rows.column("fp").to_numpy().view(np.uint64)
        distances = np.frombuffer(b"".join(rows.column("distances").to_pylist()), np.uint8).reshape(-1, PIVOTS)
        a, b = linked(groups, values, distances, max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    # A task holds about TASK_ROWS narrow rows; a group has max_group at most.
    spread = dealt(tables, masks, max_group).repartition(tasks, "group")
    return spread.mapInArrow(run, "a long, b long")


def classes(
    prints: DataFrame, id_col: str, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP,
    links: Callable[[int], DataFrame] | None = None,
) -> DataFrame:
    """(fp, component, n_rows) of a stored table ``prints`` (id_col, fp).

    ``component`` is the smallest id of all rows that links reach. ``links`` makes
    other links than those of near fingerprints, from the number of distinct ones.
    """
    known = stage(prints.groupBy("fp").agg(F.min(id_col).alias("smallest"), F.count("*").alias("n_rows")), "fingerprints")
    total = known.count()
    roots = components(links(total) if links else find_links(known, total, max_bits, max_group))
    placed = known.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    placed = stage(placed.withColumn("root", F.coalesce("root", "fp")), "placed")
    # Stored, so that the join with a very large class is one that Spark can split.
    named = stage(placed.groupBy("root").agg(F.min("smallest").alias("component")), "named")
    return stage(placed.join(named, "root").select("fp", "root", "component", "n_rows"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id), one row per input row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = stage(with_fingerprints(source, "text", "fp").select("id", "fp"), "prints")
    found = classes(prints, "id")
    return prints.join(found.select("fp", "component"), "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def print_pairs(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(m, c), stored: pairs of keys whose fingerprints are near, found through the pivot tables.

    ``prints`` is a stored table (fp, print) of distinct rows. The keys of one fingerprint
    meet the smallest of them, and these meet along the links of the fingerprints, so
    there are never more pairs than rows.
    """
    known = stage(prints.groupBy("print").agg(F.min("fp").alias("head")), "print-heads")
    links = find_links(known.select(F.col("print").alias("fp")), known.count(), max_bits)
    links = stage(links.distinct(), "print-links")
    heads = lambda name: known.toDF(name, f"{name}_head")
    across = links.join(heads("a"), "a").join(heads("b"), "b").select(F.col("a_head").alias("fp"), F.col("b_head").alias("head"))
    pairs = prints.join(known, "print").select("fp", "head").unionByName(across).where(F.col("fp") != F.col("head"))
    return stage(pairs.select(F.greatest("fp", "head").alias("m"), F.least("fp", "head").alias("c")).distinct(), "print-pairs")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS,
    similarity: float | None = None,
) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest id.

    With ``similarity``, near-duplicates are texts whose sets of shingles have at least
    that Jaccard similarity: pairs with fingerprints within ``max_bits`` are found through
    the pivot tables and compared exactly, then an exact search adds those whose
    fingerprints differ more. What goes is usually little, and is sent to all workers
    while it is.
    """
    mark = fresh(docs.columns, "fingerprint")
    also = fresh([*docs.columns, mark], "print")
    if similarity is None:
        made = with_fingerprints(docs, text_col, mark, size)
    else:
        made = with_keys(docs, text_col, mark, size, also, fingerprint)
    held = stage(made, "with-fingerprints", "zstd")
    texts = held.select(F.col(mark).alias("fp"), F.col(text_col).alias("text"))

    def similar(total: int) -> DataFrame:
        known = stage(held.select(F.col(mark).alias("fp"), F.col(also).alias("print")).where(F.col("fp") != 0).distinct(), "prints")
        return similar_links(texts, total, size, similarity, print_pairs(known, max_bits))

    links = None if similarity is None else similar
    key = F.struct(F.col(id_col).alias("id"), F.col(mark).alias("fp"))
    prints = held.select(key.alias("key")).select("key.id", "key.fp")
    found = classes(prints, "id", max_bits, links=links)
    counted = prints.groupBy("id", "fp").agg(F.count("*").alias("rows")).join(found.select("fp", "root"), "fp")
    # Null ids come last, so that a document without an id stays only if it must.
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("fp").alias("fp"))
    counted = stage(counted, "counted")
    best = stage(counted.groupBy("root").agg(F.min(order).alias("best")), "best")
    judged = counted.join(best, "root").select(
        F.struct("id", "fp").alias("key"), "rows",
        (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.fp") == F.col("fp"))).alias("stays"),
    )
    judged = stage(judged, "judged")
    name = fresh([*docs.columns, mark], "_key")
    keyed = held.withColumn(name, key)
    gone = judged.where(~F.col("stays")).select(F.col("key").alias(name))
    left = keyed.drop(also).join(broadcast_if_small(gone), name, "left_anti")
    several = stage(judged.where(F.col("stays") & (F.col("rows") > 1)).select(F.col("key").alias(name)), "several")
    if not several.isEmpty():
        # The same id and fingerprint more than once: one of these rows stays.
        single = left.join(broadcast_if_small(several), name, "left_anti")
        left = single.unionByName(left.join(broadcast_if_small(several), name, "left_semi").dropDuplicates([name]))
    return left.select(*docs.columns)


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
