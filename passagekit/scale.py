"""Helpers that keep plans safe when one key holds a large share of the rows.

Nothing here inspects more than a bounded number of rows on the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

#: A table with at most this many (narrow) rows may be broadcast.
BROADCAST_ROWS = 500_000

#: Largest top-k that Spark should prune before the shuffle. Spark's own
#: default is 1,000, below the cut-offs used by the lexical cascade.
PRUNE_TOP_K = 40_000

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": str(PRUNE_TOP_K),
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the operators rely on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, reachable by executors.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        base = tempfile.mkdtemp(prefix="passagekit-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark's option to delete the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's option to shuffle both sides of a join by all its keys, even if one lies by some of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Spark's option to collect lists in a hash table, which beyond a few groups is sorted and spilled.
HASHED_LISTS = "spark.sql.execution.useObjectHashAggregateExec"


@contextmanager
def _option(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Delete the shuffle files of every table written inside once it is written.

    A write plans its own shuffles, so nothing else reads them; Spark would keep them
    until the driver happens to collect garbage.
    """
    return _option(spark, CLEANUP, "true")


def rows_kept_in_place(spark: SparkSession) -> AbstractContextManager[None]:
    """Let joins in the tables written inside leave rows where some of their keys brought them.

    For rows that several joins meet by one key and by more keys that include it: they are
    shuffled once, by the key that all have.
    """
    return _option(spark, ALL_KEYS, "false")


def lists_by_one_sort(spark: SparkSession) -> AbstractContextManager[None]:
    """Let lists in the tables written inside be collected from sorted rows.

    For lists of lists whose keys begin alike: the rows are sorted once for all levels, where
    each level would sort what the one before made of them.
    """
    return _option(spark, HASHED_LISTS, "false")


def stage(df: DataFrame, label: str = "stage", compression: str = "snappy") -> DataFrame:
    """Stage boundary: write a Parquet table to the shared folder, read it back.

    Later joins see real file sizes, and a lost executor re-reads the table
    instead of recomputing everything before it.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.stage_path = path
    return written


def drop_stage(df: DataFrame) -> None:
    """Delete a table that ``stage`` returned. Nothing that is still to run may read it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, counting no further."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write ``df`` once, and hint a broadcast only if it has few rows.

    A larger table is joined by a shuffle, where AQE splits hot keys.
    """
    written = stage(df, "join-side")
    return F.broadcast(written) if fits(written, max_rows) else written


def left_join(left: DataFrame, right: DataFrame, key: str, spread_by: Sequence[str]) -> DataFrame:
    """Left join on a string key that is null for many rows of ``left``.

    Null keys match nothing, yet would all be sent to one task. Each gets a
    key of its own instead, made from ``spread_by``. A ``right`` of few rows is sent to
    all workers, so that few keys with very many rows do not meet in few tasks.
    """
    alone = F.concat(F.lit("\u0000"), F.xxhash64(*spread_by).cast("string"))
    keyed = left.withColumn("_key", F.coalesce(F.col(key), alone))
    return keyed.join(broadcast_if_small(right.withColumnRenamed(key, "_key")), "_key", "left").drop("_key")


def salt(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows per key with their rank.

    Written as ``row_number() <= k`` so that Catalyst plans a
    WindowGroupLimit: each task forwards at most ``k`` rows per key, however
    large the key's group is.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window).cast("int"))
    return ranked.where(F.col(rank) <= k)


def one_per_id(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """One row per id: the first in ``order``. Rows without an id are all kept.

    Only ids are shuffled to find the repeated ones; of these alone the rows meet.
    """
    counts = df.groupBy(id_col).agg(F.count("*").alias("_copies")).where(F.col("_copies") > 1)
    repeated = broadcast_if_small(counts.select(id_col))
    copies = top_k(df.join(repeated, id_col, "left_semi"), [id_col], [F.asc(c) for c in order], 1, "_copy")
    return df.join(repeated, id_col, "left_anti").unionByName(copies.drop("_copy"))


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Dense 0-based position in the total order of ``order``.

    The rows are range-partitioned and sorted once, checkpointed so that both
    passes see the same partitions, and numbered as partition offset + local
    position. Only one count per partition is ever gathered.
    """
    shared_dir(df.sparkSession, "index")
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .checkpoint()
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition: the partition count bounds this broadcast.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + local).cast("long"))
        .drop("_at", "_part", "_offset")
    )


def hash_sample(
    df: DataFrame,
    n: int,
    id_col: str,
    seed: str,
    by: Sequence[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """Exactly the ``n`` rows per stratum with the smallest ``md5(seed‖id)``.

    Counting rows per hash prefix finds the prefix at which ``n`` is reached.
    Rows below it are kept where they are; of the rows that share the boundary
    prefix only hash and id are shuffled and ranked. The prefix is long enough
    (``digits``, by default from the number of rows) that about 1,000 rows share it,
    so a stratum holding most of the table never meets in one task.
    """
    if digits is None:
        digits = 3
        total = df.count()
        while digits < 12 and total > 1_000 * 16**digits:
            digits += 1
    strata = list(by)
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))))
    hashed = hashed.withColumn("_prefix", F.substring("_hash", 1, digits))
    if strata:
        present = F.lit(True)
        for column in strata:
            present = present & F.col(column).isNotNull()
        hashed = hashed.where(present)
    counts = hashed.groupBy(*strata, "_prefix").agg(F.count("*").alias("_n"))
    # At most 16**digits rows per stratum reach this window.
    running = W.partitionBy(*(strata or [F.lit(0)])).orderBy("_prefix")
    before = running.rowsBetween(W.unboundedPreceding, -1)
    prefixes = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    edge = prefixes.where(F.col("_before") < n).groupBy(*strata).agg(
        F.max(F.struct("_prefix", "_before", "_n")).alias("_edge")
    )
    # One row per stratum: broadcast, so that the table is not shuffled by it.
    edge = broadcast_if_small(
        edge.select(
            *strata,
            F.col("_edge._prefix").alias("_edge_prefix"),
            (F.lit(n) - F.col("_edge._before")).alias("_left"),
            (F.col("_edge._before") + F.col("_edge._n") <= n).alias("_edge_whole"),
        )
    )
    if strata:
        marked = hashed.join(edge, strata)
    else:
        marked = hashed
        for name in ("_edge_prefix", "_left", "_edge_whole"):
            marked = marked.withColumn(name, edge.select(name).scalar())
    whole = (F.col("_prefix") < F.col("_edge_prefix")) | (
        (F.col("_prefix") == F.col("_edge_prefix")) & F.col("_edge_whole")
    )
    boundary = (F.col("_prefix") == F.col("_edge_prefix")) & ~F.col("_edge_whole")
    window = W.partitionBy(*strata, "_prefix").orderBy("_hash")
    narrow = marked.where(boundary).select(*strata, "_prefix", "_hash", "_left")
    chosen = narrow.withColumn("_pos", F.row_number().over(window)).where(F.col("_pos") <= F.col("_left"))
    # The last hash that is taken, and how many rows with it: more than one only for
    # a repeated id. One row per stratum.
    last = broadcast_if_small(
        chosen.groupBy(*strata, "_hash").agg(F.count("*").alias("_need"))
        .groupBy(*strata).agg(F.max(F.struct("_hash", "_need")).alias("_end"))
    )
    if strata:
        near = marked.where(boundary).join(last, strata)
    else:
        near = marked.where(boundary).withColumn("_end", last.select("_end").scalar())
    below = near.where(F.col("_hash") < F.col("_end._hash"))
    copies = W.partitionBy(*strata, "_hash").orderBy(id_col)
    ties = near.where(F.col("_hash") == F.col("_end._hash")).withColumn("_pos", F.row_number().over(copies))
    cut = below.select(*df.columns).unionByName(ties.where(F.col("_pos") <= F.col("_end._need")).select(*df.columns))
    return marked.where(whole).select(*df.columns).unionByName(cut)
