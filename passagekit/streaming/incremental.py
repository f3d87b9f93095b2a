"""Incremental verdict runs over arriving result files."""

from __future__ import annotations

from collections.abc import Callable
import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from passagekit.scale import broadcast_if_small

#: The source file of a row, and what tells two versions of a file apart.
FILE = "_source_file"
FILE_FIELDS = {"file_path": "_file_path", "file_size": "_file_size", "file_modification_time": "_file_time"}
LEDGER = "_file_path string, _file_size long, _file_time timestamp, run string, batch_id long"


def run_incremental(
    spark: SparkSession,
    source: str,
    schema: StructType,
    process: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process the files that arrived since the last run, then stop.

    Every micro-batch overwrites its own partition of the target, so a batch
    repeated after a failure replaces what it wrote before: no row is lost or
    doubled. Partitions are named after the checkpoint's own id and the batch, so
    several sources, or a new checkpoint, add to a target without touching what is
    there.

    A ledger beside the target lists the source files (path, length, modification
    time) of each batch. It is written last and commits the batch. Files that another
    batch has committed are skipped, so a lost checkpoint repeats no row. Rows with an
    ``error`` are written to a table of their own in the same batch. Returns the
    finished query.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # Spark stores the id of the run in the checkpoint before its first batch.
        stored = session.read.text(f"{checkpoint}/metadata").first().value
        run = json.loads(stored)["id"]
        place = f"run={run}/batch_id={batch_id}"
        named = batch.select("*", *[F.col(FILE)[field].alias(name) for field, name in FILE_FIELDS.items()]).drop(FILE)
        files = list(FILE_FIELDS.values())
        ledger = read_ledger(session, target)
        # A repeated batch is not kept from its own files.
        others = ledger.where(~((F.col("run") == run) & (F.col("batch_id") == batch_id)))
        fresh = named.join(broadcast_if_small(others.select(*files).distinct()), files, "left_anti")
        process(fresh.drop(*files)).write.mode("overwrite").parquet(f"{target}/{place}")
        written = session.read.parquet(f"{target}/{place}")
        if "error" in written.columns:
            written.where(F.col("error").isNotNull()).write.mode("overwrite").parquet(f"{target}/_errors/{place}")
        fresh.select(*files).distinct().coalesce(1).write.mode("overwrite").parquet(f"{target}/_ledger/{place}")

    query = (
        reader.parquet(source)
        .select("*", F.col("_metadata").alias(FILE))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def read_ledger(spark: SparkSession, target: str) -> DataFrame:
    """(_file_path, _file_size, _file_time, run, batch_id) of all committed batches.

    A batch without new files has no row; its rows are none, too.
    """
    schema = StructType.fromDDL(LEDGER)
    # Appending nothing creates the table for the first run.
    spark.createDataFrame([], schema).write.partitionBy("run", "batch_id").mode("append").parquet(f"{target}/_ledger")
    return spark.read.schema(schema).parquet(f"{target}/_ledger")


def _committed(spark: SparkSession, target: str, table: str, schema: StructType) -> DataFrame:
    full = StructType(list(schema.fields)).add("run", "string").add("batch_id", "long")
    batches = read_ledger(spark, target).select("run", "batch_id").distinct()
    rows = spark.read.schema(full).parquet(table)
    return rows.join(broadcast_if_small(batches), ["run", "batch_id"], "left_semi").drop("run", "batch_id")


def read_target(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """Everything that the committed batches of all runs produced."""
    return _committed(spark, target, target, schema)


def read_errors(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The error table: rows of committed batches that carry an error."""
    return _committed(spark, target, f"{target}/_errors", schema)
