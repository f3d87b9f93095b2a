"""Scans of the corpus, of tab-separated sources and of question files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType, StructType

from passagekit import schemas


def read_paragraphs(
    spark: SparkSession, path: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """Corpus scan: ``shard=*`` partitions, null texts dropped at the scan."""
    scan = spark.read.schema(schemas.PARAGRAPHS).parquet(path)
    scan = scan.where(F.col("paragraph_text").isNotNull())
    return scan.select(*columns) if columns else scan


def _file_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number of rows that each file's footer promises; -1 without a footer."""
    import pyarrow.fs
    import pyarrow.parquet

    for batch in batches:
        promised = []
        for path in batch["path"]:
            uri = re.sub(r"^file:/+", "file:///", path)
            try:
                system, name = pyarrow.fs.FileSystem.from_uri(uri)
                promised.append(pyarrow.parquet.read_metadata(name, filesystem=system).num_rows)
            except Exception:
                promised.append(-1)
        yield batch.assign(rows_promised=promised)


def read_tolerant(
    spark: SparkSession, path: str, schema: StructType | str
) -> tuple[DataFrame, DataFrame]:
    """Rows of all readable Parquet files, and the files that were not read whole.

    The second table is (path, state, rows_read, rows_promised): ``unreadable`` for a
    file without a usable footer, ``partial`` for one whose pages gave fewer rows than
    its footer promises. Its count reads every column of the schema, as damage may lie
    in any of them.
    """
    scan = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    listed = spark.read.format("binaryFile").load(path).select("path")
    # A bare count would be answered from the footers. Maps cannot be hashed.
    columns = [F.to_json(F.struct(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name) for f in scan.schema]
    read = scan.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("rows_read"), F.bit_xor(F.xxhash64(*columns)).alias("_all")
    )
    # The two scans spell local paths differently (file:/x, file:///x).
    plain = lambda df: df.withColumn("_key", F.regexp_replace("path", "^file:/+", "/"))
    # The hash is part of the result, so that the columns are really read.
    found = plain(read).where(F.col("_all").isNotNull()).select("_key", "rows_read")
    counted = plain(listed).join(found, "_key", "left").select("path", F.coalesce("rows_read", F.lit(0)).alias("rows_read"))
    promised = counted.mapInPandas(_file_rows, "path string, rows_read long, rows_promised long")
    state = F.when(F.col("rows_promised") < 0, "unreadable").when(F.col("rows_read") < F.col("rows_promised"), "partial")
    return scan, promised.select("path", state.alias("state"), "rows_read", "rows_promised").where(F.col("state").isNotNull())


def read_tsv_years(
    spark: SparkSession, template: str, years: Iterable[int], schema: StructType | str,
    malformed: str | None = None,
) -> tuple[DataFrame, list[int]]:
    """Union of per-year tab-separated files, and the years without a file.

    Columns are found by the names in each file's header, in any order; one the header
    lacks is null. Quoted texts may hold line breaks, tabs and doubled quotes. A value
    that does not fit its type is null; with ``malformed``, a column of that name says
    how many such values a row has.
    """
    parts, missing = [], []
    wanted = spark.createDataFrame([], schema).schema
    for year in years:
        try:
            raw = spark.read.csv(
                template.format(year=year), sep="\t", header=True, multiLine=True, quote='"', escape='"'
            )
            texts = {c.strip(): F.col(f"`{c}`") for c in raw.columns}
            cells = [(f, texts.get(f.name, F.lit(None).cast("string"))) for f in wanted]
            bad = [(text.isNotNull() & text.try_cast(f.dataType).isNull()).cast("int") for f, text in cells]
            part = raw.select(
                *[text.try_cast(f.dataType).alias(f.name) for f, text in cells],
                *([sum(bad[1:], bad[0]).alias(malformed)] if malformed else []),
            )
            parts.append(part.withColumn("source_year", F.lit(year)))
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            missing.append(year)
    if not parts:
        empty = spark.createDataFrame([], schema)
        if malformed:
            empty = empty.withColumn(malformed, F.lit(None).cast("int"))
        return empty.withColumn("source_year", F.lit(None).cast("int")), missing
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return table, missing


def read_questions(
    spark: SparkSession, paths: str | list[str], schema: StructType | str = schemas.QUESTIONS
) -> DataFrame:
    """Union of question files; the level is taken from each file's name.

    Both ``questions_<level>.csv`` files and Spark's folders of that name work.
    """
    table = spark.read.csv(
        paths, header=True, schema=schema, multiLine=True, quote='"', escape='"'
    )
    level = F.regexp_extract(
        F.col("_metadata.file_path"), r"questions_([^/]*)\.csv(?:/[^/]*)?$", 1
    )
    return table.withColumn("level", level)
