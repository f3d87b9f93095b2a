"""Sinks; all of them write in parallel, one folder per result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagekit.scale import salt


def write_by_class(
    df: DataFrame, path: str, by: str = "cpc_class", marker: str = "is_cs", id_col: str = "patent_id"
) -> None:
    """Parquet split by marker and class.

    Rows of one class are gathered into a few files; the salt keeps a class
    that holds most of the table from landing in one writer.
    """
    salted = df.repartition(F.col(by), salt([id_col], 8))
    salted.write.partitionBy(marker, by).parquet(path)


def write_results(df: DataFrame, path: str, fmt: str = "json", compression: str | None = None) -> None:
    """JSON lines or CSV with header, as plain text unless ``compression`` names a codec.

    Readers tell the codec by the file name.
    """
    if fmt == "json":
        df.write.json(path, ignoreNullFields=False, compression=compression)
    elif fmt == "csv":
        df.write.csv(path, header=True, quote='"', escape='"', compression=compression)
    else:
        raise ValueError(f"unknown result format: {fmt}")
