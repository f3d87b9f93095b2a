"""Binary files in the shared folder, written and read inside tasks.

A task writes under a name of its own and reports it with its result rows. Only the
names in a stored result count, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def new_name(folder: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def task_each(listed: DataFrame, most: int = 20_000) -> DataFrame:
    """``listed`` (a stored list of files) with about one row per task.

    The rows are small, but each stands for a file: left to themselves they would be
    read by a few tasks.
    """
    return listed.repartition(min(most, max(1, listed.count())))


def create(uri: str) -> pa.NativeFile:
    """A new file for writing; its folder is made if needed."""
    system, path = _place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_stream(uri: str) -> pa.NativeFile:
    """A file for reading from its start."""
    system, path = _place(uri)
    return system.open_input_stream(path, compression=None)


def open_random(uri: str) -> pa.NativeFile:
    """A file for reading at any place."""
    system, path = _place(uri)
    return system.open_input_file(path)
