"""Files that tasks write themselves, on any store that Spark and Arrow both know.

A file is written under a hidden name and moved to its own when it is whole, so
a reader never sees half a file and a lost executor leaves at most a hidden one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as tasks on other machines need it."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = fs.makeQualified(jpath).toString()
    return "file://" + full[len("file:"):] if full.startswith("file:/") and not full.startswith("file://") else full


def input_paths(df: DataFrame) -> list[str]:
    """The files a frame reads, sorted, as paths that can be read again."""
    return sorted(unquote(path) for path in df.inputFiles())


def exists(uri: str) -> bool:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def write_whole(uri: str, write: Callable) -> None:
    """``write(stream)`` into a hidden file, then move it to ``uri``. A file that
    another attempt has put there meanwhile is as good and stays."""
    fs, path = pafs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden, compression=None) as stream:
        write(stream)
    try:
        fs.move(hidden, path)
    except OSError:
        if not exists(uri):
            raise
        fs.delete_file(hidden)


def delete_files(spark: SparkSession, paths: list[str]) -> None:
    """Delete the named files (no folders)."""
    for path in paths:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, False)
