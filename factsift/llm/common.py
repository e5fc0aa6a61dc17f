"""Table access, shared intermediate tables and remote file handles."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from factsift.session import shared_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; extra columns are left in and ignored by the operators."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage;
    an executor that is lost afterwards costs nothing)."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Delete the folders of tables that ``store`` made and nothing reads again."""
    for df in stored:
        jvm, hadoop = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)


@contextlib.contextmanager
def shuffles_released(spark: SparkSession):
    """Each action's shuffle files go when it ends, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared store as a URI that Python tasks can open."""
    path = shared_dir(spark, name)
    if path.startswith("file:"):
        path = path[len("file:"):]
    if "://" not in path:
        path = "file:///" + path.lstrip("/")
    return path


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) and the path on it."""
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, blocks) -> int:
    """Write byte blocks to ``uri``; returns the file's size.

    Task attempts use different names (see callers), and only names a finished
    attempt reports are read, so a lost executor leaves at most an orphan file.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    size = 0
    with fs.open_output_stream(path, compression=None) as out:
        for block in blocks:
            out.write(block)
            size += len(block)
    return size


def prepare(spark: SparkSession) -> None:
    """Make the package importable by Python workers."""
    ship_package(spark)


def released(run):
    """``run`` for ``mapInArrow``, giving memory back to the system when a task ends:
    workers outlive tasks, and an executor's memory is shared with the next ones."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)
    return task


def seed64(*parts) -> int:
    """A fixed 64-bit number from a label, the same on every machine."""
    return int.from_bytes(hashlib.blake2b("/".join(map(str, parts)).encode(), digest_size=8).digest(), "little")
