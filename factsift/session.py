"""Spark session defaults and the shared scratch folder.

Everything that must outlive a task (checkpoints, intermediate JSONL/TSV/CSV
files, result tables) goes under the folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is absent (unit tests, a
laptop) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings this engine relies on. AQE gives runtime broadcast of small
# join sides (a measured size bound), partition coalescing and skew-join
# splitting of hot keys; all of them are plain Spark features.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    # PySpark 4 records the Python call site of every column expression for
    # error messages; that costs several driver round trips per expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "factsift",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # Unset on a single machine: a test or a laptop.
        configured = tempfile.mkdtemp(prefix="factsift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A folder under the shared checkpoint root for intermediate tables."""
    root = checkpoint_root(spark)
    leaf = f"{name}-{uuid.uuid4().hex[:12]}" if unique else name
    path = os.path.join(root, "factsift", leaf) if "://" not in root else f"{root}/factsift/{leaf}"
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its (possibly remote) file system."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``factsift`` importable by Python workers (once per SparkContext).

    Equivalent to ``--py-files``: the package is zipped in memory, written to
    the shared folder through the Hadoop file system API (so it also works
    for remote folders) and added with ``addPyFile``. Clusters that install
    the package on executors are unaffected.
    """
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import io
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = shared_dir(spark, "pyfiles") + "/factsift.zip"
    jvm = sc._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(target)
    fs = jpath.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(id(sc))
