"""Result tables: batched sink (K1), combined sink (K2), report sink (K3) and
the result-folder scans (S4, S5).

Scored-run state lives in an append-only Parquet table with ``batch_id`` as
a column (see ``plans.presets.scored_run``). ``write_batches`` writes one
folder per batch, replacing only the batches it touches (dynamic partition
overwrite), for exports in the reference's one-file-per-batch spirit. CSV is
an export format: written and read with ``escape='"'``, no whitespace
trimming and ``\\N`` for NULL, so padded text, quotes, newlines, the empty
string and NULL all survive a round trip (Spark's CSV defaults trim text,
read ``""`` as NULL and backslash-escape quotes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.sources.delimited import read_delimited

CSV_OPTIONS = {
    "header": "true", "multiLine": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\\N", "encoding": "UTF-8",
}


def _csv_reader(spark: SparkSession):
    r = spark.read
    for k, v in CSV_OPTIONS.items():
        r = r.option(k, v)
    return r


def _csv_writer(df: DataFrame):
    w = df.write
    for k, v in CSV_OPTIONS.items():
        if k not in ("multiLine",):
            w = w.option(k, v)
    return w


def write_batches(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: one partition folder per ``batch_id``; touched batches overwritten."""
    df = df.repartitionByRange("batch_id").sortWithinPartitions("batch_id")  # one file a batch
    writer = df.write if fmt == "parquet" else _csv_writer(df)
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").format(fmt).save(path))


def read_batches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read back a K1 table (Parquet state, or the per-batch CSV export whose
    ``batch_id`` comes from partition discovery)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.withColumn("batch_id", F.col("batch_id").cast("long"))
    # Column names from the header, every value a string (no type inference);
    # only the partition column is typed.
    df = _csv_reader(spark).option("inferSchema", "false").csv(path)
    return df.withColumn("batch_id", F.col("batch_id").cast("long"))


def read_result_folder(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """S4 for reference-style folders of ``*_result_<k>.csv`` files.

    Only files named ``..._result_<k>.csv`` are read; a combined file or any
    other in the same folder is left out. Each file's columns are taken by the
    names in its own header, in any order and of any number; every column is a
    string (no type inference), a column that a file lacks reads as NULL, others
    are ignored. ``batch_id`` is parsed from the file name. Large files are split.
    With ``position`` a column ``seq`` follows file names and rows in them.
    """
    rows = read_delimited(spark, path, [*K.RESULT_COLUMNS, K.RAW_OUTPUT_COLUMN], sep=",", glob=K.RESULT_FILE_GLOB,
                          null=CSV_OPTIONS["nullValue"])
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    return (rows.withColumn("file_name", name)
            .withColumn("batch_id", F.regexp_extract("file_name", K.RESULT_FILE_NUMBER, 1).try_cast("long"))
            .where(F.col("batch_id").isNotNull())
            .select(*K.RESULT_COLUMNS, K.RAW_OUTPUT_COLUMN, "batch_id", "file_name", *(["seq"] if position else [])))


def write_combined(df: DataFrame, path: str) -> None:
    """K2: the combined table as header CSV (a folder of part files; no BOM)."""
    _csv_writer(df).mode("overwrite").csv(path)


def read_combined(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read the combined table back with all-string columns."""
    r = _csv_reader(spark)
    if schema:
        r = r.schema(schema)
    return r.csv(path)


def write_report(report: DataFrame, lines: DataFrame, path: str) -> None:
    """K3: the metrics table as Parquet and the formatted text next to it."""
    report.write.mode("overwrite").parquet(f"{path}/metrics")
    lines.orderBy("ord").select("line").write.mode("overwrite").text(f"{path}/text")
