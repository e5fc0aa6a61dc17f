"""Page store source (S3): ``(id, lines)`` from any table or file format.

At scale the page store is the largest input (every page's full text), while
evidence resolution needs only the cited pages. Two things keep it cheap:

* reads are column-pruned to ``id`` and ``lines``, and the existence check
  reads ``id`` alone;
* ``write_page_store(..., buckets=N)`` stores it once bucketed and sorted by
  ``id``. Joins on ``id`` then find the store already hash-partitioned, so
  only the (much smaller) cited-title side is shuffled; without bucketing,
  AQE broadcasts the title side when its measured size is small and
  otherwise both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_page_store(spark: SparkSession, source: str, fmt: str = "parquet", table: bool = False,
                    id_col: str = "id", lines_col: str = "lines") -> DataFrame:
    """A page store as ``(id, lines)``; ``table=True`` reads a catalog table."""
    df = spark.read.table(source) if table else spark.read.format(fmt).load(source)
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(lines_col).alias("lines"))


def write_page_store(df: DataFrame, path: str, table: str | None = None, buckets: int | None = None) -> None:
    """Persist ``(id, lines)``; with ``buckets`` as a bucketed catalog table at ``path``."""
    out = df.select("id", "lines")
    if buckets:
        if not table:
            raise ValueError("a bucketed page store needs a table name")
        (out.write.mode("overwrite").format("parquet").option("path", path)
         .bucketBy(buckets, "id").sortBy("id").saveAsTable(table))
    else:
        out.write.mode("overwrite").parquet(path)
