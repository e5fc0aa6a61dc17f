"""Row validation for TSV-family claims.

Every row gets a ``reject_reason`` (NULL when clean); the clean rows and the
reject log are two filters over the same frame, and the reject counts are one
``groupBy``. A job that needs both sides splits its input in one pass
(``split_once``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.session import shared_dir

REQUIRED = ("claim", "main_text", "label")


def present(c: str) -> Column:
    """not NULL and not empty; whitespace-only counts as present."""
    return F.coalesce(F.col(c) != "", F.lit(False))


def reject_reason(labels: Sequence[str] = K.PUBHEALTH_LABELS,
                  required: Sequence[str] = REQUIRED, label: str = "label") -> Column:
    """the missing-field test runs before the label test."""
    missing = ~_all(*[present(c) for c in required])
    upper = F.upper(F.col(label))
    return (F.when(missing, F.lit("missing fields"))
            .when(~upper.isin(list(labels)), F.concat(F.lit("invalid label: "), upper)))


def _all(*conds: Column) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def limit_raw_rows(df: DataFrame, n: int | None, seq: str = "seq") -> DataFrame:
    """the first ``n`` input rows by file order, before any filter."""
    return df if n is None else df.where(F.col(seq) < n)


def split_once(tagged: DataFrame, path: str | None = None, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """F4 in one pass: ``(clean, rejects)`` of rows tagged with a reject reason.

    The rows are written once, in a folder a side (``path``: a fresh folder in the
    shared store, unless given), and each side reads its own folder only: the
    input is scanned, parsed and numbered once, however often the sides are used.
    Both sides keep all columns but, on the clean side, the reason.
    """
    spark = tagged.sparkSession
    path = path or shared_dir(spark, "split")
    flagged = tagged.withColumn("_rejected", F.col(reason).isNotNull())
    flagged.write.mode("overwrite").partitionBy("_rejected").parquet(path)
    both = spark.read.schema(flagged.schema).parquet(path)
    return (both.where(~F.col("_rejected")).drop("_rejected", reason),
            both.where(F.col("_rejected")).drop("_rejected"))


def validate(df: DataFrame, labels: Sequence[str] = K.PUBHEALTH_LABELS,
             limit: int | None = None, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Return ``(clean, rejects)``; ``once`` for a job that uses both (``split_once``).

    ``clean``: ``seq, claim, evidence (= main_text), label`` with the label
    upper-cased (P1, no trimming, so ``' mixture'`` is out of domain);
    ``rejects``: ``seq, reject_reason``.
    """
    df = limit_raw_rows(df, limit)
    tagged = df.withColumn("reject_reason", reject_reason(labels))
    shaped = tagged.select("seq", "claim", F.col("main_text").alias("evidence"), F.upper(F.col("label")).alias("label"),
                           "reject_reason")
    if once:
        clean, rejects = split_once(shaped)
        return clean, rejects.select("seq", "reject_reason")
    clean = shaped.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return clean, shaped.where(F.col("reject_reason").isNotNull()).select("seq", "reject_reason")


def reject_counts(rejects: DataFrame) -> DataFrame:
    kind = F.when(F.col("reject_reason").startswith("invalid label"), F.lit("invalid label")) \
        .otherwise(F.col("reject_reason"))
    return rejects.groupBy(kind.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
