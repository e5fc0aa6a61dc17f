"""Map the driver's tables onto the claim-verification shapes.

Every frame here is derived by Spark from whole tables: nothing is sampled,
capped or sliced. Variety (claims without evidence, unusable references,
missing pages, missing sentences, invalid labels) comes from attributes of the
rows themselves (``lang``, ``source``, ``n_chars``, the label flags), so the
mix of cases scales with the data.

* ``claims``     <- ``labels JOIN documents``: JSONL-family claims with a
                    FEVER-style ``evidence ARRAY<ARRAY<ARRAY<STRING>>>``.
* ``page_store`` <- ``documents``: ``(id, lines)`` with ``index\\tsentence`` lines.
* ``tsv_claims`` <- ``documents LEFT JOIN labels``: TSV-family claims with raw
                    (not yet validated) labels.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift import constants as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def first_line(text: F.Column) -> F.Column:
    return F.substring_index(text, "\n", 1)


def rest_lines(text: F.Column) -> F.Column:
    """Everything after the first newline; empty for one-line texts."""
    pos = F.instr(text, "\n")
    return F.when(pos > 0, F.expr("substr(text, instr(text, '\n') + 1)")).otherwise(F.lit(""))


def fever_label(quality: F.Column, toxic: F.Column) -> F.Column:
    return (F.when(toxic == 1, F.lit("REFUTES"))
            .when(quality == 1, F.lit("SUPPORTS"))
            .otherwise(F.lit(K.DEFAULT_JSONL_LABEL)))


def page_title(doc_id: F.Column) -> F.Column:
    return F.concat(F.lit("doc_"), doc_id.cast("string"))


def _evidence(doc_id, lang, source, n_chars, label) -> F.Column:
    """FEVER-style evidence: ``[annotation, evidence id, title, sentence index]``.

    * ``lang = 'de'``       -> no evidence field at all.
    * not-enough-info claim -> one group with a NULL index (no usable reference).
    * otherwise             -> a first group of three references and a second
      group that resolution must ignore:
        - pos 0: the claim's own page, line 0 (always present);
        - pos 1: page ``doc_id + n_chars`` line 1 (may be absent from the
          store), NULL title for ``source = 'src0'``;
        - pos 2: own page, line ``n_chars % 13`` (may be past the last line),
          written as ``'k.0'`` for ``lang = 'es'`` so it is not an integer.
    """
    sid = doc_id.cast("string")
    r0 = F.array(sid, F.lit("0"), page_title(doc_id), F.lit("0"))
    other = F.when(source == "src0", F.lit(None).cast("string")).otherwise(page_title(doc_id + n_chars))
    r1 = F.array(sid, F.lit("1"), other, F.lit("1"))
    k = (n_chars % 13).cast("string")
    r2 = F.array(sid, F.lit("2"), page_title(doc_id),
                 F.when(lang == "es", F.concat(k, F.lit(".0"))).otherwise(k))
    alt = F.array(sid, F.lit("3"), page_title(doc_id), F.lit("2"))
    nei = F.array(F.array(F.array(sid, F.lit(None).cast("string"), F.lit(None).cast("string"),
                                  F.lit(None).cast("string"))))
    return (F.when(lang == "de", F.lit(None).cast("array<array<array<string>>>"))
            .when(label == K.DEFAULT_JSONL_LABEL, nei)
            .otherwise(F.array(F.array(r0, r1, r2), F.array(alt))))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSONL-family claims: ``claim_id, claim, label, evidence``."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    j = labels.join(docs, "doc_id")
    label = fever_label(F.col("quality"), F.col("toxic"))
    return j.select(
        F.col("doc_id").alias("claim_id"),
        F.col("text").alias("claim"),
        label.alias("label"),
        _evidence(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("n_chars"), label).alias("evidence"),
        F.col("lang"), F.col("source"))


def page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page store ``(id, lines)``: each document line prefixed with its index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.array_join(
        F.transform(F.split(F.col("text"), "\n"),
                    lambda line, i: F.concat(i.cast("string"), F.lit("\t"), line)), "\n")
    return docs.select(page_title(F.col("doc_id")).alias("id"), lines.alias("lines"))


def pubhealth_raw_label(quality: F.Column, toxic: F.Column, lang: F.Column,
                        labelled: F.Column) -> F.Column:
    """Raw TSV label, before validation: missing, mixed case, or out of domain."""
    return (F.when(~labelled, F.lit(None).cast("string"))
            .when(lang == "es", F.lit("snopes"))
            .when((quality == 1) & (toxic == 0), F.lit("true"))
            .when((quality == 0) & (toxic == 1), F.lit("FALSE"))
            .when((quality == 1) & (toxic == 1), F.lit("mixture"))
            .otherwise(F.lit("unproven")))


def tsv_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TSV-family rows ``(doc_id, claim, main_text, label)`` in ``doc_id`` order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").withColumn("_l", F.lit(True))
    j = docs.join(labels, "doc_id", "left")
    label = pubhealth_raw_label(F.col("quality"), F.col("toxic"), F.col("lang"),
                                F.col("_l").isNotNull())
    return j.select("doc_id", first_line(F.col("text")).alias("claim"),
                    rest_lines(F.col("text")).alias("main_text"), label.alias("label"))
