"""Cleaning a corpus: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor
kept; ``run`` writes each stage's result as Parquet to the shared folder and
reads it again as the next stage's documents. All stages but the last return
the columns of ``documents``; the last returns the packed pieces.

Null or empty texts pass every filter (they hold nothing to reject) and pack as
one end id; rows without a doc_id are kept like others. An empty table gives an
empty result. Extra columns travel along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factsift.llm import common, minhash_paths, packing, pii_feistel, suffix_decontam, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score as toxic go."""
    return toxicity.reject(docs, toxicity.learn(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near duplicates (similarity 0.8 or more) stays."""
    return minhash_paths.deduplicate(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with benchmark passages go."""
    return suffix_decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data become pseudonyms."""
    return pii_feistel.pseudonymise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token sequences of at most 1024 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Learned scores, components and tokenizers are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
