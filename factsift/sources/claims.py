"""Claim sources: JSONL (S1) and TSV (S2), plus their writers.

Spark has no implicit row order, yet raw-row limits (F7), batch numbers (W2)
and reject logs refer to file order. Readers therefore carry an explicit
``seq``, the row's place by file path and position. JSON lines are numbered per
file block as they are read (``operators.batches.number_file_rows``), TSV
records while their quoting is followed (``sources.delimited``); no row is
sorted or stored for it, and files of any size are read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.operators.batches import number_file_rows
from factsift.sources.delimited import read_delimited
from factsift.sources.files import input_paths

EVIDENCE_TYPE = "array<array<array<string>>>"
JSONL_SCHEMA = (f"id string, claim string, label string, evidence {EVIDENCE_TYPE}, "
                "_corrupt_record string")
# evidence with the JSON type of each value
TYPED_SCHEMA = JSONL_SCHEMA.replace(EVIDENCE_TYPE, "variant")
_JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
INDEX_AT = 3  # fixed value: the sentence index's place in a reference


def typed_evidence(evidence: Column) -> Column:
    """a variant as evidence groups whose index is null unless it is a JSON
    integer: ``0`` stays, ``"0"``, ``0.0``, ``true`` and ``null`` don't (nor does an
    integer beyond 64 bits). What isn't a list of lists of lists is null there."""
    def value(x: Column, i: Column) -> Column:
        return F.when((i != INDEX_AT) | (F.schema_of_variant(x) == "BIGINT"), F.try_variant_get(x, "$", "string"))

    def ref(r: Column) -> Column:
        return F.transform(F.try_variant_get(r, "$", "array<variant>"), value)

    return F.transform(F.try_variant_get(evidence, "$", "array<array<variant>>"), lambda g: F.transform(g, ref))


def _leading_lines(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    """Non-blank lines below ``path``; with ``limit`` of as many leading files (in
    doubling numbers) as hold that many."""
    def lines(of):
        return spark.read.text(of).where(F.col("value").rlike(r"[^ \t\r\n]"))

    found, taken = lines(path), 1
    if limit is None:
        return found
    paths = input_paths(found)
    while taken < len(paths) and lines(paths[:taken]).limit(limit).count() < limit:
        taken *= 2
    return lines(paths[:taken]) if paths else found


def read_claims_jsonl(spark: SparkSession, path: str, with_seq: bool = True, strict: bool = True,
                      limit: int | None = None) -> DataFrame:
    """S1 + P1: ``seq, claim_id, claim, label, evidence, reject_reason``.

    Blank lines are skipped; malformed lines and lines without ``claim`` are
    kept with a ``reject_reason`` instead of aborting the load (see
    ``split_rejects``). A missing or NULL ``label`` defaults to
    ``NOT ENOUGH INFO``; labels are upper-cased without trimming. Mixed-type
    reference arrays such as ``[10, 20, "T", 3]`` read as strings. ``strict``
    (F1) keeps a sentence index only if it is a JSON integer, see
    ``typed_evidence``; without it a quoted one counts too. ``limit`` (F7, with
    ``with_seq``) reads the first lines only.
    """
    schema = TYPED_SCHEMA if strict else JSONL_SCHEMA
    if with_seq:
        numbered = number_file_rows(_leading_lines(spark, path, limit))
        if limit is not None:
            numbered = numbered.where(F.col("seq") < limit)
        df = numbered.select("seq", F.from_json("value", schema, _JSON_OPTIONS).alias("r")).select("seq", "r.*")
    else:
        df = spark.read.schema(schema).options(**_JSON_OPTIONS).json(path)
    reason = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed json"))
              .when(F.col("claim").isNull(), F.lit("missing claim")))
    claim_id = F.coalesce(F.col("id").try_cast("long"), F.col("seq")) if with_seq else F.col("id").try_cast("long")
    evidence = typed_evidence(F.col("evidence")) if strict else F.col("evidence")
    cols = [claim_id.alias("claim_id"), F.col("claim"),
            F.upper(F.coalesce(F.col("label"), F.lit(K.DEFAULT_JSONL_LABEL))).alias("label"),
            evidence.alias("evidence"), reason.alias("reject_reason")]
    if with_seq:
        cols.insert(0, F.col("seq"))
    return df.select(*cols)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows and the reject log (``seq, reject_reason``) from one frame."""
    clean = df.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejects = df.where(F.col("reject_reason").isNotNull()).select("seq", "reject_reason")
    return clean, rejects


def _json_int_or_null(c: F.Column) -> F.Column:
    """Render a numeric string as a bare JSON number, anything else as a string."""
    is_int = c.rlike(r"^-?[0-9]+$")
    return (F.when(c.isNull(), F.lit("null"))
            .when(is_int, c)
            .otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")))


def claims_to_jsonl_lines(claims: DataFrame) -> DataFrame:
    """One JSON object per claim, FEVER style: reference positions 0, 1, 3 are
    written as JSON integers when they are integers, the title as a string."""
    def ref_json(r):
        parts = F.array(_json_int_or_null(F.get(r, 0)), _json_int_or_null(F.get(r, 1)),
                        F.when(F.get(r, 2).isNull(), F.lit("null"))
                        .otherwise(F.regexp_replace(F.to_json(F.array(F.get(r, 2))), r"^\[|\]$", "")),
                        _json_int_or_null(F.get(r, 3)))
        return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))

    def group_json(g):
        return F.concat(F.lit("["), F.array_join(F.transform(g, ref_json), ","), F.lit("]"))

    evidence = F.concat(F.lit("["), F.array_join(F.transform(F.col("evidence"), group_json), ","), F.lit("]"))
    head = F.to_json(F.struct(F.col("claim_id").alias("id"), F.col("claim").alias("claim")))
    body = F.concat(F.expr("substr(_head, 1, length(_head) - 1)"),
                    F.when(F.col("label").isNotNull(),
                           F.concat(F.lit(',"label":'), F.regexp_replace(F.to_json(F.array("label")), r"^\[|\]$", "")))
                    .otherwise(F.lit("")),
                    F.when(F.col("evidence").isNotNull(), F.concat(F.lit(',"evidence":'), evidence))
                    .otherwise(F.lit("")),
                    F.lit("}"))
    return claims.withColumn("_head", head).select(body.alias("value"))


def write_claims_jsonl(claims: DataFrame, path: str, order: str = "claim_id") -> None:
    """Write claims as JSON lines in ``order`` (range-partitioned, file order kept)."""
    (claims_to_jsonl_lines(claims.orderBy(order))
     .write.mode("overwrite").option("compression", "none").text(path))


TSV_COLUMNS = ("claim", "main_text", "label")


def read_claims_tsv(spark: SparkSession, path: str, with_seq: bool = True, limit: int | None = None) -> DataFrame:
    """Header TSV with quoted fields, embedded newlines and tabs.

    All fields are read as strings by header name, as Python's csv module reads
    them; short rows give NULL for missing fields, extra fields are ignored,
    blank lines yield no row. Output: ``seq, claim, main_text, label``. Files of
    any size are split (``sources.delimited``); ``limit`` (F7) reads the first
    records only.
    """
    df = read_delimited(spark, path, TSV_COLUMNS, sep="\t", limit=limit)
    return df.select("seq", *TSV_COLUMNS) if with_seq else df.select(*TSV_COLUMNS)


def write_claims_tsv(df: DataFrame, path: str, order: str | None = None) -> None:
    """Write ``claim, main_text, label`` as header TSV that ``read_claims_tsv`` and
    Python's csv module both parse back field for field."""
    out = df.orderBy(order) if order else df
    (out.write.mode("overwrite")
     .option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"')
     .option("quoteAll", "true").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false")
     .csv(path))
