"""The seven run presets and the scored-run plan (Q4).

A preset fixes: dataset family and input format, sampling, batch size,
label-extraction policy, result columns and the report policy. ``scored_run``
assembles W2 -> J4 -> J6/X4 -> D1 -> X5-X8 -> P4 -> K1 (+ A11) and returns the
stored result table read back from storage, so reports never re-run the
scorer (results are keyed by ``(strategy, claim_id)``; ``batch_id`` is kept
as a column for the per-batch export).

Reference quirks fixed here on purpose: resume is by row key rather than by
file-number prefix (a half-written batch is completed, a changed batch size
is harmless, a rerun appends nothing), and the report covers the stored table
rather than only the rows of the current session.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.functions.labels import extract_label
from factsift.functions.text import py_strip
from factsift.functions.prompts import render, templates_frame
from factsift.operators import batches as B
from factsift.operators import metrics as M
from factsift.operators import sampling as S
from factsift.operators.scoring import SCORED, Calls, LexicalVerifier, observe_counters, store_scored
from factsift.session import path_exists
from factsift.sources import files
from factsift.sources import results as R


@dataclass(frozen=True)
class Preset:
    name: str
    dataset: str                  # "fever" | "pubhealth"
    strategy: str                 # "eep" | "cot" | "selfask"
    source: str                   # "jsonl" | "tsv"
    sampling: str | None          # None | "cap" | "strict"
    per_class: int | None
    batch_size: int
    label_policy: str             # "raw" | "lenient" | "strict"
    raw_output_column: bool
    report_policy: str            # "all" | "fixed" | "valid_only"
    seed: int = 42

    @property
    def labels(self) -> list[str]:
        return K.FEVER_LABELS if self.dataset == "fever" else K.PUBHEALTH_LABELS


# ---- fixed values: the run presets (batch sizes, sample sizes, seed) -------
PRESETS: dict[str, Preset] = {p.name: p for p in [
    Preset("fever_eep_full", "fever", "eep", "jsonl", None, None, 300, "raw", False, "all"),
    Preset("fever_eep_sampled", "fever", "eep", "jsonl", "cap", 666, 5, "raw", False, "all"),
    Preset("fever_cot", "fever", "cot", "jsonl", "strict", 666, 500, "lenient", True, "fixed"),
    Preset("fever_selfask", "fever", "selfask", "jsonl", "cap", 666, 300, "strict", False, "valid_only"),
    Preset("pubhealth_eep", "pubhealth", "eep", "tsv", None, None, 100, "raw", False, "all"),
    Preset("pubhealth_cot", "pubhealth", "cot", "tsv", None, None, 100, "raw", False, "all"),
    Preset("pubhealth_selfask", "pubhealth", "selfask", "tsv", None, None, 500, "raw", False, "all"),
]}


def working_set(claims: DataFrame, preset: Preset, order: str = "claim_id") -> DataFrame:
    """Sampling (W1/O1) if the preset asks for it, then ``seq`` + ``batch_id``.

    ``claims``: ``claim_id, claim, evidence, label``. Without sampling the
    dataset order is ``order``; with sampling it is the seeded shuffle.
    """
    if preset.sampling:
        sampled = S.stratified(claims, preset.per_class, preset.seed, "claim_id", "label",
                               preset.sampling, preset.labels if preset.sampling == "strict" else None)
        ordered = sampled.withColumn("_order", S.shuffle_key(preset.seed, "claim_id"))
        seqd = B.assign_sequence(ordered, ["_order", "claim_id"])
    else:
        seqd = B.assign_sequence(claims, [order])
    return B.assign_batches(seqd, preset.batch_size)


def result_rows(scored: DataFrame, preset: Preset) -> DataFrame:
    """X5-X8 + P4: the result-row projection with the run keys kept."""
    pred = extract_label(F.col("raw"), F.col("error"), preset.label_policy, preset.labels)
    cols = [F.col("strategy"), F.col("claim_id"), F.col("seq"), F.col("batch_id"),
            F.col("claim").alias("Claim"), F.col("evidence").alias("Evidence"),
            F.col("label").alias("True_Label"), pred.alias("Predicted_Label")]
    if preset.raw_output_column:
        cols.append(F.coalesce(F.lower(py_strip(F.col("raw"))), F.col("error")).alias(K.RAW_OUTPUT_COLUMN))
    return scored.select(*cols)


def _open_folder(out_dir: str, preset: Preset) -> str:
    """Where finished batches lie until they join the result table (hidden from its readers)."""
    return f"{out_dir}/_open/{preset.strategy}"


def collect_open(spark: SparkSession, preset: Preset, out_dir: str) -> dict:
    """K1: append all batches that tasks have finished to the result table.

    One atomic append of result rows (X5-X8, P4) in files of the usual size;
    rows that the table has already (of a session that died between the append
    and the deletion) are left out. Returns the A11 counters of the append.
    """
    folder = _open_folder(out_dir, preset)
    if not path_exists(spark, folder):
        return {}
    scored = spark.read.schema(SCORED).option("recursiveFileLookup", "true").parquet(folder)
    paths = files.input_paths(scored)
    if not paths:
        return {}
    rows = result_rows(spark.read.schema(SCORED).parquet(*paths), preset)
    done = stored_keys(spark, preset, out_dir)
    if done is not None:
        rows = B.pending(rows, done, "claim_id")
    rows, obs = observe_counters(rows)
    rows.sortWithinPartitions("batch_id", "seq").write.mode("append").parquet(out_dir)
    files.delete_files(spark, paths)
    return obs.get


def stored_keys(spark: SparkSession, preset: Preset, out_dir: str) -> DataFrame | None:
    """Keys of this strategy's rows in the result table; None without a table."""
    if not path_exists(spark, out_dir):
        return None
    # explicit schema: a table without data files reads as empty
    return (spark.read.schema("strategy string, claim_id long").parquet(out_dir)
            .where(F.col("strategy") == preset.strategy).select("claim_id"))


def scored_run(spark: SparkSession, claims: DataFrame, preset: Preset, out_dir: str,
               scorer_factory=None, parallelism: int | None = None,
               calls: Calls = Calls()) -> tuple[DataFrame, dict]:
    """Q4: score every row not yet stored under ``out_dir``; return the stored table.

    Every batch is stored when its last call ends (``operators.scoring.store_scored``)
    and joins the result table with the other finished ones when the run ends,
    well or not, or when the next one begins: a run that dies keeps all batches
    it has finished, and the next one scores only the rest. ``parallelism`` is
    the number of calls in flight over all tasks. Returns ``(results, counters)``;
    the counters are the A11 observations of what this session stored.
    """
    factory = scorer_factory or (lambda: LexicalVerifier(preset.dataset))
    collect_open(spark, preset, out_dir)                # of a session that was cut off
    work = working_set(claims, preset)
    done = stored_keys(spark, preset, out_dir)
    todo = work if done is None else B.pending(work, done, "claim_id")
    templates = templates_frame(spark)                  # one row for the strategy: each row stays in place

    def prompts(rows: DataFrame) -> DataFrame:
        return render(rows, templates, preset.dataset, [preset.strategy])

    counters: Counter = Counter(rows=0, errors=0)
    try:
        store_scored(todo, factory, f"{_open_folder(out_dir, preset)}/{uuid.uuid4().hex}", parallelism, calls, prompts)
    finally:
        counters.update({k: v or 0 for k, v in collect_open(spark, preset, out_dir).items()})
    if not counters["rows"] and stored_keys(spark, preset, out_dir) is None:  # nothing to do still makes the table
        result_rows(spark.createDataFrame([], SCORED), preset).write.mode("append").parquet(out_dir)
    return R.read_batches(spark, out_dir).where(F.col("strategy") == preset.strategy), counters


def run_report(results: DataFrame, preset: Preset) -> DataFrame:
    """The preset's report over the stored results (P6 + Q6/Q7/Q8)."""
    tp = M.normalise_labels(results, "True_Label", "Predicted_Label")
    labels = None if preset.report_policy == "all" else preset.labels
    return M.report(tp, preset.report_policy, labels)
