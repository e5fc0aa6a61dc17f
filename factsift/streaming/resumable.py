"""Resumable scoring as a Structured Streaming query.

New claim files dropped into ``input_dir`` are picked up incrementally:

``readStream.json(input_dir)`` -> ``foreachBatch`` -> evidence resolution
against the static page store -> scorer -> label extraction -> append to the
result table.

Exactly-once per claim across restarts comes from two mechanisms:

* the streaming checkpoint records which input files each epoch consumed,
  so a restart continues with the files not yet processed;
* each epoch anti-joins its claims against the keys already stored in its
  own ``epoch=<id>`` partition before appending, so replaying an epoch after
  a crash between write and commit appends nothing twice.

``trigger(availableNow=True)`` processes everything present and stops, which
is how the batch presets' "skip finished work" behaviour is reproduced. A
micro-batch is bounded by bytes, not by files, so the page store is read once
for each ``max_bytes`` of claims, however many files they come in.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.functions.labels import extract_label
from factsift.functions.prompts import render, templates_frame
from factsift.operators import batches as B
from factsift.operators.evidence import ROW_HASH, resolve_evidence, row_hash
from factsift.operators.scoring import LexicalVerifier, observe_counters, score
from factsift.session import path_exists
from factsift.sources.claims import JSONL_SCHEMA


MAX_BYTES = 1 << 30  # of claim files in a micro-batch (a larger file is one of its own)


def claims_stream(spark: SparkSession, input_dir: str, max_files_per_trigger: int | None = None,
                  max_bytes: int = MAX_BYTES) -> DataFrame:
    """S1 as a stream (P1 applied); a row is known by the hash of its content.
    Micro-batches hold ``max_bytes`` of files, or a number of files if that is given."""
    bound = ("maxBytesPerTrigger", max_bytes) if max_files_per_trigger is None else ("maxFilesPerTrigger", max_files_per_trigger)
    raw = (spark.readStream.schema(JSONL_SCHEMA)
           .option(*bound)
           .option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record")
           .json(input_dir))
    reason = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed json"))
              .when(F.col("claim").isNull(), F.lit("missing claim")))
    return raw.select(row_hash(raw).alias(ROW_HASH), F.col("id").try_cast("long").alias("claim_id"), "claim",
                      F.upper(F.coalesce(F.col("label"), F.lit(K.DEFAULT_JSONL_LABEL))).alias("label"),
                      "evidence", reason.alias("reject_reason"), F.col("_corrupt_record").alias("line"))


def _epoch_writer(pages: DataFrame, output_dir: str, dataset: str, strategy: str,
                  label_policy: str, scorer_factory, counters: Counter | None = None):
    counters = Counter() if counters is None else counters

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        rejects = batch.where(F.col("reject_reason").isNotNull()).select(ROW_HASH, "claim_id", "reject_reason", "line")
        # the epoch's own folder is replaced, so a replay writes the same again
        rejected = Observation()
        (rejects.observe(rejected, F.count(F.lit(1)).alias("rejects"))
         .write.mode("overwrite").parquet(f"{output_dir}-rejects/epoch={epoch_id}"))
        todo = batch.where(F.col("reject_reason").isNull())
        if path_exists(spark, output_dir):
            # A replayed epoch can only have written into its own partition, so
            # the check reads that partition alone (partition pruning), not the
            # whole, ever-growing result table.
            done = spark.read.parquet(output_dir).where(F.col("epoch") == epoch_id)
            todo = B.pending(todo, done, ROW_HASH)
        resolved = resolve_evidence(todo, pages, keep=["claim_id", "claim", "label"], key=ROW_HASH)
        prompts = render(resolved, templates_frame(spark), dataset, [strategy])
        scored = score(prompts, scorer_factory, keep=["strategy", ROW_HASH, "claim_id", "claim", "evidence", "label"])
        rows = scored.select(
            F.col("strategy"), F.col(ROW_HASH), F.col("claim_id"), F.lit(epoch_id).cast("long").alias("epoch"),
            F.col("claim").alias("Claim"), F.col("evidence").alias("Evidence"),
            F.col("label").alias("True_Label"),
            extract_label(F.col("raw"), F.col("error"), label_policy).alias("Predicted_Label"))
        stored, seen = observe_counters(rows)
        stored.write.mode("append").partitionBy("epoch").parquet(output_dir)
        counters.update({"epochs": 1, **{k: v or 0 for k, v in {**seen.get, **rejected.get}.items()}})
    return write


def stream_score(spark: SparkSession, input_dir: str, pages: DataFrame, output_dir: str,
                 checkpoint_dir: str, dataset: str = "fever", strategy: str = "eep",
                 label_policy: str = "raw", scorer_factory=None,
                 max_files_per_trigger: int | None = None, max_bytes: int = MAX_BYTES) -> Counter:
    """Run the stream until the files present now are all processed; returns what
    it did (A11): micro-batches, stored rows, errors and rejects."""
    factory = scorer_factory or (lambda: LexicalVerifier(dataset))
    counters: Counter = Counter(epochs=0, rows=0, errors=0, rejects=0)
    q = (claims_stream(spark, input_dir, max_files_per_trigger, max_bytes).writeStream
         .foreachBatch(_epoch_writer(pages, output_dir, dataset, strategy, label_policy, factory, counters))
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return counters
