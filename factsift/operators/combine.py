"""Combining result batches (U1, O2, A9) and strategy comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsift.operators.batches import assign_sequence


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns missing from a frame become NULL."""
    if not frames:
        raise ValueError("nothing to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def batch_order(df: DataFrame, batch: str | list[str] = "batch_id", seq: str | None = "seq") -> DataFrame:
    """O2: batches in numeric order (rows inside a batch by ``seq`` when present)."""
    keys = ([batch] if isinstance(batch, str) else list(batch)) + ([seq] if seq and seq in df.columns else [])
    return df.orderBy(*keys)


def batch_position(df: DataFrame, batch: str = "batch_id", seq: str = "seq", name: str = "position") -> DataFrame:
    """O2 as a column: each row's dense place in batch order, by ``seq`` inside a batch.

    Only the distinct ``(batch, seq)`` keys are sorted and numbered, over all tasks."""
    return assign_sequence(df, [batch, seq], name)


def total_rows(df: DataFrame) -> DataFrame:
    """The record count of the combined table, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def compare_strategies(reports: DataFrame, metric: str = "f1",
                       strategies: Sequence[str] | None = None) -> DataFrame:
    """One row per ``(dataset, label)``, one column per strategy.

    ``reports`` has ``dataset, strategy, label, <metric>``; strategies are
    listed explicitly so the pivot needs no extra distinct pass.
    """
    strategies = list(strategies) if strategies else ["eep", "cot", "selfask"]
    return (reports.groupBy("dataset", "label").pivot("strategy", strategies)
            .agg(F.first(F.col(metric))))
