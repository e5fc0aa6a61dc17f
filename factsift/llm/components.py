"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsift.llm import common


def _stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is a ``u``: then all is done."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up")))
    uses = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return uses.where("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of ``edges(a, b)``: the smallest id it reaches.

    Each round hangs every node's larger neighbours, then its smaller ones,
    under the smallest; the rounds needed grow with the logarithm of the longest
    path. Joins and counts by node are ordinary shuffles: a hub is combined
    before the shuffle and its join can be split; nothing is gathered in a list.
    Each round is stored, so a lost executor costs one round. Self-loops and
    repeated edges are harmless; an empty table has no components.
    """
    pairs = (edges.where(F.col("a") != F.col("b"))
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = common.store(pairs, "edges")
    while not _stars(state):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        state = common.store(small, "edges")
    tops = state.select(F.col("v").alias("id")).distinct()
    return (state.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(tops.select("id", F.col("id").alias("component"))))


def connecting(linked: np.ndarray, rows: np.ndarray, n: int) -> list[tuple[int, int]]:
    """As few links as connect what all of ``linked`` connect: ``linked[i, j]``
    says whether ``rows[i]`` and ``j`` (of 0 .. n - 1) are linked."""
    label, out = np.arange(n), []
    for i, q in enumerate(rows.tolist()):
        v = np.flatnonzero(linked[i])
        if not len(v):
            continue
        labels, first = np.unique(label[v], return_index=True)
        for other, k in zip(labels.tolist(), first.tolist()):
            if other != label[q]:
                out.append((q, int(v[k])))
                label[label == other] = label[q]
    return out
