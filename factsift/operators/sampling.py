"""Exact, repeatable class-balanced sampling and seeded shuffle.

Draws are keyed by ``md5(seed || ':' || key)`` with the key as tie-break, so
they do not depend on partitioning, task retries or executor loss (``rand``
would). See ``stratified`` for how a class holding a third of all rows is
sampled without ranking the class in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factsift.session import checkpoint_root


def draw_key(seed: int | str, key: str, sep: str = ":") -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}{sep}"), F.col(key).cast("string")))


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """A2: rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def class_guard(df: DataFrame, labels: Sequence[str], n: int, label: str = "label") -> DataFrame:
    """A10: one row per required class with its size and whether it has ``n`` rows."""
    req = df.sparkSession.createDataFrame([(lab, i) for i, lab in enumerate(labels)],
                                          f"{label} string, ord int")
    sizes = class_sizes(df, label)
    return (F.broadcast(req).join(sizes, label, "left").na.fill(0, ["n_rows"])
            .select(label, "ord", F.col("n_rows").cast("long").alias("n_rows"),
                    (F.col("n_rows") >= n).alias("enough")))


def check_class_sizes(df: DataFrame, labels: Sequence[str], n: int, label: str = "label") -> None:
    """A10 (strict mode): raise before any work if a class is short of ``n``."""
    short = class_guard(df, labels, n, label).where(~F.col("enough")).collect()  # <= len(labels) rows
    if short:
        detail = ", ".join(f"{r[label]!r}: only {r['n_rows']}" for r in short)
        raise ValueError(f"Not enough samples for {detail} (need {n})")


# Exact top-n by hash without ranking whole classes. The draw order is
# md5(seed:key); its first 15 hex digits are a uniform integer in [0, 16^15)
# that preserves the order of the full digest (ties beyond 60 bits are
# broken by the full digest and the key in the final ranking).
_U_RANGE = 16 ** 15


def uniform_draw(seed: int | str, key: str) -> F.Column:
    return F.conv(F.substring(draw_key(seed, key), 1, 15), 16, 10).cast("long")


def _threshold(size: F.Column, n: int) -> F.Column:
    """Bound on the uniform draw that ~n + 10*sqrt(n) + 10 of ``size`` rows stay under."""
    want = n + 10 * math.sqrt(n) + 10
    return F.when(size <= want, F.lit(_U_RANGE)).otherwise(F.floor(F.lit(_U_RANGE * want) / size) + 1).cast("long")


def _take_least(kept: DataFrame, n: int, seed, key: str, label: str) -> DataFrame:
    """The ``n`` rows of least draw of each label; ``_t`` bounds a label's draws.

    Draws are uniform, so ``_t`` is cut into about sqrt(n) equal slices of about
    sqrt(n) candidates: slices are counted, their running sums say which are
    taken whole and which one holds the n-th draw, and only that slice is ranked.
    No task ranks more than one slice of a label, or sums more than its slices.
    """
    slices = math.isqrt(max(n, 1) - 1) + 1
    width = F.floor(F.col("_t") / F.lit(slices)) + 1
    placed = kept.withColumn("_slice", F.floor(uniform_draw(seed, key) / width).cast("long"))
    counts = placed.groupBy(F.col(label).alias("_l"), F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("_before", before).where(F.col("_before") < n)
    rows = placed.join(ends, F.col(label).eqNullSafe(F.col("_l")) & F.col("_slice").eqNullSafe(F.col("_s")))
    columns = [c for c in kept.columns if c != "_t"]
    whole = rows.where(F.col("_before") + F.col("_n") <= n).select(*columns)
    least = Window.partitionBy(label).orderBy(draw_key(seed, key), F.col(key))
    cut = (rows.where(F.col("_before") + F.col("_n") > n).withColumn("_rn", F.row_number().over(least))
           .where(F.col("_rn") <= F.lit(n) - F.col("_before")).select(*columns))
    return whole.unionByName(cut)


def stratified(df: DataFrame, n: int | None, seed: int = 42, key: str = "claim_id",
               label: str = "label", mode: str = "cap",
               labels: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows per class without replacement, exact and repeatable.

    ``cap``: ``min(size, n)`` for every label present (``n=None``: no cap).
    ``strict``: only ``labels``, each must hold ``n`` rows (A10) else raise.

    Plan: class sizes (one aggregate) -> per-label threshold on the uniform
    draw, joined back by label (NULL is a label too) -> a filter keeps about
    ``n + 10*sqrt(n)`` rows per label -> the n-th draw by counted slices of the
    draw's range (``_take_least``), so neither a label holding a third of all
    rows nor a large ``n`` reaches a single task. Should fewer than
    ``min(size, n)`` rows of a label stay under its threshold (odds below 1e-20,
    or rows whose ``key`` is null), all its rows are candidates, so the result is
    exact. Rows that share a key share their draw.
    """
    if mode not in ("cap", "strict"):
        raise ValueError("mode must be 'cap' or 'strict'")
    if mode == "strict":
        if labels is None or n is None:
            raise ValueError("strict mode needs labels and n")
        df = df.where(F.col(label).isin(list(labels)))
        check_class_sizes(df, labels, n, label)
    if n is None:
        return df
    u = uniform_draw(seed, key)
    sizes = class_sizes(df, label).select(F.col(label).alias("_label"), _threshold(F.col("n_rows"), n).alias("_t"),
                                          F.least(F.col("n_rows"), F.lit(n)).alias("_need"))
    # one row a label goes to every task: rows shuffled by label would lie in as few tasks as labels
    drawn = df.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label")))
    checkpoint_root(df.sparkSession)
    kept = drawn.where(u < F.col("_t")).select(*df.columns, "_t").checkpoint(eager=True)
    # one row per label: those whose threshold turned out too low
    got = kept.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_got"))
    short = (sizes.join(got, F.col("_label").eqNullSafe(F.col("_l")), "left")
             .where(F.coalesce("_got", F.lit(0)) < F.col("_need")).select("_label"))
    if not short.isEmpty():
        of_short = F.col(label).eqNullSafe(F.col("_label"))
        whole = df.join(short, of_short, "left_semi").withColumn("_t", F.lit(_U_RANGE).cast("long"))
        kept = kept.join(short, of_short, "left_anti").unionByName(whole)
    return _take_least(kept, n, seed, key, label)


def shuffle_key(seed: int = 42, key: str = "claim_id") -> F.Column:
    """O1: the sort key of a seeded, partition-independent shuffle."""
    return draw_key(seed, key, sep="#")


def seeded_shuffle(df: DataFrame, seed: int = 42, key: str = "claim_id") -> DataFrame:
    """O1: global order by ``md5(seed#key)`` then key (range-partitioned sort)."""
    return df.withColumn("shuffle_key", shuffle_key(seed, key)).orderBy("shuffle_key", key)
