"""Global numbering, batch assignment and resume (W2, J4, T1 batch form).

Numbers are dense, 0-based and exact, and no text is sorted, checkpointed or
put in one task for them:

* ``number_file_rows`` numbers the rows of a file source where they are read:
  rows are counted per block (file split), a prefix sum over blocks gives each
  block's first number, and a row adds its place in its block.
* ``assign_sequence`` numbers any frame in the order of key columns: only the
  distinct keys are sorted and numbered; rows then look their key up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factsift.session import checkpoint_root

_LOCAL_BITS = 33  # monotonically_increasing_id(): partition id << 33 | row in partition
_BROADCAST_BLOCKS = 1_000_000  # blocks whose first numbers travel to the tasks (16 bytes each)


def _running(df: DataFrame, order: list[str], n: str, name: str) -> DataFrame:
    """``name``: the sum of ``n`` over the rows before, in ``order``; ``df`` has one
    row a block or partition, so one task holds it."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(n).over(before), F.lit(0)))


def number_file_rows(df: DataFrame, name: str = "seq") -> DataFrame:
    """Rows of a file source (filtered or not) numbered by file path and place.

    ``df`` must come straight from ``spark.read``; the same filter counts and
    numbers. Counting reads the source once more, with no column but those its
    filter needs. One row a block is kept (its first row's id, its first number).
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_id"))
    blocks = tagged.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    placed = _running(blocks, ["_file", "_block"], "_n", "_before")
    parts = placed.groupBy(F.shiftright("_first", _LOCAL_BITS).alias("_part")).agg(
        F.array_sort(F.collect_list(F.struct("_first", (F.col("_before") - F.col("_first")).alias("shift")))).alias("_blocks"),
        F.count(F.lit(1)).alias("_k"))
    checkpoint_root(df.sparkSession)
    parts = parts.checkpoint(eager=True)
    if (parts.agg(F.sum("_k")).first()[0] or 0) <= _BROADCAST_BLOCKS:
        parts = F.broadcast(parts)
    own = F.element_at(F.filter("_blocks", lambda b: b["_first"] <= F.col("_id")), -1)["shift"]
    rows = tagged.withColumn("_part", F.shiftright("_id", _LOCAL_BITS)).join(parts, "_part")
    return rows.select(*df.columns, (F.col("_id") + own).cast("long").alias(name))


def number_keys(keys: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """``assign_sequence`` for a frame that is itself a table of keys: it is
    range-sorted and checkpointed once, and nothing is looked up."""
    checkpoint_root(keys.sparkSession)
    tagged = keys.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright("_id", _LOCAL_BITS)
    offsets = _running(tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")), ["_part"], "_n", "_before")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (tagged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .select(*keys.columns, place.cast("long").alias(name)))


def assign_sequence(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Dense ``seq`` (0..n-1) following the columns ``order`` (null first); those
    that start with an underscore (helper columns) are dropped.

    Distinct keys are counted, range-sorted and checkpointed; a prefix sum over
    partitions (one row each) gives every key its first number. Rows take it by
    a hash join, which moves each at most once. Rows of equal keys are told
    apart by a hash of their content; equal rows are interchangeable. Only such
    rows (none, if keys are unique) pass a window.
    """
    keys = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    checkpoint_root(df.sparkSession)
    tagged = keys.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright("_id", _LOCAL_BITS)
    offsets = _running(tagged.groupBy(part.alias("_part")).agg(F.sum("_n").alias("_all")), ["_part"], "_all", "_before")
    within = Window.partitionBy(part).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    first = (F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_seq")
    numbered = (tagged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
                .select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(order)], "_n", first))
    match = F.lit(True)
    for i, c in enumerate(order):
        match = match & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    kept = [c for c in df.columns if c not in order or not c.startswith("_")]

    def look_up(of: DataFrame) -> DataFrame:
        return df.join(of.hint("shuffle_hash"), match)

    single = look_up(numbered.where("_n = 1")).select(*kept, F.col("_seq").cast("long").alias(name))
    tied = look_up(numbered.where("_n > 1"))
    same = Window.partitionBy("_seq").orderBy(F.xxhash64(*df.columns), F.hash(*df.columns))
    tied = tied.select(*kept, (F.col("_seq") + F.row_number().over(same) - 1).cast("long").alias(name))
    return single.unionByName(tied)


def assign_batches(df: DataFrame, size: int, seq: str = "seq", name: str = "batch_id") -> DataFrame:
    """``batch_id = seq div size``; the last batch may be short."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return df.withColumn(name, F.floor(F.col(seq) / F.lit(size)).cast("long"))


def pending(todo: DataFrame, done: DataFrame, key: str | list[str] = "claim_id") -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done`` (row-level resume)."""
    keys = [key] if isinstance(key, str) else list(key)
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
