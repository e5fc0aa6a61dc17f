"""Packing token pieces by patterns fitted with non-negative least squares (operator 2).

Documents are encoded once; ids longer than ``size`` are cut into pieces of
``size`` with a possibly shorter first piece. Only the histogram of piece
lengths (at most ``size`` numbers, whatever the data) reaches the driver:

1. enumerate all patterns of up to three lengths that fill a sequence exactly;
2. fit how often each pattern repeats by non-negative least squares against
   the histogram (accelerated projected gradient, weights falling with length
   as short pieces fit in anywhere), round down, never beyond what is there;
3. pack the residual histogram best-fit decreasing by (length, count).

The plan is a table of intervals: pieces number ``a`` to ``b`` of length ``l``
go to sequences ``s``, ``s + 1``, ... at offset ``o``. Pieces are numbered
within their length by Spark: a count per (length, hash bucket), running sums
of those counts, and a row number in each bucket, so a frequent length is
spread over all buckets and no task sees it whole.

Null texts are empty texts (one end id). Null or repeated doc_ids are pieces
like others. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factsift.llm import common, tokens

SIZE = 1024
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """One row per piece of each document's ids."""
    common.prepare(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            for a, b in tokens.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, offsets = tokens.encoder(tokenizer).encode(part.column(1))
                total = np.diff(offsets)
                count = -(-total // size)
                doc = np.repeat(np.arange(len(total)), count)
                no = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = total - (count - 1) * size      # the first piece's length
                start = np.where(no == 0, 0, head[doc] + (no - 1) * size)
                length = np.where(no == 0, head[doc], size)
                data = ids.astype("<u4").tobytes()
                lo = offsets[:-1][doc] + start
                crc = np.fromiter((zlib.crc32(data[4 * x:4 * (x + n)]) for x, n in zip(lo.tolist(), length.tolist())),
                                  dtype=np.int64, count=len(doc))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(no.astype(np.int32)), pa.array(start),
                     pa.array(length.astype(np.int32)), pa.array(crc)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.released(cut), PIECES)


# ---- the plan: constant work on a histogram of at most ``size`` numbers ----------
def patterns(size: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0, a > 0 and a + b + c = size."""
    a, b = np.meshgrid(np.arange(1, size + 1), np.arange(size + 1), indexing="ij")
    c = size - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fit_repeats(histogram: np.ndarray, pats: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min || W (A x - h) ||  over x >= 0, by accelerated projected gradient."""
    size = len(histogram) - 1
    weight = np.sqrt(np.arange(size + 1) / size)
    weight[0] = 0.0
    scale = max(1.0, float(histogram.max()))
    goal = histogram / scale
    flat = pats.ravel()

    def forward(x):
        return np.bincount(flat, weights=np.repeat(x, 3), minlength=size + 1)

    def back(r):
        return r[flat].reshape(-1, 3).sum(axis=1)

    w2 = weight ** 2
    v = np.ones(len(pats))                                # step from the largest singular value
    for _ in range(20):
        v = back(w2 * forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / norm
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0.0, y - step * back(w2 * (forward(y) - goal)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x * scale


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[pd.DataFrame, int]:
    """Intervals ``(length, first, last, sequence, offset)`` and the number of sequences."""
    h = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        h[length] = n
    left, used, out, n_seq = h.copy(), np.zeros(size + 1, dtype=np.int64), [], 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal n_seq
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + times, n_seq, offset))
            used[length] += times
            left[length] -= times
            offset += length
        n_seq += times

    def fits(lengths: list[int]) -> int:
        return min(int(left[x]) // lengths.count(x) for x in set(lengths))

    full = int(left[size])
    if full:
        place([size], full)
    pats = patterns(size)
    pats = pats[np.all((h[pats] > 0) | (pats == 0), axis=1)]   # only lengths that occur
    if len(pats):
        repeats = np.floor(fit_repeats(np.where(np.arange(size + 1) == size, 0, h).astype(float), pats) + 0.5)
        order = np.argsort(-repeats, kind="stable")
        for k in order[repeats[order] >= 1].tolist():
            lengths = [x for x in pats[k].tolist() if x]
            times = min(int(repeats[k]), fits(lengths))
            if times:
                place(lengths, times)
    # the residual histogram, best-fit decreasing on (room, count) groups of open sequences
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(size, 0, -1):
        rest = int(left[length])
        while rest:
            room = next((r for r in range(length, size + 1) if groups.get(r)), None)
            if room is None:
                per = size // length
                if rest >= per:
                    lengths, times = (length,) * per, rest // per
                else:
                    lengths, times = (length,) * rest, 1
                rest -= len(lengths) * times
                groups.setdefault(size - len(lengths) * length, []).append((lengths, times))
                continue
            lengths, times = groups[room].pop()
            per = min(room // length, rest)
            take = min(times, rest // per)
            if times > take:
                groups[room].append((lengths, times - take))
            rest -= per * take
            groups.setdefault(room - per * length, []).append((lengths + (length,) * per, take))
    for members in groups.values():
        for lengths, times in members:
            place(list(lengths), times)
    frame = pd.DataFrame(out, columns=["length", "first", "last", "sequence", "offset"])
    return frame.sort_values(["length", "first"]).reset_index(drop=True), n_seq


def assign(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``cut`` is read twice, so store it first."""
    spark = cut.sparkSession
    common.prepare(spark)
    buckets = common.shuffle_partitions(spark)
    rows = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # at most ``size`` rows, whatever the data
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    intervals, _ = plan(histogram, size)
    begin = {}
    for length, group in intervals.groupby("length"):
        begin[int(length)] = tuple(group[c].to_numpy() for c in ("first", "sequence", "offset"))

    def locate(batches):
        for pdf in batches:
            sequence = np.empty(len(pdf), dtype=np.int64)
            offset = np.empty(len(pdf), dtype=np.int64)
            lengths, number = pdf["length"].to_numpy(), pdf["_number"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(order))):
                at = order[a:b]
                first, seq, off = begin[int(lengths[at[0]])]
                k = np.searchsorted(first, number[at], side="right") - 1
                sequence[at] = seq[k] + number[at] - first[k]
                offset[at] = off[k]
            yield pdf.drop(columns="_number").assign(sequence_id=sequence, offset=offset)

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (rows.withColumn("_at", F.row_number().over(within) - 1)
                .join(base, ["length", "_bucket"])
                .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                        (F.col("_base") + F.col("_at")).alias("_number")))
    return numbered.mapInPandas(locate, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                        "sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """Every piece of ``docs`` with its sequence and offset."""
    return assign(common.store(pieces(docs, tokenizer or tokens.public_tokenizer(), size), "pieces"), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents packed into sequences of 1024 ids."""
    return pack(common.table(spark, sf_dir, "documents"))
