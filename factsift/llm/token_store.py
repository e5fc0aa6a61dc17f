"""Token-id files with shuffled bit or byte planes (operator 6).

A shard file holds the ids of consecutive documents::

    b"TKPL0001"
    chunk payloads   each: the planes of one block of ids, zstd, one after another
    footer (zstd)    chunk index and document index as little-endian integers
    footer size (u32), n_chunks (u32), n_docs (u32), b"TKPL0001"

Ids are cut into blocks of ``block`` ids. A block is transposed into planes,
either one per byte of the id (``plane="byte"``) or one per bit
(``plane="bit"``); high planes of small ids are all zero and vanish in zstd.
The chunk index has each chunk's file offset, id count and plane sizes, so any
id range is read by seeking to its chunks only.

Null texts are empty texts, a null doc_id sorts first, rows with equal doc_id
are ordered by a hash of their text; each row is a document of its own.
Empty tables give no shard. Only ``doc_id`` and ``text`` are read, so extra
columns never clash.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factsift.llm import common, tokens

MAGIC = b"TKPL0001"
BLOCK = 65_536


# ---- the file format ----------------------------------------------------------
def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """The planes of a block, low ones first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1).copy().view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").copy().view("<u4").ravel()


class ShardWriter:
    """Streams documents into one shard; holds one block and the index."""

    def __init__(self, out, block: int = BLOCK, plane: str = "byte", level: int = 1):
        self.out, self.block, self.plane = out, block, plane
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC) or len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.chunks: list[list[int]] = []
        self.docs: list[np.ndarray] = []
        self.n_ids = 0

    def _flush(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.plane)]
        self.chunks.append([self.at, len(ids), *map(len, planes)])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def add(self, doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents in order: their ids, whether the id is known, their token ids."""
        self.docs.append(np.stack([doc_ids, known.astype(np.int64), np.diff(offsets)], axis=1))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // self.block * self.block
            for at in range(0, whole, self.block):
                self._flush(joined[at:at + self.block])
            self.waiting, self.held = [joined[whole:]], len(joined) - whole

    def close(self) -> int:
        """Write the footer; the number of documents."""
        if self.held:
            self._flush(np.concatenate(self.waiting))
        docs = np.concatenate(self.docs) if self.docs else np.empty((0, 3), dtype=np.int64)
        footer = self.zip.compress(np.array(self.chunks, dtype="<i8").tobytes() + docs.astype("<i8").tobytes())
        self.out.write(footer + struct.pack("<III", len(footer), len(self.chunks), len(docs)) + MAGIC)
        return len(docs)


class ShardReader:
    """Reads a shard's index, then any range of ids by its chunks."""

    def __init__(self, f, size: int):
        self.f = f
        self.unzip = zstandard.ZstdDecompressor()
        f.seek(size - 20)
        tail = f.read(20)
        length, n_chunks, n_docs = struct.unpack("<III", tail[:12])
        if tail[12:] != MAGIC:
            raise ValueError("not a token shard")
        f.seek(size - 20 - length)
        index = np.frombuffer(self.unzip.decompress(f.read(length)), dtype="<i8")
        docs = index[len(index) - 3 * n_docs:].reshape(-1, 3)
        self.doc_ids, self.known, self.n_tokens = docs[:, 0], docs[:, 1].astype(bool), docs[:, 2]
        self.chunks = index[:len(index) - 3 * n_docs].reshape(n_chunks, -1 if n_chunks else 2)
        self.first = np.append(0, np.cumsum(self.chunks[:, 1])) if n_chunks else np.zeros(1, dtype=np.int64)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.chunks[k].tolist()
        self.f.seek(at)
        planes = []
        for size in sizes:
            planes.append(self.unzip.decompress(self.f.read(size)))
        return from_planes(planes, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard."""
        if stop <= start:
            return np.empty(0, dtype=np.uint32)
        a = int(np.searchsorted(self.first, start, side="right")) - 1
        b = int(np.searchsorted(self.first, stop, side="left"))
        joined = np.concatenate([self.chunk(k) for k in range(a, b)])
        return joined[start - self.first[a]:stop - self.first[a]]

    def documents(self):
        """Every document's ids in order, holding one chunk at a time."""
        k, have, base = 0, np.empty(0, dtype=np.uint32), 0
        ends = np.cumsum(self.n_tokens)
        for end, n in zip(ends.tolist(), self.n_tokens.tolist()):
            parts = [have[end - n - base:]]
            while base + len(have) < end:
                base += len(have)
                have = self.chunk(k)
                k += 1
                parts.append(have)
            drop = base + len(have) - end
            doc = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield doc[:len(doc) - drop] if drop else doc


# ---- the Spark jobs -----------------------------------------------------------
def write_shards(docs: DataFrame, folder: str, tokenizer: str, block: int = BLOCK,
                 plane: str = "byte") -> DataFrame:
    """Encode ``docs`` and write one shard per range of doc_ids.

    Returns the stored manifest ``(shard, uri, size, n_docs, n_ids)``, shards in
    ascending doc_id order. Texts are range-partitioned before they are encoded,
    so ids are never shuffled; a retried task writes another file, and only the
    file of the attempt that ended is in the manifest.
    """
    spark = docs.sparkSession
    common.prepare(spark)

    def write(batches):
        task = TaskContext.get()
        uri = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.tkpl"
        out = writer = None
        for batch in batches:
            for a, b in tokens.slices(batch.column(1)):
                if writer is None:
                    fs, path = common.open_fs(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                    writer = ShardWriter(out, block, plane)
                part = batch.slice(a, b - a)
                ids, offsets = tokens.encoder(tokenizer).encode(part.column(1))
                names = part.column(0)
                writer.add(names.fill_null(0).to_numpy(zero_copy_only=False),
                           names.is_valid().to_numpy(zero_copy_only=False), ids, offsets)
        if writer is not None:
            n_docs = writer.close()
            out.close()
            fs, path = common.open_fs(uri)
            yield pa.RecordBatch.from_pylist([{
                "shard": task.partitionId(), "uri": uri, "size": fs.get_file_info(path).size,
                "n_docs": n_docs, "n_ids": writer.n_ids}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = (rows.repartitionByRange(common.shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), tie)
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie))
    manifest = ordered.mapInArrow(common.released(write), "shard long, uri string, size long, n_docs long, n_ids long")
    return common.store(manifest, "token-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it. The manifest has one
    row per shard, so numbering it is a small window; each task reads a shard.
    """
    spark = manifest.sparkSession
    common.prepare(spark)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = common.open_fs(row["uri"])
                with fs.open_input_file(path) as f:
                    shard = ShardReader(f, row["size"])
                    crcs = np.fromiter((zlib.crc32(d.tobytes()) for d in shard.documents()),
                                       dtype=np.int64, count=len(shard.doc_ids))
                    start = row["base"] + np.cumsum(shard.n_tokens) - shard.n_tokens
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids, mask=~shard.known), pa.array(start),
                         pa.array(shard.n_tokens), pa.array(crcs)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", "uri", "size", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return (based.repartition(common.shuffle_partitions(spark), "shard")
            .mapInArrow(common.released(read), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None,
                block: int = BLOCK, plane: str = "byte") -> tuple[DataFrame, str]:
    """Write the shards of ``docs`` to a fresh shared folder: manifest and folder."""
    folder = common.shared_uri(spark, "token-shards")
    return write_shards(docs, folder, tokenizer or tokens.public_tokenizer(), block, plane), folder


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document's place and checksum, from the files."""
    manifest, _ = token_files(spark, common.table(spark, sf_dir, "documents"))
    return read_documents(manifest)
