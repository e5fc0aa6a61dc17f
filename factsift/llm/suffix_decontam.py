"""Benchmark decontamination with word suffix arrays (operator 10).

Each task cuts its documents into shards of about ``SHARD_WORDS`` words (whole
documents; a longer document is a shard of its own), builds the shard's suffix
array over word hashes by prefix doubling (only suffixes that still tie are
sorted again, to the depth of a window), and binary-searches the windows at
every benchmark suffix. A longest verbatim match begins where an occurrence and
a place in an item have different words before them; only such pairs are made
(not all occurrences times all places) and followed word by word to their end.
All work is local to a shard, so nothing is shuffled, and a passage costs its
occurrences and its longest matches, however often its words repeat.

The benchmark goes to the shared folder as files of at most ``BLOCK_ITEMS``
items. A task holds its shard's array and searches one block after another: one
block is in memory besides the ``BLOCKS_KEPT`` that are kept for the next shard,
so neither the benchmark's size nor the driver limits it (further blocks are
read once a shard). An item or document of any length is searched whole.

Words: maximal runs outside ASCII other than 0-9 A-Z a-z, A-Z lower-cased. A
window is ``window`` consecutive item words; an item of fewer, but not none, is
one window. Null or empty texts have no words; null and repeated doc_ids are
rows like others; a null item_id is called ``null``; repeated items count once
by id. An empty benchmark hits nothing. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift.llm import common, words

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_ITEMS = 5_000
BLOCKS_KEPT = 2
SEPARATORS = words.separators("alnum")


class Block:
    """The distinct windows of some benchmark items and where they start."""

    def __init__(self, names: list[str], hashes: np.ndarray, offsets: np.ndarray, window: int):
        self.names = np.array(names, dtype=object)
        starts, lengths, item = [], [], []
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            n = b - a
            if n:
                w = min(window, n)
                starts.append(np.arange(a, b - w + 1))
                lengths.append(np.full(n - w + 1, w))
                item.append(np.full(n - w + 1, k))
        cat = (lambda x: np.concatenate(x)) if starts else (lambda x: np.empty(0, dtype=np.int64))
        start, self.source_len, self.source_item = cat(starts), cat(lengths), cat(item)
        grid = start[:, None] + np.arange(window)[None, :]
        inside = np.arange(window)[None, :] < self.source_len[:, None]
        table = np.where(inside, hashes[np.minimum(grid, max(len(hashes) - 1, 0))] if len(hashes) else 0, np.uint64(0))
        key = np.concatenate([table, self.source_len[:, None].astype(np.uint64)], axis=1)
        _, first, back = np.unique(key, axis=0, return_index=True, return_inverse=True)
        back = back.ravel()
        self.windows, self.lengths = table[first], self.source_len[first]
        order = np.argsort(back, kind="stable")
        # the places of each window, and the items' words
        self.source_item, self.source_word = self.source_item[order], start[order]
        self.source_from = np.searchsorted(back[order], np.arange(len(first) + 1))
        self.hashes, self.offsets = hashes, offsets


@lru_cache(maxsize=BLOCKS_KEPT)
def load_block(uri: str, window: int) -> Block:
    fs, path = common.open_fs(uri)
    with fs.open_input_file(path) as f:
        t = pq.read_table(f, columns=["item", "text"])
    hashes, offsets = words.word_hashes(t["text"].combine_chunks(), SEPARATORS)
    return Block(t["item"].to_pylist(), hashes, offsets, window)


class SuffixArray:
    """Suffixes of whole documents, sorted by their first ``depth`` words."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, depth: int):
        n_docs = len(offsets) - 1
        self.vocab, codes = np.unique(hashes, return_inverse=True)
        # text with a separator after each document; words are 1, 2, ...
        self.begin = offsets[:-1] + np.arange(n_docs)
        seq = np.zeros(len(hashes) + n_docs, dtype=np.int64)
        at = np.arange(len(hashes)) + np.repeat(np.arange(n_docs), np.diff(offsets))
        seq[at] = codes.ravel() + 1
        self.seq = np.append(seq, np.zeros(WINDOW * 4, dtype=np.int64))
        n = len(seq)
        order = np.argsort(seq, kind="stable")
        ordered = seq[order]
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        rank = np.empty(n + 1, dtype=np.int64)
        size = np.diff(first, append=n)
        rank[order] = np.repeat(first, size)
        # every separator is a rank of its own
        rank[order[:n_docs]] = np.arange(n_docs)
        rank[n] = 0
        slots = np.flatnonzero(np.repeat(size, size) > 1)
        slots = slots[slots >= n_docs]
        k = 1
        while len(slots) and k < depth:
            tied = order[slots]
            key = rank[tied] * (n + 1) + rank[np.minimum(tied + k, n)]
            again = np.argsort(key, kind="stable")
            tied, key = tied[again], key[again]
            order[slots] = tied
            first = np.flatnonzero(np.diff(key, prepend=-1))
            size = np.diff(first, append=len(key))
            rank[tied] = np.repeat(slots[first], size)
            slots = slots[np.repeat(size, size) > 1]
            k *= 2
        self.order = order

    def ranges(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Binary search: the windows that occur, and their suffix ranges."""
        width = windows.shape[1]
        inside = np.arange(width)[None, :] < lengths[:, None]
        code = np.searchsorted(self.vocab, windows)
        found = self.vocab[np.minimum(code, max(len(self.vocab) - 1, 0))] == windows if len(self.vocab) else np.zeros_like(inside)
        live = np.flatnonzero((found | ~inside).all(axis=1) & (lengths > 0))
        code, inside = code[live] + 1, inside[live]

        def bound(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(self.order), dtype=np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                start = self.order[np.minimum(mid, len(self.order) - 1)]
                below = np.zeros(len(live), dtype=bool)
                same = np.ones(len(live), dtype=bool)
                for j in range(width):
                    word = self.seq[np.minimum(start + j, len(self.seq) - 1)]
                    here = same & inside[:, j]
                    below |= here & (word < code[:, j])
                    same &= ~inside[:, j] | (word == code[:, j])
                right = open_ & (below | (same if after else False))
                lo = np.where(right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            return lo

        lo, hi = bound(False), bound(True)
        hit = hi > lo
        return live[hit], lo[hit], hi[hit]


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of integer ranges, flat, and which range each is from."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def match_starts(array: SuffixArray, block: Block, which: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Where longest matches begin: ``(text position, place in the block, window)``.

    Places are sorted by window and the word before them, so an occurrence takes
    its window's places but for the run with its own word before (there the match
    began earlier). At the start of a document or item no word is before."""
    place, q = spread(block.source_from[which], block.source_from[which + 1])
    at = block.source_word[place]
    before = block.hashes[np.maximum(at - 1, 0)]
    code = np.searchsorted(array.vocab, before)
    known = (at > block.offsets[block.source_item[place]]) & (array.vocab[np.minimum(code, len(array.vocab) - 1)] == before)
    code = np.where(known, code + 1, 0)
    by = np.lexsort((code, q))
    place, q, code = place[by], q[by], code[by]
    n_codes = len(array.vocab) + 1
    key = q * n_codes + code
    slot, r = spread(lo, hi)
    p = array.order[slot]
    own = np.where(p > 0, array.seq[np.maximum(p - 1, 0)], 0)
    ends = np.searchsorted(q, np.arange(len(which) + 1))
    same_from = np.where(own > 0, np.searchsorted(key, r * n_codes + own), ends[r])
    same_to = np.where(own > 0, np.searchsorted(key, r * n_codes + own, side="right"), ends[r])
    a, i = spread(ends[r], same_from)
    b, j = spread(same_to, ends[r + 1])
    i, place = np.concatenate([i, j]), place[np.concatenate([a, b])]
    return p[i], place, which[r[i]]


def follow(array: SuffixArray, block: Block, p: np.ndarray, s: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words of the matches that begin at ``(p, s)`` and have ``n`` words already."""
    n = n.copy()
    live = np.arange(len(p))
    while len(live):
        there = s[live] + n[live]
        word = array.seq[np.minimum(p[live] + n[live], len(array.seq) - 1)]
        inside = (there < end[live]) & (word > 0)
        live, there, word = live[inside], there[inside], word[inside]
        live = live[array.vocab[word - 1] == block.hashes[there]]
        n[live] += 1
    return n


def scan_shard(hashes: np.ndarray, offsets: np.ndarray, blocks, window: int = WINDOW):
    """``n_hit`` of each document, and its longest matches
    ``(doc, item name, item word, doc word, words)`` as parallel arrays; ``blocks``
    is gone through once."""
    n_docs = len(offsets) - 1
    array = SuffixArray(hashes, offsets, window)
    cover = np.zeros(len(array.seq) + 1, dtype=np.int32)
    matches = []
    for block in blocks:
        which, lo, hi = array.ranges(block.windows, block.lengths)
        if not len(which):
            continue
        slot, r = spread(lo, hi)
        position = array.order[slot]
        np.add.at(cover, position, 1)
        np.add.at(cover, position + block.lengths[which[r]], -1)
        p, place, found = match_starts(array, block, which, lo, hi)
        item, s = block.source_item[place], block.source_word[place]
        length = follow(array, block, p, s, block.offsets[item + 1], block.lengths[found])
        rows = np.lexsort((s, p))
        p, item, s, length = p[rows], item[rows], s[rows], length[rows]
        doc = np.searchsorted(array.begin, p, side="right") - 1
        matches.append((doc, block.names[item], s - block.offsets[item], p - array.begin[doc], length))
    covered = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
    ends = array.begin + np.diff(offsets)
    n_hit = covered[ends] - covered[array.begin] if n_docs else np.empty(0, dtype=np.int64)
    empty = [np.empty(0, dtype=np.int64), np.empty(0, dtype=object), *[np.empty(0, dtype=np.int64)] * 3]
    return n_hit, [np.concatenate(x) for x in zip(*matches)] if matches else empty


def shards(batches, column: int):
    """Groups of whole rows of about SHARD_WORDS words: batch, hashes, offsets."""
    held, parts, n = [], [], 0
    for batch in batches:
        hashes, offsets = words.word_hashes(batch.column(column), SEPARATORS)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + SHARD_WORDS - n, side="right")) - 1
            to = min(max(to, at + (n == 0)), batch.num_rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                parts.append((hashes[offsets[at]:offsets[to]], np.diff(offsets[at:to + 1])))
                n += int(offsets[to] - offsets[at])
            if to < batch.num_rows:
                yield held, parts
                held, parts, n = [], [], 0
            at = to
    if held:
        yield held, parts


def _scanned(batches, column: int, uris: list[str], window: int):
    for held, parts in shards(batches, column):
        offsets = np.append(0, np.cumsum(np.concatenate([c for _, c in parts])))
        hashes = np.concatenate([h for h, _ in parts])
        yield held, offsets, *scan_shard(hashes, offsets, (load_block(u, window) for u in uris), window)


def benchmark_blocks(benchmark: DataFrame) -> list[str]:
    """The benchmark as block files in the shared folder."""
    spark = benchmark.sparkSession
    common.prepare(spark)
    folder = common.shared_uri(spark, "benchmark")
    (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
     .write.option("maxRecordsPerFile", BLOCK_ITEMS).parquet(folder))
    fs, path = common.open_fs(folder)
    base = folder[:-len(path)] if folder.endswith(path) else folder.split("://")[0] + "://"
    return sorted(base + i.path for i in fs.get_file_info(pafs.FileSelector(path)) if i.path.endswith(".parquet"))


REPORT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "matches array<struct<item_id:string,item_start:long,doc_start:long,n_words:long>>")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: hit words, items found, and all longest matches with their places."""
    uris = benchmark_blocks(benchmark)

    def scan(batches):
        for held, offsets, n_hit, (doc, item, item_at, doc_at, length) in _scanned(batches, 1, uris, window):
            n = len(offsets) - 1
            found: list[list] = [[] for _ in range(n)]
            for k, *m in zip(doc.tolist(), item.tolist(), item_at.tolist(), doc_at.tolist(), length.tolist()):
                found[k].append(dict(zip(("item_id", "item_start", "doc_start", "n_words"), m)))
            names = [sorted({m["item_id"] for m in f}) for f in found]
            none = hashlib.sha256(b"").hexdigest()
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else none for x in names]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([b.column(0) for b in held]), pa.array(np.diff(offsets)), pa.array(n_hit.astype(np.int64)),
                 pa.array([len(x) for x in names], type=pa.int64()), pa.array(digests), pa.array(n_hit > 0),
                 pa.array(found, type=pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()),
                                                          ("doc_start", pa.int64()), ("n_words", pa.int64())])))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; columns as they were."""
    uris = benchmark_blocks(benchmark)
    at = docs.columns.index("text")

    def clean(batches):
        for held, _, n_hit, _ in _scanned(batches, at, uris, window):
            keep = n_hit == 0
            for b in held:
                yield b.filter(pa.array(keep[:b.num_rows]))
                keep = keep[b.num_rows:]

    return docs.mapInArrow(clean, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the contamination report of all documents."""
    found = report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    longest = F.array_max(F.transform("matches", lambda m: m["n_words"]))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
                        F.coalesce(longest, F.lit(0)).alias("longest_match"))
