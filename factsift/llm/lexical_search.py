"""Ranked lexical search on document FP-trees (operator 13).

A document's restricted vector is its terms that occur in any item, with their
counts. Per block of documents the vectors become a trie: terms are ordered by
document frequency (frequent first), so documents share paths, and equal
vectors lie side by side. A trie node stands for a run of documents; it keeps
the largest tf of each term below it and the smallest length factor ``m``.
Since a score rises with tf and falls with m, scoring these as if they were one
document bounds every document below. Per item, a depth-first branch and bound
visits children with the highest bound first, leaves a subtree when its bound
is under the score of the current 50th document (an equal bound is followed,
for ties by doc_id) and scores the documents of leaf runs exactly.

Jobs: one pass over the texts stores the restricted vectors and lengths; N, L
and df come from them by Spark aggregates; one pass over the vectors searches;
the tasks' lists are ranked per item. A task holds one block of documents
(``BLOCK_DOCS`` rows, ``BLOCK_TERMS`` vector entries) and its items' lists, so
memory doesn't follow the input. Items are taken in blocks of at most
``BLOCK_ITEM_TERMS`` terms (one item at least); only such a block travels to the
tasks, and each block of items is a pass of its own.

Null or empty texts have no terms: such a document counts nowhere and such an
item returns no rows. Long texts are used whole. Repeated documents (ids too)
are documents of their own and rank side by side; a null doc_id ranks behind
others of its score. Repeated item ids are searched as one item with the terms
of all its rows; a null item_id is an id like others. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factsift.llm import common, words
from factsift.llm.tokens import slices

TOP = 50
BLOCK_DOCS = 8_192
BLOCK_TERMS = 500_000
BLOCK_ITEM_TERMS = 200_000
LEAF = 48                     # documents of a run that is scored without further branching
TEXT_BYTES = 8_000_000        # text split into words at once
SEPARATORS = words.separators("alnum")
_UP = 1_000_000_000


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (_UP * tf) // (1000 * tf + 20 * m)


# ---- restricted vectors ----------------------------------------------------

def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, tfs`` of documents with at least one term; ``terms`` are
    places in the sorted hash array ``vocabulary``."""
    def restrict(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), TEXT_BYTES):
                part = batch.slice(lo, hi - lo)
                hashes, offsets = words.word_hashes(part.column(1), SEPARATORS)
                n = np.diff(offsets)
                code = np.searchsorted(vocabulary, hashes)
                code[code == len(vocabulary)] = 0
                known = np.flatnonzero(vocabulary[code] == hashes) if len(vocabulary) else np.empty(0, dtype=np.int64)
                doc = np.repeat(np.arange(len(n)), n)[known]
                pairs, tf = np.unique(doc * len(vocabulary) + code[known], return_counts=True)
                doc, term = np.divmod(pairs, max(1, len(vocabulary)))
                ends = np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)
                rows = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, type=pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int64)))],
                    names=["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(restrict, "doc_id long, n long, terms array<int>, tfs array<long>")


# ---- the trie of a block of documents --------------------------------------

class Block:
    """Documents in trie order and the nodes over them.

    ``start``/``term``/``tf`` hold the vectors row by row; node i covers rows
    ``low[i] .. high[i] - 1`` and its children are ``children[i]`` (none: a leaf
    run). ``node_of``/``node_tf`` list, term by term, the nodes that have the
    term below them with its largest tf.
    """

    def __init__(self, start: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, rank: np.ndarray):
        # each vector by falling document frequency, then vectors in path order
        row = np.repeat(np.arange(len(start) - 1), np.diff(start))
        by_rank = np.lexsort((rank[term], row))
        term, tf = term[by_rank], tf[by_rank]
        path = rank[term].astype(">u4").tobytes()
        paths = [path[4 * a:4 * b] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__), dtype=np.int64)
        size = np.diff(start)[self.order]
        self.start = np.append(0, np.cumsum(size))
        pick = np.repeat(start[self.order] - self.start[:-1], size) + np.arange(int(size.sum()))
        self.term, self.tf, self.m = term[pick], tf[pick], m[self.order]
        self._build()

    def _shared(self) -> np.ndarray:
        """How many leading terms each row has in common with the row before it."""
        n = len(self.order)
        size = np.diff(self.start)
        out = np.zeros(n, dtype=np.int64)
        live = np.arange(1, n)
        while len(live):
            k = out[live]
            live = live[(k < size[live]) & (k < size[live - 1])]
            k = out[live]
            live = live[self.term[self.start[live] + k] == self.term[self.start[live - 1] + k]]
            out[live] += 1
        return out

    @staticmethod
    def _branches(shared: np.ndarray, a: int, b: int) -> np.ndarray:
        """Edges of the children of rows ``a .. b - 1``: the subtrees one step down
        the path. A child with most of the rows is replaced by its own children
        (a long path costs no level each), small neighbours form a leaf run."""
        done, todo = [], [(a, b)]
        while todo:
            lo, hi = todo.pop()
            inner = shared[lo + 1:hi]
            if hi - lo > LEAF and 10 * (hi - lo) > 7 * (b - a):
                cuts = (lo + 1 + np.flatnonzero(inner == inner.min())).tolist()
                if inner.min() == inner.max():  # equal rows, or single ones
                    cuts = list(range(lo + LEAF, hi, LEAF))
                todo.extend(reversed(list(zip([lo, *cuts], [*cuts, hi]))))
            else:
                done.append((lo, hi))
        edges = [a]
        for lo, hi in done:
            if hi - lo > LEAF or hi - edges[-1] > LEAF:
                if lo > edges[-1]:
                    edges.append(lo)
                if hi - lo > LEAF:
                    edges.append(hi)
        if edges[-1] < b:
            edges.append(b)
        return np.array(edges)

    def _build(self) -> None:
        shared = self._shared()
        low, high, children = [0], [len(self.order)], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = low[node], high[node]
            if b - a <= LEAF:
                continue
            edges = self._branches(shared, a, b)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                children[node].append(len(low))
                todo.append(len(low))
                low.append(lo)
                high.append(hi)
                children.append([])
        self.low, self.high = np.array(low), np.array(high)
        self.children = [np.array(c, dtype=np.int64) for c in children]
        self.least_m = np.array([int(self.m[a:b].min()) if b > a else 0 for a, b in zip(low, high)], dtype=np.int64)
        nodes, terms, tfs = [], [], []
        for i, (a, b) in enumerate(zip(low, high)):
            t, f = self.term[self.start[a]:self.start[b]], self.tf[self.start[a]:self.start[b]]
            by = np.argsort(t, kind="stable")
            t, f = t[by], f[by]
            first = np.flatnonzero(np.diff(t, prepend=-1))
            if len(first):
                terms.append(t[first].astype(np.int32))
                tfs.append(np.maximum.reduceat(f, first))
                nodes.append(np.full(len(first), i, dtype=np.int32))
        term, tf, node = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (terms, tfs, nodes))
        by = np.argsort(term, kind="stable")
        self.by_term, self.node_of, self.node_tf = term[by], node[by], tf[by]

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """An upper bound of the score of every document below each node."""
        lo = np.searchsorted(self.by_term, terms, side="left")
        hi = np.searchsorted(self.by_term, terms, side="right")
        out = np.zeros(len(self.low), dtype=np.int64)
        for a, b, w in zip(lo.tolist(), hi.tolist(), weights.tolist()):
            at = self.node_of[a:b]  # a node stands once under a term
            out[at] += w * impact(self.node_tf[a:b], self.least_m[at])
        return out

    def scores(self, low: int, high: int, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores of rows ``low .. high - 1``."""
        a, b = self.start[low], self.start[high]
        w = weight_of[self.term[a:b]]
        hit = np.flatnonzero(w)
        row = np.searchsorted(self.start[low:high + 1] - a, hit, side="right") - 1
        out = np.zeros(high - low, dtype=np.int64)
        np.add.at(out, row, w[hit] * impact(self.tf[a:b][hit], self.m[low + row]))
        return out


class Best:
    """The best documents of an item so far; equal scores by doc_id, null last."""

    def __init__(self):
        self.score = np.empty(0, dtype=np.int64)
        self.doc = np.empty(0, dtype=np.int64)
        self.null = np.empty(0, dtype=bool)

    @property
    def floor(self) -> int:
        """Scores under this can't enter the list."""
        return int(self.score[-1]) if len(self.score) == TOP else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.floor
        if not good.any():
            return
        score, doc, null = (np.concatenate(x) for x in ((self.score, score[good]), (self.doc, doc[good]), (self.null, null[good])))
        top = np.lexsort((doc, null, -score))[:TOP]
        self.score, self.doc, self.null = score[top], doc[top], null[top]


def search_block(block: Block, doc: np.ndarray, null: np.ndarray, terms: np.ndarray, weights: np.ndarray,
                 weight_of: np.ndarray, best: Best) -> int:
    """Depth-first branch and bound of one item; returns the number of documents scored."""
    bound = block.bounds(terms, weights)
    stack, scored = [0], 0
    while stack:
        node = stack.pop()
        if bound[node] < best.floor:
            continue
        inner = block.children[node]
        if len(inner):
            inner = inner[bound[inner] >= best.floor]
            stack.extend(inner[np.argsort(bound[inner], kind="stable")].tolist())  # the highest bound is popped first
        else:
            a, b = int(block.low[node]), int(block.high[node])
            at = block.order[a:b]
            best.add(block.scores(a, b, weight_of), doc[at], null[at])
            scored += b - a
    return scored


def _blocks(batches):
    """Documents of at most BLOCK_DOCS rows and about BLOCK_TERMS vector entries."""
    held, rows, entries = [], 0, 0
    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), BLOCK_TERMS - entries, side="right")
            to = min(batch.num_rows, at + BLOCK_DOCS - rows, at + max(int(room), rows == 0))
            if to > at:
                held.append(batch.slice(at, to - at))
                rows, entries = rows + to - at, entries + int(sizes[at:to].sum())
            if to < batch.num_rows or rows == BLOCK_DOCS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, entries = [], 0, 0
            at = to
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _search(found: DataFrame, items: list, weight: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Each task's best documents of each item. ``items``: ``(key, term places)``."""
    rank = np.empty(len(df), dtype=np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))

    def run(batches):
        best = [Best() for _ in items]
        weight_of = np.zeros(len(df), dtype=np.int64)
        for table in _blocks(batches):
            lists, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
            start = lists.offsets.to_numpy().astype(np.int64)
            term = lists.values.to_numpy()[start[0]:start[-1]].astype(np.int64)
            tf = tfs.values.to_numpy()[start[0]:start[-1]]
            doc = table["doc_id"].combine_chunks()
            null = doc.is_null().to_numpy(zero_copy_only=False)
            n = table["n"].to_numpy()
            m = 100 - 50 + np.array([(50 * x * n_docs) // n_terms for x in n.tolist()], dtype=np.int64)
            block = Block(start - start[0], term, tf, m, rank)
            ids = doc.fill_null(0).to_numpy()
            for (_, terms), top in zip(items, best):
                weight_of[terms] = weight[terms]
                search_block(block, ids, null, terms, weight[terms], weight_of, top)
                weight_of[terms] = 0
        for (key, _), top in zip(items, best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(top.score), type=pa.int64()), pa.array(top.doc, mask=top.null), pa.array(top.score)],
                    names=["key", "doc_id", "score"])

    return found.mapInArrow(run, "key long, doc_id long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    """``item_id, hashes`` (distinct, sorted) of items with terms; a row an id."""
    def split(batches):
        for batch in batches:
            hashes, offsets = words.word_hashes(batch.column(1), SEPARATORS)
            sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, type=pa.list_(pa.int64()))], names=["item_id", "hashes"])

    common.prepare(items.sparkSession)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sets = rows.mapInArrow(split, "item_id long, hashes array<long>")
    return (sets.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"))
            .where(F.size("hashes") > 0))


def _item_blocks(items: DataFrame):
    """Lists of ``(item_id, hashes)`` of at most BLOCK_ITEM_TERMS terms (one item at least)."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row.hashes) > BLOCK_ITEM_TERMS:
            yield held
            held, size = [], 0
        held.append((row.item_id, np.sort(np.array(row.hashes, dtype=np.int64).view(np.uint64))))
        size += len(row.hashes)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score``: the TOP documents of each item."""
    spark = docs.sparkSession
    out = None
    stored = common.store(_item_terms(items), "search-items")
    for block in _item_blocks(stored):
        vocabulary = np.unique(np.concatenate([h for _, h in block]))
        found = common.store(vectors(docs, vocabulary), "search-vectors")
        total = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            break
        df = np.zeros(len(vocabulary), dtype=np.int64)
        # one row per term of the block of items
        for row in found.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[row.term] = row["count"]
        weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        asked = []
        for key, (_, hashes) in enumerate(block):
            terms = np.searchsorted(vocabulary, hashes)
            asked.append((key, terms[df[terms] > 0]))
        hits = _search(found, asked, weight, df, total.docs, total.terms)
        order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
        names = spark.createDataFrame(pa.table({"key": pa.array(range(len(block)), type=pa.int64()),
                                                "item_id": pa.array([i for i, _ in block], type=pa.int64())}))
        part = ranked.join(F.broadcast(names), "key").select("item_id", "rank", "doc_id", "score")
        part = common.store(part, "search-ranked")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the 50 best documents of every benchmark item."""
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERMS = (r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, {_TERMS.format('text')} AS t FROM documents WHERE text IS NOT NULL
), p AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM p),
i AS (SELECT DISTINCT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark WHERE text IS NOT NULL),
v AS (SELECT DISTINCT term FROM i),
o AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT r, unnest(t) AS term FROM d) SEMI JOIN v USING (term) GROUP BY ALL
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM o, g GROUP BY term, nd
), s AS (
  SELECT item_id, doc_id, r,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN o USING (term) JOIN p USING (r), g GROUP BY item_id, doc_id, r
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
         doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
