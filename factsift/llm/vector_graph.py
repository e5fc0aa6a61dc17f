"""Near-duplicate embeddings on a robust-pruned flat graph (operator 8).

Equal vectors of a label are one vertex with a count. A label of at most ``CAP``
vertices is one cell. A larger one is cut by ``TREES`` trees: at every depth a node
has ``FANOUT`` random directions, fixed by tree and depth and never by the data, and
every vertex goes to the ``NEAREST`` it points along most, until a cell holds at most
``CAP``. As the directions don't know the data, two vectors of cosine ``THRESHOLD``
lose each other with a chance of ``MISS`` a depth of a tree, whatever else the label
holds: of such pairs ``(depth * MISS) ** TREES`` share no cell, 4 in a million at
depth 1 (up to some 17,000 sparse vectors a label) and 3 in 100,000 at depth 2 (some
360,000); closer pairs fewer. A node whose cut would leave more than ``PAYS`` of its
pairs to compare (a dense group falls to the same directions) is a cell uncut, and
loses none: it is dealt into blocks of about ``TARGET``, and every pair of blocks is
one shard, so no task holds much more than ``2 TARGET``.

The cells aren't written: a vertex's walk down the trees follows from its vector and from
the nodes of more than ``CAP`` (counted level by level, sent to all tasks), so any task
finds its cells anew. What is shuffled is a vertex a *unit*: the first node of its walk of
at most ``TOGETHER * CAP`` vertices, within which a task makes the deeper cuts in memory (a
larger cell uncut is dealt into blocks of half a unit, every pair of which is a unit). Units
are worked off in rounds of about ``ROUND`` copies a vertex; a round's shuffle is released
before the next, so the disk in use is a few times the vectors, however deep the cuts.

Each shard builds a graph by robust pruning (``DEGREE``, ``ALPHA``); adjacency
lists of a vertex are united over all shards of its unit. Every vertex is a query
in all its shards: a beam search from the shard's medoid and the query's own
entry, then range expansion, in blocks of alike queries, through every vertex
within ``SLACK`` of the threshold of one of them. Links are verified in double precision
and hold if either end finds them; of the cells that two vertices share the least one
counts their link, so each is counted once. A unit returns its vertices'
link counts and as many links as connect its vertices; components come from a
distributed contraction. ``audit`` measures recall against brute force.

Labels that are null, vectors that are null, empty, zero or hold null or
non-finite values link with nothing and are their own component. Vectors of
different length are never compared. Repeated vec_ids are vectors of their own;
a null vec_id names a component only if all its rows lack one. Empty tables
give no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift.llm import common, components

THRESHOLD = 0.93
SLACK = 0.10
TARGET = 600
CAP = 800
FANOUT = 64
NEAREST = 3
TREES = 3
MISS = 0.0155             # of pairs at the threshold, of one cut; see the tests
PAYS = 0.75
DEGREE = 24
ALPHA = 1.2
CANDIDATES = 96
BEAM = 24
TOGETHER = 10             # times CAP: vertices that a task holds together
ROUND = 2                 # copies a vertex that are shuffled at once
ROUND_ROWS = 200_000      # but so many at least


# ---- numpy, inside a task ---------------------------------------------------------
def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@functools.lru_cache(maxsize=64)
def directions(tree: int, depth: int, size: int) -> np.ndarray:
    return np.random.default_rng(common.seed64("direction", tree, depth)).normal(size=(FANOUT, size))


def nearest(x: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """The ``NEAREST`` of a cut's directions for every row."""
    return np.argpartition(-(x @ directions(tree, depth, x.shape[1]).T), NEAREST - 1, axis=1)[:, :NEAREST]


def mixed(a: np.ndarray, b) -> np.ndarray:
    """A fixed number from two, by splitmix64."""
    z = np.asarray(a, dtype=np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.asarray(b).astype(np.int64).view(np.uint64)
    z = z + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def dealt(a: np.ndarray, parts) -> np.ndarray:
    """Which of ``parts`` each number falls to."""
    return (mixed(a, np.int64(97)).view(np.uint64) >> np.uint64(1)).astype(np.int64) % parts


class Nodes:
    """The nodes of more than ``CAP`` vertices: their sizes, and which are cut."""

    def __init__(self, node=(), n=(), cut=()):
        order = np.argsort(np.asarray(node, dtype=np.int64))
        self.node = np.asarray(node, dtype=np.int64)[order]
        self.n, self.cut = np.asarray(n, dtype=np.int64)[order], np.asarray(cut, dtype=bool)[order]

    def of(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Size (0: at most ``CAP``), and whether it is cut."""
        if not len(self.node):
            return np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=bool)
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        known = self.node[at] == node
        return np.where(known, self.n[at], 0), known & self.cut[at]


def walk(x: np.ndarray, node: np.ndarray, nodes: Nodes, tree: int = -1, depth: int = 0, until: int = 0, trees=None) -> list[np.ndarray]:
    """``row, node, tree, depth, parent`` of where the rows' walks from ``node`` end: in
    cells, or in nodes of at most ``until``. A root is cut by each of ``trees``."""
    row, parent = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    tree, ends = np.full(len(x), tree), []
    while len(row):
        n, cut = nodes.of(node)
        on = cut & (n > until)
        ends.append((row[~on], node[~on], tree[~on], np.full((~on).sum(), depth), parent[~on]))
        row, node, tree, parts = row[on], node[on], tree[on], []
        for t in range(TREES) if trees is None else trees:
            at = np.flatnonzero((tree == t) | (tree < 0))
            if not len(at):
                continue
            once, back = np.unique(row[at], return_inverse=True)
            ahead = nearest(x[once], t, depth)[back].ravel()
            at = np.repeat(at, NEAREST)
            parts.append((row[at], mixed(node[at], (t + 1) * FANOUT + ahead), np.full(len(at), t), node[at]))
        if not parts:
            break
        row, node, tree, parent = (np.concatenate(p) for p in zip(*parts))
        depth += 1
    return [np.concatenate(e) for e in zip(*ends)] if ends else [np.empty(0, dtype=np.int64)] * 5


def met_before(cells: dict, cell: int, rows: np.ndarray) -> np.ndarray:
    """Which pairs of ``rows`` share a cell that is less than ``cell``."""
    flat = np.concatenate([np.asarray(cells[r], dtype=np.int64) for r in rows])
    which = np.repeat(np.arange(len(rows)), [len(cells[r]) for r in rows])
    which, flat = which[flat < cell], flat[flat < cell]
    names, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    met = np.zeros((len(rows), len(rows)), dtype=bool)
    for lo in range(0, len(shared), 1024):
        place = np.full(len(names), -1)
        place[shared[lo:lo + 1024]] = np.arange(len(shared[lo:lo + 1024]))
        ok = place[code] >= 0
        member = np.zeros((len(rows), len(shared[lo:lo + 1024])), dtype=np.float32)
        member[which[ok], place[code[ok]]] = 1
        met |= member @ member.T > 0
    return met


def robust_prune(x: np.ndarray) -> np.ndarray:
    """Out-neighbours of every row (padded with -1): of the nearest candidates
    those that no nearer chosen one already covers."""
    n = len(x)
    out = np.full((n, DEGREE), -1, dtype=np.int64)
    m = min(CANDIDATES, n - 1)
    if m < 1:
        return out
    x = x.astype(np.float32)
    apart = np.maximum(np.float32(0), 1 - x @ x.T)
    cover = np.float32(ALPHA) * apart
    np.fill_diagonal(apart, 4)
    np.fill_diagonal(cover, 0)
    for lo in range(0, n, 256):
        near = apart[lo:lo + 256]
        row = np.arange(lo, lo + len(near))
        if n <= 256:                        # distances of the candidates left, by row number
            left = near if m == n - 1 else np.where(near <= np.partition(near, m - 1, axis=1)[:, m - 1:m], near, np.float32(9))
            left = np.where(left < 4, left, np.float32(9))
            for k in range(DEGREE):         # every row takes its nearest candidate left
                chosen = left.argmin(axis=1)
                some = left[row, chosen] < 4
                if not some.any():
                    break
                out[row[some], k] = chosen[some]
                np.maximum(left, np.multiply(cover[chosen] <= left, np.float32(9), dtype=np.float32), out=left)
            continue
        cand = np.argpartition(near, m - 1, axis=1)[:, :m]
        cand = np.take_along_axis(cand, np.argsort(np.take_along_axis(near, cand, axis=1), axis=1), axis=1)
        dist, alive = np.take_along_axis(near, cand, axis=1), np.ones(cand.shape, dtype=bool)
        for k in range(DEGREE):
            at = alive.argmax(axis=1)
            some = alive[np.arange(len(row)), at]
            if not some.any():
                break
            chosen = cand[np.arange(len(row)), at]
            out[row[some], k] = chosen[some]
            alive &= np.take(cover, chosen[:, None] * n + cand) > dist
    return out


class Adjacency:
    """Neighbour lists of ``n`` rows, united over shards: each gives its links as ``u * n + v``."""

    def __init__(self, n: int, links: list[np.ndarray]):
        keys = np.sort(np.concatenate(links)) if links else np.empty(0, dtype=np.int64)
        keys = keys[np.diff(keys, prepend=-1) > 0]
        self.flat = keys % n
        self.start = np.searchsorted(keys, np.arange(n + 1) * n)

    def among(self, rows: np.ndarray) -> np.ndarray:
        """Which of ``rows`` are neighbours, as a table of booleans."""
        size = self.start[rows + 1] - self.start[rows]
        which = np.repeat(np.arange(len(rows)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + self.start[rows][which]
        place = np.full(len(self.start) - 1, -1)
        place[rows] = np.arange(len(rows))
        place = place[self.flat[at]]
        table = np.zeros((len(rows), len(rows)), dtype=bool)
        table[which[place >= 0], place[place >= 0]] = True
        return table


def greedy(sims: np.ndarray, graph: np.ndarray, q: np.ndarray, medoid: int, close: float) -> np.ndarray:
    """Beam search of every query from the medoid and its own entry; the
    vertices seen that some query is ``close`` to. ``sims``: of queries and rows."""
    at, rows = np.arange(len(q)), sims.shape[1]
    seen = np.zeros(sims.shape, dtype=bool)
    seen[:, medoid] = seen[at, q] = True
    sims = sims + np.float32(2)
    left = seen * sims                      # of those seen, the unopened; 0 for others
    opened = np.empty((len(q), 0), dtype=np.float32)
    found = np.zeros(rows, dtype=bool)
    for turn in range(rows):                # every query opens its best unopened vertex
        pick = left.argmax(axis=1)
        best = left[at, pick]
        live = best > 0
        if turn >= BEAM:                    # if it is in the beam; those better are opened
            live &= np.count_nonzero(opened > best[:, None], axis=1) < BEAM
        if not live.any():
            break
        if 4 * np.count_nonzero(live) < 3 * len(live):
            found |= (seen[~live] & (sims[~live] >= close + 2)).any(axis=0)
            sims, seen, left, opened, pick, best = (c[live] for c in (sims, seen, left, opened, pick, best))
            at, live = np.arange(len(pick)), np.ones(len(pick), dtype=bool)
        opened = np.concatenate([opened, best[:, None]], axis=1)
        ahead = graph[pick]
        if not live.all():
            left[~live] = 0
            ahead[~live] = False
        left[at, pick] = 0
        left += (ahead > seen) * sims
        seen |= ahead
    return np.flatnonzero(found | (seen & (sims >= close + 2)).any(axis=0))


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows each query is linked with, as a table of booleans; ``graph`` is one.

    Queries are taken in blocks of alike ones. After the greedy phase a block
    expands its range together: the neighbours of every vertex near one of its
    queries are compared with the block, until no near vertex is left."""
    linked = np.zeros((len(queries), len(x)), dtype=bool)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    order = np.arange(len(queries))
    if len(queries) > 256:
        sims = x[queries] @ x[:: max(1, len(x) // 32)].T
        order = np.lexsort((-sims.max(axis=1), sims.argmax(axis=1)))
    for lo in range(0, len(queries), 256):
        block = order[lo:lo + 256]
        q = queries[block]
        sims = x[q] @ x.T
        done = np.zeros(len(x), dtype=bool)
        # rounded to single precision for the walk only, so a little wider
        fresh = greedy(sims.astype(np.float32), graph, q, medoid, threshold - SLACK - 1e-6)
        close = (sims >= threshold - SLACK).any(axis=0)
        while len(fresh):
            done[fresh] = True
            fresh = np.flatnonzero(graph[fresh[close[fresh]]].any(axis=0) & ~done)
        linked[block] = (sims >= threshold) & done
    linked[np.arange(len(queries)), queries] = False
    return linked


def shards_of(cell: int, rows: np.ndarray, side: np.ndarray, large: bool, sid: np.ndarray, target: int) -> list[tuple]:
    """``cell, rows, side`` of a cell's shards: a large one is dealt into blocks, and every pair is a
    shard. Of sides 1 and 2 (of a shard, or of the unit) only the links across count."""
    if not large:
        return [(cell, rows, side[rows])]
    parts = [(s, np.array_split(r, max(1, math.ceil(len(r) / target)))) for s in np.unique(side[rows]).tolist()
             for r in [rows[side[rows] == s]] for r in [r[np.argsort(mixed(sid[r], np.int64(5)), kind="stable")]]]
    if len(parts) == 2:
        pairs = [(a, b) for a in parts[0][1] for b in parts[1][1]]
    else:
        blocks = parts[0][1]
        # those of one side of a unit whose other side is empty have no links across
        pairs = [(a, b) for i, a in enumerate(blocks) for b in blocks[i:]] if parts[0][0] == 0 else []
    return [(cell, np.sort(a), np.zeros(len(a), dtype=np.int64)) if a is b else
            (cell, (both := np.concatenate([a, b]))[order := np.argsort(both)], np.repeat([1, 2], [len(a), len(b)])[order]) for a, b in pairs]


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Which of the links ``a, b`` connect what all of them connect."""
    up, out = list(range(n)), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = top(i), top(j)
        if i != j:
            up[i] = j
            out.append(k)
    return out


def unit_links(x: np.ndarray, sid: np.ndarray, copies: np.ndarray, side: np.ndarray, root: int, where: tuple,
               nodes: Nodes, target: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A unit's link counts by row, and links ``a, b`` that connect its rows. ``where``:
    the unit's node, tree and depth."""
    n = len(x)
    row, cell, *_ = walk(x, np.full(n, where[0]), nodes, *where[1:])
    order = np.lexsort((row, cell))
    row, cell = row[order], cell[order]
    names, first = np.unique(cell, return_index=True)
    large = nodes.of(names)[0] > 0
    shards = [s for name, rows, big in zip(names.tolist(), np.split(row, first[1:]), large.tolist())
              for s in shards_of(name, rows, side, big, sid, target)]
    edges = []
    for _, rows, _ in shards:
        out = robust_prune(x[rows])
        r, c = np.nonzero(out >= 0)
        u, v = rows[r], rows[out[r, c]]
        edges += [u * n + v, v * n + u]
    graph = Adjacency(n, edges)
    count, cells, a, b = np.zeros(n, dtype=np.int64), {}, [], []
    for name, rows, sides in shards:
        linked = search(x[rows], graph.among(rows), np.arange(len(rows)), threshold)
        linked |= linked.T
        # of a pair of blocks only the links across; those within have a shard of their own
        linked &= (sides[:, None] != sides[None, :]) | (sides[None, :] == 0)
        some = np.flatnonzero(linked.any(axis=1))
        if not len(some):
            continue
        if new := [r for r in rows[some].tolist() if r not in cells]:
            which, all_cells, *_ = walk(x[new], np.full(len(new), root), nodes)
            cells.update(zip(new, np.split(all_cells[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which, minlength=len(new)))[:-1])))
        linked = linked[np.ix_(some, some)] & ~met_before(cells, name, rows[some])
        some = rows[some]
        count[some] += linked @ copies[some]
        ends = components.connecting(linked, np.arange(len(some)), len(some))
        a += [int(some[i]) for i, _ in ends]
        b += [int(some[j]) for _, j in ends]
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    kept = spanning(a, b, n)
    return count, a[kept], b[kept]


# ---- Spark jobs ---------------------------------------------------------------------
def vertices(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, verts)``: rows ``vec_id, sid, copies`` of all vectors, vertices
    ``sid, node, vector, copies``; both stored."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                       F.col("embedding").cast("array<float>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0)
    # rows find their vertex by 128 bits of a hash, so that vectors are shuffled once
    keys = [F.xxhash64("label", "vector").alias("k1"), F.xxhash64(F.lit("second"), "label", "vector").alias("k2")]
    groups = v.where(usable).groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    verts = common.store(groups.select(F.monotonically_increasing_id().alias("sid"), F.xxhash64("label", F.size("vector")).alias("node"),
                                       "vector", "copies", *keys), "vectors")
    keyed = v.select("vec_id", *(F.when(usable, k).alias(name) for k, name in zip(keys, ["k1", "k2"])))
    rows = keyed.join(verts.select("k1", "k2", "sid", "copies"), ["k1", "k2"], "left").select("vec_id", "sid", "copies")
    return common.store(rows, "vector-rows"), verts.select("sid", "node", "vector", "copies")


def by_size(batch: pa.RecordBatch):
    """The rows of each length of vector: the part of the batch, and its vectors."""
    size = batch.column("vector").value_lengths().to_numpy()
    for d in np.unique(size).tolist():
        part = batch if (size == d).all() else batch.filter(pa.array(size == d))
        yield part, part.column("vector").flatten().to_numpy().reshape(-1, d)


def cut_nodes(verts: DataFrame) -> tuple[Nodes, list[tuple]]:
    """The trees, level by level: all nodes of more than ``CAP``, and ``node, n, cut,
    tree, size of the parent`` of each."""
    spark = verts.sparkSession
    common.prepare(spark)
    cap, known = CAP, []
    level = verts.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).toPandas()
    level = [(int(k), int(n), -1, 0) for k, n in zip(level["node"], level["n"])]
    depth = 0
    while level:
        trial = spark.sparkContext.broadcast(Nodes(*zip(*[k[:3] for k in known], *[(k[0], k[1], True) for k in level])))
        counted = []
        # deep levels have many nodes, so their counts are made tree by tree
        for trees in [range(TREES)] if depth < 2 else [[t] for t in range(TREES)]:
            def count(batches, trees=list(trees), depth=depth):
                nodes, sums = trial.value, []
                for batch in batches:
                    for part, raw in by_size(batch):
                        root = part.column("node").to_numpy()
                        at = np.flatnonzero(nodes.of(root)[1])
                        _, node, tree, deep, parent = walk(unit(raw[at]), root[at], nodes, trees=trees)
                        at = np.flatnonzero(deep == depth + 1)
                        sums.append(total(node[at], parent[at], tree[at], np.ones(len(at), dtype=np.int64)))
                        if len(sums) > 16:
                            sums = [total(*(np.concatenate(p) for p in zip(*sums)))]
                if sums:
                    out = total(*(np.concatenate(p) for p in zip(*sums)))
                    for lo in range(0, len(out[0]), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + 100_000], type=pa.int64()) for c in out], ["node", "parent", "tree", "m"])

            counted.append(common.store(verts.select("node", "vector").mapInArrow(count, "node long, parent long, tree long, m long")
                                        .groupBy("node", "parent", "tree").agg(F.sum("m").alias("m")), f"cut-{depth}"))
        every = functools.reduce(DataFrame.unionByName, counted)
        # pairs left to compare, of a node's own
        work = every.groupBy("parent").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("work")).toPandas()
        work = dict(zip(work["parent"].tolist(), work["work"].tolist()))
        paying = {k: work.get(k, 0.0) <= PAYS * float(n) * n for k, n, *_ in level}
        sizes = {k: n for k, n, *_ in level}
        known += [(k, n, paying[k], tree, above) for k, n, tree, above in level]
        large = every.where(F.col("m") > cap).toPandas()
        level = [(k, m, t, sizes[p]) for k, m, t, p in zip(large["node"].tolist(), large["m"].tolist(), large["tree"].tolist(), large["parent"].tolist())
                 if paying[p]]
        common.discard(*counted)
        trial.unpersist()
        depth += 1
    return Nodes(*zip(*[k[:3] for k in known])), known


def total(node: np.ndarray, parent: np.ndarray, tree: np.ndarray, m: np.ndarray) -> tuple:
    """``m`` summed by node."""
    node, first, back = np.unique(node, return_index=True, return_inverse=True)
    return node, parent[first], tree[first], np.bincount(back, weights=m, minlength=len(node)).astype(np.int64)


def partition_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of ``parts`` partitions a number that ``repartition`` deals to it."""
    keys = np.arange(parts)
    for r in spark.range(16 * parts + 64).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).collect():
        keys[r.p] = r.id
    return keys


def links(verts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``sid, other, n``: rows with ``n`` for a vertex's linked vectors in a unit (``other``
    null), and rows with ``other`` for the links that connect a unit's vertices."""
    spark = verts.sparkSession
    every = verts.count()
    nodes, known = cut_nodes(verts)
    most, target = TOGETHER * CAP, TARGET
    half = most // 2
    # rows to shuffle, by tree: units of the roots have none (-1)
    rows = {t: 0 for t in range(-1, TREES)}
    rows[-1] = every
    for _, n, cut, tree, _ in known:
        if n > most and cut:
            rows[tree] -= n
            for t in range(TREES) if tree < 0 else [tree]:
                rows[t] += NEAREST * n
        elif n > most:
            rows[tree] += n * (math.ceil(n / half) - 1)
    shared, found = spark.sparkContext.broadcast(nodes), []
    for tree, rounds in ((t, math.ceil(m / max(ROUND * every, ROUND_ROWS))) for t, m in rows.items() if m > 0):
        parts = max(common.shuffle_partitions(spark), math.ceil(rows[tree] / rounds / (2 * most)))
        keys = partition_keys(spark, parts)
        # units of more than CAP, the largest first, each to the partition with the least so far
        units = [(n, k) for k, n, cut, t, above in known if t == tree and (n <= most and (above > most or tree < 0))]
        for r in range(rounds):
            load, slot = [(0, p) for p in range(parts)], {}
            for n, k in sorted(u for u in units if dealt(np.array([u[1]]), rounds)[0] == r)[::-1]:
                held, p = heapq.heappop(load)
                slot[k] = p
                heapq.heappush(load, (held + n, p))
            slots = np.array(sorted(slot), dtype=np.int64), np.array([slot[k] for k in sorted(slot)], dtype=np.int64)

            def place(batches, tree=tree, r=r, rounds=rounds, slots=slots, keys=keys):
                nodes = shared.value
                for batch in batches:
                    for part, raw in by_size(batch):
                        root, sid = part.column("node").to_numpy(), part.column("sid").to_numpy()
                        copies = part.column("copies").to_numpy()
                        n, cut = nodes.of(root)
                        at = np.flatnonzero((n > most) & cut if tree >= 0 else (n <= most) | ~cut)
                        if not len(at):
                            continue
                        # roots are units already: nothing to cut
                        x = unit(raw[at]) if tree >= 0 else raw[at]
                        row, node, _, depth, _ = walk(x, root[at], nodes, until=most, trees=[tree] if tree >= 0 else [])
                        row, n = at[row], nodes.of(node)[0]
                        blocks = np.where(n > most, -(-n // half), 1)
                        block = dealt(sid[row], blocks)
                        other = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                        row, node, depth, block, blocks = (np.repeat(c, blocks) for c in (row, node, depth, block, blocks))
                        lo, hi = np.minimum(block, other), np.maximum(block, other)
                        name = np.where(blocks > 1, mixed(mixed(node, lo), hi), node)
                        side = np.where(block == other, 0, np.where(block < other, 1, 2))
                        now = np.flatnonzero(dealt(name, rounds) == r)
                        row, node, depth, name, side = row[now], node[now], depth[now], name[now], side[now]
                        to = dealt(mixed(name, np.int64(3)), len(keys))
                        if len(slots[0]):
                            i = np.minimum(np.searchsorted(slots[0], name), len(slots[0]) - 1)
                            to = np.where(slots[0][i] == name, slots[1][i], to)
                        for a in range(0, len(row), 20_000):
                            z = slice(a, a + 20_000)
                            data = np.ascontiguousarray(raw[row[z]], dtype=np.float32)
                            ends = np.arange(len(data) + 1, dtype=np.int32) * (4 * data.shape[1])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(keys[to[z]], type=pa.int64()), *(pa.array(c, type=pa.int64()) for c in (name[z], node[z], root[row[z]], sid[row[z]], copies[row[z]])),
                                 *(pa.array(c, type=pa.int32()) for c in (depth[z], side[z])),
                                 pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])],
                                ["slot", "unit", "node", "root", "sid", "copies", "depth", "side", "vector"])

            def run(batches, tree=tree):
                nodes = shared.value

                def one(held: list[pa.RecordBatch]):
                    t = pa.Table.from_batches(held)
                    if len(t) < 2:
                        return
                    t = t.take(np.argsort(t.column("sid").to_numpy(), kind="stable"))
                    sid, copies, side = (t.column(c).to_numpy() for c in ("sid", "copies", "side"))
                    x = unit(np.frombuffer(b"".join(t.column("vector").to_pylist()), dtype=np.float32).reshape(len(t), -1))
                    node, root, depth = (t.column(c)[0].as_py() for c in ("node", "root", "depth"))
                    n, a, b = unit_links(x, sid, copies, side.astype(np.int64), root, (node, tree, depth), nodes, target, threshold)
                    some = np.flatnonzero(n)
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate([sid[some], sid[a]]), type=pa.int64()),
                             pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), sid[b]]), type=pa.int64(),
                                      mask=np.arange(len(some) + len(a)) < len(some)),
                             pa.array(np.concatenate([n[some], np.zeros(len(a), dtype=np.int64)]), type=pa.int64())], ["sid", "other", "n"])

                held, last = [], None
                for batch in batches:
                    name = batch.column("unit").to_numpy()
                    edge = np.flatnonzero(name[1:] != name[:-1]) + 1
                    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(name)]):
                        if lo == hi:
                            continue
                        if held and name[lo] != last:
                            yield from one(held)
                            held = []
                        last = name[lo]
                        held.append(batch.slice(lo, hi - lo))
                if held:
                    yield from one(held)

            placed = verts.mapInArrow(place, "slot long, unit long, node long, root long, sid long, copies long, depth int, side int, vector binary")
            found.append(common.store(placed.repartition(parts, "slot").sortWithinPartitions("unit")
                                      .mapInArrow(common.released(run), "sid long, other long, n long"), "links"))
    if not found:
        return spark.createDataFrame([], "sid long, other long, n long")
    return functools.reduce(DataFrame.unionByName, found)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    with common.shuffles_released(vectors.sparkSession):
        rows, verts = vertices(vectors)
        found = links(verts, threshold)
        common.discard(verts)
        joined = components.connected_components(
            found.where(F.col("other").isNotNull()).select(F.col("sid").alias("a"), F.col("other").alias("b")))
        counts = found.where(F.col("other").isNull()).groupBy("sid").agg(F.sum("n").alias("n"))
        per = counts.join(joined.withColumnRenamed("id", "sid"), "sid", "full")
        all_rows = common.store(rows.join(per, "sid", "left")
                                .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                        F.coalesce("component", "sid").alias("component")), "vector-classes")
    least = all_rows.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    alone = F.col("component").isNull()
    return (all_rows.join(least, "component", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(alone, F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def audit(vectors: DataFrame, found: DataFrame, every: int = 100, threshold: float = THRESHOLD) -> float:
    """Recall: the share of brute-force links of the vectors whose id ``every``
    divides that ``found`` counts. The queries are a stated set, compared with
    all rows of their label."""
    v = vectors.select("vec_id", "label", F.col("embedding").alias("e")).where("label is not null and embedding is not null")
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = v.withColumn("norm", norm).where("norm > 0 and not isnan(norm)")
    q = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), "label", F.col("e").alias("qe"), F.col("norm").alias("qn"))
    dot = F.aggregate(F.zip_with("e", "qe", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    true = (v.join(q, "label").where((F.col("vec_id") != F.col("q")) & (dot / (F.col("norm") * F.col("qn")) >= threshold))
            .groupBy("q").agg(F.count(F.lit(1)).alias("true")))
    both = true.join(found, true["q"] == found["vec_id"]).agg(F.sum("true"), F.sum(F.least("true", "n_links"))).first()
    return 1.0 if not both[0] else both[1] / both[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every vector's links and component."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
