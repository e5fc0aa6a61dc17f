"""Near-duplicate documents by a chosen-path similarity join (operator 7).

Texts become sets of ``SHINGLE``-word shingles; equal sets are one vertex, so
exact copies are never compared. The join then grows ``TREES`` independent
trees. A tree's root branches a vertex by one of its minwise tokens; below, a
node chooses ``FORKS`` times ``STEP`` tokens (by a hash of its path) and sends each
member to the child of its values there. Two sets of similarity ``s`` stay together in
a child with probability ``s ** STEP``, others are soon parted: at 0.5 a level leaves
3 / 8 of a node's rows, so rows and levels stay few where many texts share a line
or are loosely alike.

* A node of at most ``LEAF`` members is compared exhaustively.
* A larger one first compares all members with up to ``PIVOTS`` of them, the
  pivots, on full sets. Pivots are then done. A member linked to one is done as
  well if the triangle inequality of the Jaccard distance rules out a link to
  any member that is not linked to that pivot. Members that remain carry a pivot
  they are linked to; a node whose members all share one is done. So a dense
  group costs a pass, not all its pairs, whatever its size.
* Nodes with the same members (in other trees too) are one.

A pair of similarity t stays together in a root's child with probability t, and
below it with 1 - q, where q = (1 - t^3 (1 - q))^3 is the chance that its branching
dies out: q is 0.08 at t = 0.85 and 0.21 at 0.80, in the limit of deep trees. Roots of at most LEAF members, the usual case, are compared
outright (q = 0): ``TREES`` trees then miss (1 - t)^TREES, 3 pairs in 10 million
at 0.85 and 3 in a million at 0.80. Where every root branches deeply they miss
(1 - t (1 - q))^TREES, 1 pair in 175,000 at 0.85 and 1 in 2,800 at 0.80, but for what
pivots link; a group's other links make up for most of these. Only leaf pairs whose signatures
agree in too few places (4.4 deviations) are not looked at. Links are decided
on full sets, ``100 |A & B| >= 85 |A | B|``, and only as many are emitted as
connect a leaf's members. Signatures, tokens and nodes are shuffled; texts are
read again only for vertices that share a leaf with a likely partner.

Null and empty texts, and texts without words, have empty sets, are linked with
nothing and have their own doc_id as component. Rows with equal sets are in one
component, repeated doc_ids too. A null doc_id never names a component unless
all its rows lack one. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift.llm import common, components, words

SHINGLE = 5
PERCENT = 85
TOKENS = 64
TREES = 8
STEP = 3
FORKS = 3
PIVOTS = 4
LEAF = 1_000
BLOCK_VALUES = 1_000_000
SEPARATORS = words.separators("space")
_MULTIPLY = np.array([common.seed64("minwise", i) | 1 for i in range(TOKENS)], dtype=np.uint64)


def agreeing(percent: int) -> int:
    """Signature places that must agree for a pair to be worth a look."""
    s = percent / 100
    return math.floor(TOKENS * s - 4.4 * math.sqrt(TOKENS * s * (1 - s)))


def signature(shingles: np.ndarray) -> bytes:
    low = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = np.multiply.outer(_MULTIPLY, shingles[at:at + 4096])
        low = np.minimum(low, part.min(axis=1))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(column: pa.Array):
    lens = np.diff(words.column_bytes(column)[1])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(np.cumsum(lens[at:]), 8_000_000)) + at)
        yield from words.shingle_sets(*words.word_hashes(column.slice(at, to - at), SEPARATORS), SHINGLE)
        at = to


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       text.alias("text"))


def sketch(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text_key, n_shingles, key, sig`` of every row, stored."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            n, keys, sigs = [], [], []
            for s in _sets(b.column(2)):
                n.append(len(s))
                keys.append(_key(s) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, type=pa.int64()), pa.array(keys, type=pa.binary()),
                 pa.array(sigs, type=pa.binary())], names=["doc_id", "text_key", "n_shingles", "key", "sig"])

    out = _texts(docs).mapInArrow(common.released(run), "doc_id long, text_key long, n_shingles long, key binary, sig binary")
    return common.store(out.withColumn("row", F.monotonically_increasing_id()), "sketch")


def vertices(sketched: DataFrame) -> DataFrame:
    """One row per distinct set: ``sid, doc_id, text_key, n_shingles, key, sig``."""
    first = F.min(F.struct(F.col("row").alias("sid"), "doc_id", "text_key", "n_shingles", "sig")).alias("v")
    return common.store(sketched.where(F.col("key").isNotNull()).groupBy("key").agg(first).select("v.*", "key"), "vertices")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sid, sig, shingles`` (packed) for the vertices in ``wanted(sid, doc_id, text_key, key, sig)``."""
    def run(batches):
        for b in batches:
            sets = list(_sets(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(s) for s in sets], type=pa.binary()),
                 pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["key", "shingles"])

    rows, need = _texts(docs), wanted.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).hint("merge")
    rows = rows.join(need, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = rows.mapInArrow(common.released(run), "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    return wanted.select("sid", "key", "sig").hint("merge").join(sets, "key").select("sid", "sig", "shingles")


def _unpacked(batches):
    for b in batches:
        sets = [np.frombuffer(x, "<i8") for x in b.column(2).to_pylist()]
        members = pa.array(sets, type=pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), members], names=["sid", "sig", "members"])


def _token(sig: str, place: Column | int) -> Column:
    if isinstance(place, int):
        place = F.lit(place)
    return F.substring(F.col(sig), place * 4 + 1, F.lit(4))


def _child(fork: int) -> Column:
    """The child of ``node`` that a member's ``sig`` goes to: ``STEP`` different places
    that the node chooses, and the values there."""
    first, apart = F.xxhash64("node", F.lit(-1 - fork)), 1 + F.pmod(F.xxhash64("node", F.lit(fork)), F.lit(TOKENS // STEP))
    values = [_token("sig", F.pmod(first + k * apart, F.lit(TOKENS)).cast("int")) for k in range(STEP)]
    return F.xxhash64("node", F.lit(fork), *values)


def _nodes(rows: DataFrame) -> DataFrame:
    """Nodes of two or more members, one of those with the same members, that
    aren't all linked to one pivot: ``node, size``."""
    stats = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("sid")).alias("x"),
        F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"),
        (F.count("linked") == F.count(F.lit(1))).alias("all_linked"),
        (F.min("linked") == F.max("linked")).alias("alike"))
    open_ = stats.where((F.col("size") > 1) & ~(F.col("all_linked") & F.coalesce("alike", F.lit(False))))
    return open_.groupBy("size", "x", "y").agg(F.min("node").alias("node")).select("node", "size")


def grow(docs: DataFrame, verts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grow all trees: likely groups ``(grp, sid)`` of their leaves, links ``(a, b)``
    to pivots, and the full sets of all vertices in either.

    Texts are read again once, for the vertices that have a likely partner in a
    leaf at a root or are in a larger node."""
    spark = docs.sparkSession
    places = [common.seed64("root", i) % TOKENS for i in range(64)]
    places = list(dict.fromkeys(places))[:TREES]
    root = F.explode(F.array(*[F.xxhash64(F.lit(i), _token("sig", p)) for i, p in enumerate(places)]))
    rows = verts.select("sid", root.alias("node")).withColumn("linked", F.lit(None).cast("long"))
    level = common.store(rows.join(_nodes(rows), "node"), "paths")
    groups = likely(level.where(F.col("size") <= LEAF).select("node", "sid"), verts, percent)
    large = level.where(F.col("size") > LEAF).select("node", "sid", "linked")
    wanted = groups.select("sid").unionByName(large.select("sid")).hint("merge")
    sets = common.store(full_sets(docs, verts.join(wanted, "sid", "left_semi")), "sets")
    leaves, links, hot = [], [spark.createDataFrame([], "a long, b long")], None
    # a link needs distance <= far; beyond two such steps nothing can link
    far = 1 - percent / 100
    while not large.isEmpty():
        if hot is None:
            packed = sets.join(large.select("sid"), "sid", "left_semi").select("sid", "sig", "shingles")
            hot = common.store(packed.mapInArrow(common.released(_unpacked), "sid long, sig binary, members array<long>"), "hot-sets")
        picks = [F.min_by("sid", F.struct(F.col("linked").isNotNull(), F.xxhash64("node", "sid", F.lit(i)))) for i in range(PIVOTS)]
        pivots = large.groupBy("node").agg(F.array(*picks).alias("p")).select("node", F.explode(F.array_distinct("p")).alias("sid"))
        pivots = (pivots.join(hot, "sid").groupBy("node")
                  .agg(F.collect_list(F.struct(F.col("sid").alias("pivot"), "members")).alias("p")))        # PIVOTS at most

        def close(x: Column, y: Column) -> Column:
            shared = F.size(F.array_intersect(x, y))
            return shared * 100 >= (F.size(x) + F.size(y) - shared) * percent

        # each pivot with the lower ones that it is linked to
        pivots = pivots.select("node", F.transform("p", lambda x: F.struct(x["pivot"].alias("pivot"), x["members"].alias("members"), F.transform(
            F.filter("p", lambda y: (y["pivot"] < x["pivot"]) & close(x["members"], y["members"])), lambda y: y["pivot"]).alias("near"))).alias("pivots"))

        def test(p: Column) -> Column:
            shared = F.size(F.array_intersect(F.col("members"), p["members"]))
            return F.struct(p["pivot"].alias("pivot"), p["near"].alias("near"), shared.alias("shared"),
                            (F.size(F.col("members")) + F.size(p["members"]) - shared).alias("union"))

        met = (large.join(hot, "sid").join(pivots, "node").select("node", "sid", "linked", "sig", F.transform("pivots", test).alias("t"))
               .withColumn("t", F.transform("t", lambda x: F.struct(
                   x["pivot"].alias("pivot"), x["near"].alias("near"), (1 - x["shared"] / x["union"]).alias("distance"),
                   (x["shared"] * 100 >= x["union"] * percent).alias("close")))))
        met = common.store(met, "pivots")
        # a link to a pivot goes without saying beside one to a lower pivot it is linked to
        new = F.filter("t", lambda x: x["close"] & (x["pivot"] != F.col("sid")) & ~F.exists(
            "t", lambda y: y["close"] & F.array_contains(x["near"], y["pivot"])))
        links.append(met.select(F.explode(F.transform(new, lambda x: x["pivot"])).alias("a"), F.col("sid").alias("b")))
        # by place: a node's members list its pivots in one order
        apart = [F.min(F.when(~F.get("t", i)["close"], F.get("t", i)["distance"])) for i in range(PIVOTS)]
        edge = met.groupBy("node").agg(F.array(*apart).alias("nearest"))
        # done: a pivot, and a member linked to one that no link leads away from
        done = F.exists(F.transform("t", lambda x, i: (x["pivot"] == F.col("sid")) | x["close"] & F.coalesce(
            x["distance"] + far + 1e-9 < F.get("nearest", i), F.lit(True))), lambda x: x)
        rest = met.join(edge, "node").where(~done)
        to = F.array_min(F.transform(F.filter("t", lambda x: x["close"]), lambda x: x["pivot"]))
        rows = rest.select(F.explode(F.array(*[_child(j) for j in range(FORKS)])).alias("node"), "sid",
                           F.coalesce(to, "linked").alias("linked"))
        rows = common.store(rows, "children")
        level = common.store(rows.join(_nodes(rows), "node"), "paths")
        leaves.append(level.where(F.col("size") <= LEAF).select("node", "sid"))
        large = level.where(F.col("size") > LEAF).select("node", "sid", "linked")
    if leaves:
        groups = groups.unionByName(likely(reduce(DataFrame.unionByName, leaves), verts, percent)).distinct()
    return groups, reduce(DataFrame.unionByName, links), sets


def _runs(batches, n_columns: int):
    """Consecutive rows with equal first column, joined over batch ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        node = batch.column(0).to_numpy()
        cut = np.flatnonzero(np.diff(node))
        if held[0].column(0)[0].as_py() == node[-1]:
            continue
        whole = pa.Table.from_batches([*held[:-1], batch.slice(0, int(cut[-1]) + 1 if len(cut) else 0)]).combine_chunks()
        rest = batch.slice(int(cut[-1]) + 1 if len(cut) else 0)
        held = [rest] if rest.num_rows else []
        yield from _split(whole, n_columns)
    if held:
        yield from _split(pa.Table.from_batches(held).combine_chunks(), n_columns)


def _split(t: pa.Table, n_columns: int):
    if not t.num_rows:
        return
    columns = [t.column(i).chunk(0) for i in range(n_columns)]
    node = columns[0].to_numpy()
    edges = np.append(0, np.flatnonzero(np.diff(node)) + 1)
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(node)).tolist()):
        yield [c.slice(a, b - a) for c in columns]


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def agreement(s: np.ndarray) -> np.ndarray:
    """In how many places each two signatures agree; 0 with itself."""
    n = len(s)
    out = np.zeros((n, n), dtype=np.int8)
    for place in range(TOKENS):
        out += s[:, place][:, None] == s[:, place][None, :]
    np.fill_diagonal(out, 0)
    return out


def shared_counts(sets_: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sorted sets: products of their incidence
    tables, over ranges of values that hold some BLOCK_VALUES members together."""
    n, total = len(sets_), sum(map(len, sets_))
    shared, width = np.zeros((n, n)), 4096
    blocks = -(-total // BLOCK_VALUES) or 1
    edges = [k * (1 << 64) // blocks for k in range(1, blocks)]   # values are hashes: ranges of a size hold alike many
    cuts = np.stack([np.concatenate([[0], np.searchsorted(x, np.array(edges, dtype=np.uint64)), [len(x)]]) for x in sets_]).astype(np.int64)
    for k in range(blocks):
        parts = [x[a:b] for x, a, b in zip(sets_, cuts[:, k].tolist(), cuts[:, k + 1].tolist())]
        member = np.repeat(np.arange(n), cuts[:, k + 1] - cuts[:, k])
        _, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        use = times[column] > 1
        _, column = np.unique(column[use], return_inverse=True)
        order = np.argsort(column, kind="stable")
        column, member = column[order], member[use][order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            u, v = np.searchsorted(column, [lo, lo + width])
            grid = np.zeros((n, width), dtype=np.float32)
            grid[member[u:v], column[u:v] - lo] = 1
            shared += grid @ grid.T
    return shared


def likely(leaf: DataFrame, verts: DataFrame, percent: int) -> DataFrame:
    """``grp, sid``: members of leaves, in groups that agreeing signatures connect."""
    least = agreeing(percent)

    def run(batches):
        out: list[tuple[int, int]] = []
        for _, sid, sig in _runs(batches, 3):
            s = np.frombuffer(b"".join(sig.to_pylist()), "<u4").reshape(len(sid), TOKENS)
            ids = sid.to_numpy()
            forest = Forest(len(ids))
            pairs = components.connecting(agreement(s) >= least, np.arange(len(ids)), len(ids))
            for i, j in pairs:
                forest.join(i, j)
            if not pairs:
                continue
            groups: dict[int, list[int]] = {}
            for i, x in enumerate(ids.tolist()):
                groups.setdefault(forest.find(i), []).append(x)
            for members in groups.values():
                if len(members) > 1:
                    members.sort()
                    name = int.from_bytes(hashlib.blake2b(np.array(members).tobytes(), digest_size=8).digest(),
                                          "little", signed=True)
                    out += [(name, m) for m in members]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out]), pa.array([m for _, m in out])], names=["grp", "sid"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out]), pa.array([m for _, m in out])], names=["grp", "sid"])

    rows = leaf.hint("merge").join(verts.select("sid", "sig"), "sid").select("node", "sid", "sig")
    rows = rows.repartition(common.shuffle_partitions(leaf.sparkSession), "node").sortWithinPartitions("node", "sid")
    return common.store(rows.mapInArrow(common.released(run), "grp long, sid long").distinct(), "groups")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def confirm(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` on full sets, as few as connect each group's members."""
    def run(batches):
        a, b = [], []
        for _, sid, packed in _runs(batches, 3):
            ids = sid.to_pylist()
            sets_ = [np.frombuffer(p, "<u8") for p in packed.to_pylist()]
            size = np.array([len(x) for x in sets_])
            if len(ids) == 2:
                shared = np.array([[0, _shared(*sets_)], [0, 0]])
            else:
                shared = shared_counts(sets_)
            linked = shared * 100 >= (size[:, None] + size[None, :] - shared) * percent
            linked[np.tril_indices(len(ids))] = False
            for i, j in components.connecting(linked, np.arange(len(ids)), len(ids)):
                a.append(ids[i])
                b.append(ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    rows = groups.hint("merge").join(sets, "sid").select("grp", "sid", "shingles")
    rows = rows.repartition(common.shuffle_partitions(groups.sparkSession), "grp").sortWithinPartitions("grp", "sid")
    return rows.mapInArrow(common.released(run), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id, text_key, n_shingles, component, component_id, kept``."""
    sketched = sketch(docs)
    verts = vertices(sketched)
    groups, pivot_links, sets = grow(docs, verts, percent)
    links = confirm(groups, sets, percent).unionByName(pivot_links)
    found = components.connected_components(links)
    of_set = (verts.select("sid", "key").join(found.withColumnRenamed("id", "sid").hint("merge"), "sid", "left")
              .select("key", F.coalesce("component", "sid").alias("component")))
    rows = (sketched.select("row", "doc_id", "text_key", "n_shingles", "key").join(of_set.hint("merge"), "key", "left")
            .select("doc_id", "text_key", "n_shingles", F.coalesce("component", F.col("row")).alias("component")))
    rows = common.store(rows, "classes")
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (rows.join(least, "component")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``: the smallest doc_id's (of rows that
    share it, the one of smallest text hash; of equal rows any). Rows with empty
    sets all stay, but for repeats of a doc_id with the same text."""
    found = near_duplicates(docs, percent).where("kept")
    keep = (found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("k"))
            .select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key")).distinct())
    same = (F.xxhash64(F.col("text").cast("string")) == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    return docs.join(keep, same, "left_semi").dropDuplicates(["doc_id", "text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's component."""
    return (near_duplicates(common.table(spark, sf_dir, "documents"))
            .select("doc_id", "n_shingles", "component_id", "kept"))
