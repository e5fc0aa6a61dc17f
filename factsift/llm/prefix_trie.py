"""Conversation prefix trie by composable fingerprints (operator 11).

A turn is the map ``x -> a x + b`` modulo 2^64 (twice, with ``a`` odd and both
taken from a 128-bit hash of role and text); a sequence of turns is the
composition of their maps. Compositions are associative and have inverses, so
the fingerprint of any rebuilt prefix is put together from stored ones::

    head of the base . (own first h turns)^-1 . own first p turns

without building a rebuilt text or even its list of turns. Steps:

1. turns are range-sorted by (conv_id, turn, ...), so that a long conversation
   spreads over tasks; each task scans its rows' compositions, and one row a
   partition carries them on into the next (a table of one row a partition);
2. one row a conversation holds its length, its own first h turns' composition
   and, for a base, that of its first heads (five at most);
3. each rebuilt position becomes a key (node), its parent's key and a reference
   to its turn; nodes are aggregated by key;
4. verification: all members of a node must have one parent, one depth and one
   turn reference, and all turns of one reference one role and text (compared as
   text). By induction from the root a node then holds equal sequences only.
   Should anything differ, all is redone with other hashes;
5. sums over subtrees by pointer doubling among nodes of two or more members (a
   node of one member tops a plain path: one leaf, nothing saved), so a chain of
   d turns takes log2(d) rounds, each an equi join and a partial sum;
6. the ids that end at a node are hashed in order: range-sorted pieces first,
   then one running hash a node, which holds a piece at a time.

Every group is combined before its shuffle; a first turn that a third of all
conversations share is a row a task. Each step is stored in the shared folder.

Turns are ordered by ``turn`` (null first), equal turns by role, then by a hash
of the text; repeated rows are repeated turns; null roles and texts are empty.
Texts may be of any length. Rows without a conv_id are in no conversation and
are left out. Conversations of no rebuilt turn end at the root. An empty table
has no nodes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift.llm import common
from factsift.llm.words import mix

BASE_EVERY = 100              # conversation c starts as conversation c - c % BASE_EVERY does
HEADS = 6                     # h = crc32(c) % HEADS
ENDS_BYTES = 1 << 16          # size of a piece of joined ids
_LANES = ("a1", "b1", "a2", "b2")
_SALTS = [np.uint64(common.seed64("trie", i)) for i in range(4)]


# ---- compositions; a map is (a, b), an array of maps a pair of uint64 arrays ----

def compose(first, then):
    """``first``, then ``then``."""
    return first[0] * then[0], first[1] * then[0] + then[1]


def inverse(m):
    x = m[0].copy()           # right to three bits for an odd number; each step doubles them
    for _ in range(5):
        x = x * (np.uint64(2) - m[0] * x)
    return x, np.uint64(0) - m[1] * x


def turn_maps(r1: np.ndarray, r2: np.ndarray):
    """Both lanes' maps of turns with the references ``(r1, r2)``."""
    return [(mix(r1 ^ _SALTS[2 * i]) | np.uint64(1), mix(r2 ^ _SALTS[2 * i + 1])) for i in (0, 1)]


def node_key(lanes) -> list[np.ndarray]:
    return [mix(mix(a) + b) for a, b in lanes]


def scan(lanes, fresh: np.ndarray):
    """Running compositions from each row with ``fresh`` on (in place by doubling)."""
    n = len(fresh)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    at = np.arange(n) - begin
    out = [(a.copy(), b.copy()) for a, b in lanes]
    k = 1
    while n and k <= int(at.max()):
        rows = np.flatnonzero(at >= k)
        out = [(_put(a, rows, c), _put(b, rows, d)) for (a, b), (c, d) in
               ((m, compose((m[0][rows - k], m[1][rows - k]), (m[0][rows], m[1][rows]))) for m in out)]
        k *= 2
    return out, at


def _put(values: np.ndarray, rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    values = values.copy()
    values[rows] = new
    return values


def _u(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _s(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _lanes(batch: pa.RecordBatch, prefix: str = ""):
    a1, b1, a2, b2 = (_u(batch, prefix + x) for x in _LANES)
    return [(a1, b1), (a2, b2)]


def _columns(lanes) -> list[pa.Array]:
    return [_s(x) for lane in lanes for x in lane]


_MAP = ", ".join(f"{x} long" for x in _LANES)


# ---- 1: positions and running compositions ---------------------------------

def turn_table(conversations: DataFrame, seed: int) -> DataFrame:
    """``conv_id, turn, role, text, r1, r2``: turns with their references."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("*", F.xxhash64(F.lit(2 * seed), "role", "text").alias("r1"),
                       F.xxhash64(F.lit(2 * seed + 1), "role", "text").alias("r2"))


def _scanned(batches):
    """Positions and compositions from each conversation's first row in this partition on."""
    part = TaskContext.get().partitionId()
    last, count, carry = None, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        maps = turn_maps(_u(batch, "r1"), _u(batch, "r2"))
        out, at = scan(maps, np.diff(conv, prepend=conv[0] - 1) != 0)
        pos = at + 1
        if last is not None and conv[0] == last:  # the batch begins inside a conversation
            head = np.flatnonzero(conv == last)
            pos[head] += count
            out = [(_put(m[0], head, c[0]), _put(m[1], head, c[1])) for m, c in
                   ((m, compose(k, (m[0][head], m[1][head]))) for m, k in zip(out, carry))]
        last, count = conv[-1], int(pos[-1])
        carry = [(a[-1:].copy(), b[-1:].copy()) for a, b in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, dtype=np.int32)), batch.column(0), pa.array(pos), batch.column(4), batch.column(5),
             batch.column(6), *_columns(out)], names=["part", "conv_id", "pos", "r1", "r2", "n", *_LANES])


_SCANNED = f"part int, conv_id long, pos long, r1 long, r2 long, n int, {_MAP}"


def _carries(scanned: DataFrame) -> dict[int, tuple]:
    """What each partition takes over of its first conversation: ``conv_id, rows,
    composition``. One row a partition comes to the driver."""
    ends = scanned.groupBy("part").agg(F.min("conv_id").alias("first"),
                                       F.max(F.struct("conv_id", "pos", *_LANES)).alias("last")).collect()
    out, conv, count, maps = {}, None, 0, None
    for row in sorted(ends, key=lambda r: r.part):
        own = [np.array([row.last[x]], dtype=np.int64).view(np.uint64) for x in _LANES]
        own, rows = [(own[0], own[1]), (own[2], own[3])], row.last.pos
        if conv == row.first:
            out[row.part] = (conv, count, maps)
            if row.last.conv_id == conv:
                own, rows = [compose(a, b) for a, b in zip(maps, own)], rows + count
        conv, count, maps = row.last.conv_id, rows, own
    return out


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1)``, r1, r2, n`` and the composition of all turns up to it."""
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("r1"), F.col("r2")]
    thin = turns.select("conv_id", "turn", "role", F.lit(0).alias("_"), "r1", "r2", F.char_length("text").alias("n"))
    scanned = common.store(thin.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_scanned, _SCANNED), "trie-turns")
    carries = _carries(scanned)

    def carried(batches):
        for batch in batches:
            part, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            pos, maps = batch.column(2).to_numpy().copy(), _lanes(batch)
            for p in np.unique(part).tolist():
                if p in carries:
                    first, count, before = carries[p]
                    rows = np.flatnonzero((part == p) & (conv == first))
                    pos[rows] += count
                    maps = [(_put(m[0], rows, c[0]), _put(m[1], rows, c[1])) for m, c in
                            ((m, compose(b, (m[0][rows], m[1][rows]))) for m, b in zip(maps, before))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pos), *batch.columns[3:6], *_columns(maps)],
                                             names=["conv_id", "pos", "r1", "r2", "n", *_LANES])

    return scanned.mapInArrow(carried, f"conv_id long, pos long, r1 long, r2 long, n int, {_MAP}")


# ---- 2 and 3: rebuilt positions --------------------------------------------

def _frames(turns: DataFrame) -> DataFrame:
    """One row a conversation: ``h``, its head's references, lengths and keys, and the
    map that leads from its own compositions to the rebuilt ones."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    is_base = F.col("conv_id") % BASE_EVERY == 0
    turn = F.struct("pos", "r1", "r2", "n", *_LANES)
    convs = turns.groupBy("conv_id").agg(
        F.max("pos").alias("len"), F.max(F.when(F.col("pos") == h, turn)).alias("own"),
        F.collect_list(F.when(is_base & (F.col("pos") < HEADS), turn)).alias("heads"))  # five at most
    convs = common.store(convs, "trie-conversations")
    bases = convs.where(is_base).select(F.col("conv_id").alias("base"), F.array_sort("heads").alias("base_heads"))
    own = convs.select("conv_id", h.alias("h"), "len", "own", (F.col("conv_id") - F.col("conv_id") % BASE_EVERY).alias("base"))
    return own.join(bases, "base", "left").select(
        "conv_id", "h", "len", "own", F.slice(F.coalesce("base_heads", F.array().cast(bases.schema["base_heads"].dataType)),
                                              F.lit(1), F.col("h").cast("int")).alias("head"))


_STEP = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, r1 long, r2 long, n int, ends boolean"
_STEP_NAMES = [c.split()[0] for c in _STEP.split(", ")]
_IDENTITY = [(np.ones(1, dtype=np.uint64), np.zeros(1, dtype=np.uint64))] * 2
ROOT = [int(k.view(np.int64)[0]) for k in node_key(_IDENTITY)]


def _steps(conv, depth, lanes, r1, r2, n, ends) -> pa.RecordBatch:
    keys = node_key(lanes)
    back = [compose(m, inverse(t)) for m, t in zip(lanes, turn_maps(r1, r2))]
    parents = node_key(back)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv), pa.array(depth), _s(keys[0]), _s(keys[1]), _s(parents[0]), _s(parents[1]), _s(r1), _s(r2),
         pa.array(n, type=pa.int32()), pa.array(ends)], names=_STEP_NAMES)


def _heads(batches):
    """The root and the head positions of each conversation."""
    for batch in batches:
        count = batch.num_rows
        conv, h, size = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        lists = batch.column(4)
        taken = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        total = taken + np.maximum(size - h, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv), pa.array(np.zeros(count, dtype=np.int64)), *(pa.array(np.full(count, k)) for k in ROOT),
             *(pa.nulls(count, pa.int64()) for _ in range(4)), pa.array(np.zeros(count, dtype=np.int32)), pa.array(total == 0)],
            names=_STEP_NAMES)
        if taken.sum():
            flat = pa.RecordBatch.from_struct_array(lists.flatten())
            whose = np.repeat(np.arange(count), taken)
            depth = np.arange(len(whose)) - np.repeat(np.cumsum(taken) - taken, taken) + 1
            yield _steps(conv[whose], depth, _lanes(flat), _u(flat, "r1"), _u(flat, "r2"),
                         flat.column(flat.schema.get_field_index("n")).to_numpy(), depth == total[whose])


def _shift(batches):
    """``conv_id, h, total, shift`` and the map from own to rebuilt compositions."""
    for batch in batches:
        count = batch.num_rows
        lists, own = batch.column(4), pa.RecordBatch.from_struct_array(batch.column(3).fill_null(
            dict.fromkeys(("pos", "r1", "r2", "n", *_LANES), 0) | {"a1": 1, "a2": 1}))
        taken = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        top = [(np.ones(count, dtype=np.uint64), np.zeros(count, dtype=np.uint64)) for _ in range(2)]
        some = np.flatnonzero(taken)
        if len(some):
            flat = pa.RecordBatch.from_struct_array(lists.flatten())
            last = np.cumsum(taken)[some] - 1
            top = [(_put(t[0], some, m[0][last]), _put(t[1], some, m[1][last])) for t, m in zip(top, _lanes(flat))]
        maps = [compose(t, inverse(m)) for t, m in zip(top, _lanes(own))]
        h = batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(taken - h), pa.array(batch.column(2).to_numpy() + taken - h), *_columns(maps)],
            names=["conv_id", "h", "shift", "total", *("f" + x for x in _LANES)])


def _tails(batches):
    """Own positions behind the head."""
    for batch in batches:
        get = {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema.names) if f in ("conv_id", "pos", "n", "shift", "total")}
        lanes = [compose(f, m) for f, m in zip(_lanes(batch, "f"), _lanes(batch))]
        depth = get["pos"] + get["shift"]
        yield _steps(get["conv_id"], depth, lanes, _u(batch, "r1"), _u(batch, "r2"), get["n"], depth == get["total"])


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every position of every rebuilt conversation, the root included."""
    frames = common.store(_frames(turns), "trie-frames")
    shifts = frames.where("len > h").mapInArrow(
        _shift, "conv_id long, h long, shift long, total long, " + ", ".join(f"f{x} long" for x in _LANES))
    tails = turns.join(shifts, "conv_id").where("pos > h").mapInArrow(_tails, _STEP)
    return frames.mapInArrow(_heads, _STEP).unionByName(tails)


# ---- 4: nodes, verified ----------------------------------------------------

def _nodes(steps: DataFrame) -> DataFrame:
    one = [F.min(c).eqNullSafe(F.max(c)) for c in ("depth", "p1", "p2", "r1", "r2")]
    equal = one[0]
    for c in one[1:]:
        equal = equal & c
    return steps.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.min("n").alias("n"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count_if("ends").alias("n_ends"),
        F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("end"), equal.alias("equal"))


def _texts_equal(turns: DataFrame) -> bool:
    """Whether all turns of one reference have one role and text. Only references
    that occur more than once send their texts, once a task."""
    shared = turns.groupBy("r1", "r2").count().where("count > 1").select("r1", "r2")
    said = turns.join(shared, ["r1", "r2"], "left_semi")
    both = F.struct("role", "text")
    return said.groupBy("r1", "r2").agg((F.min(both) != F.max(both)).alias("differ")).where("differ").isEmpty()


# ---- 5: sums over subtrees -------------------------------------------------

def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """``k1, k2, leaves, saved`` of nodes with ``p1, p2`` (null at the root), ``depth``
    and their own share of both sums.

    Round k: a node's sums cover descendants nearer than 2^k, and ``p`` is its
    ancestor at distance 2^k (null: none). Sums go to that ancestor, and
    pointers double.
    """
    state = common.store(nodes, "trie-sums")
    deepest = state.agg(F.max("depth").alias("d")).first().d or 0
    step = 1
    while step <= deepest:
        below = state.where(F.col("p1").isNotNull())
        gains = below.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        summed = state.join(gains, ["k1", "k2"], "left").select(
            "k1", "k2", "p1", "p2", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        # only nodes deep enough to have an ancestor at twice the distance look it up
        far = F.col("depth") >= 2 * step
        up = state.where(F.col("depth") >= step).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                                                        F.col("p1").alias("g1"), F.col("p2").alias("g2"))
        near = summed.where(~far).withColumn("p1", F.lit(None).cast("long")).withColumn("p2", F.lit(None).cast("long"))
        lifted = summed.where(far).join(up, ["p1", "p2"]).select(
            "k1", "k2", F.col("g1").alias("p1"), F.col("g2").alias("p2"), "depth", "leaves", "saved")
        state = common.store(lifted.unionByName(near) if 2 * step <= deepest else summed, "trie-sums")
        step *= 2
    return state.select("k1", "k2", "leaves", "saved")


# ---- 6: ids that end at a node ---------------------------------------------

def _pieces(batches):
    """Sorted ``k1, k2, conv_id`` to pieces ``k1, k2, first, ids``."""
    key, first, held, size = None, None, [], 0
    out = []

    def flush():
        nonlocal held, size
        if held:
            out.append((*key, first, ",".join(held)))
        held, size = [], 0

    def emit():
        rows = pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "first", "ids"), r)) for r in out],
                                          pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))
        out.clear()
        return rows

    for batch in batches:
        for a, b, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (a, b) != key or size > ENDS_BYTES:
                flush()
                key, first = (a, b), conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        if len(out) > 100:
            yield emit()
    flush()
    yield emit()


def _digests(batches):
    """Pieces in order to one hash a node."""
    key, state = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (a, b) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield _digest_rows(done)
    yield _digest_rows([(*key, state.hexdigest())] if key is not None else [])


def _digest_rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "digest"), r)) for r in rows],
                                      pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("digest", pa.string())]))


def _end_digests(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``k1, k2, digest`` of nodes where two or more conversations end."""
    many = nodes.where("n_ends > 1").select("k1", "k2")
    ends = steps.where("ends").select("k1", "k2", "conv_id").join(many, ["k1", "k2"], "left_semi")
    pieces = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(
        _pieces, "k1 long, k2 long, first long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(
        _digests, "k1 long, k2 long, digest string")


# ---- the operator ----------------------------------------------------------

def trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations; see the module."""
    common.prepare(conversations.sparkSession)
    seed = 0
    while True:
        turns = turn_table(conversations, seed)
        steps = common.store(rebuilt(numbered(turns)), "trie-steps")
        nodes = common.store(_nodes(steps), "trie-nodes")
        if nodes.where("NOT equal").isEmpty() and _texts_equal(turns):
            break
        seed += 1             # two sequences or texts fell together
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    full = nodes.join(children, ["k1", "k2"], "left").na.fill(0, ["n_children", "single"])
    shared = full.where("n_convs > 1").select(
        "k1", "k2", "p1", "p2", "depth", (F.col("single") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    sums = _subtree_sums(shared)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    digest = (F.when(F.col("n_ends") == 0, F.lit(none)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256))
              .otherwise(F.col("digest")))
    return (full.join(sums, ["k1", "k2"], "left").join(_end_digests(steps, nodes), ["k1", "k2"], "left")
            .join(parents, ["p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                    F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
                    digest.alias("ends_sha256")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all nodes of the trie of rebuilt conversations."""
    return trie(common.table(spark, sf_dir, "conversations"))


# crc32 of a decimal number: eight shifts a byte, in lists
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]), "
        "lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295::BIGINT)")

SQL = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT c, {_CRC} % {HEADS} AS h, c - c % {BASE_EVERY} AS base FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT c.c, t.pos, t.role, t.text, 0 AS own FROM c JOIN t ON t.c = c.base AND t.pos <= c.h
  UNION ALL SELECT c.c, t.pos, t.role, t.text, 1 FROM c JOIN t ON t.c = c.c AND t.pos > c.h
), p AS (
  SELECT c, row_number() OVER w AS depth, length(text) AS n,
         string_agg(sha256(length(role)::VARCHAR || ' ' || role || text), '') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
), s AS (SELECT c, depth, n, path FROM p UNION ALL SELECT c, 0, 0, '' FROM c),
l AS (SELECT c, max(depth) AS len FROM s GROUP BY c),
n AS (
  SELECT path, min(c) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(n) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = len), '')) AS ends_sha256
  FROM s JOIN l USING (c) GROUP BY path
), k AS (SELECT path[:-65] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (
  SELECT path[:64 * d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY ALL
)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (path) LEFT JOIN n q ON f.depth > 0 AND q.path = f.path[:-65]
"""
