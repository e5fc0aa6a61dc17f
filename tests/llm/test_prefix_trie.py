import hashlib
import random
import zlib

import numpy as np

from factsift.llm import prefix_trie as P
from tests.oracle_check import compare

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 long"


def brute(rows):
    turns = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(int(c / 100) * 100, [])[:h] + own[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == node)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in P.trie(df).collect()), key=str)


def table(pick):
    rows = []
    for c in pick.sample(range(-150, 700), 300):
        for t in range(pick.choice([1, 1, 2, 4, 7, 9])):
            rows.append((c, t if pick.random() < 0.95 else None, pick.choice(["user", "assistant", None]),
                         pick.choice(["a", "b", "é!", "", None])))
    return rows


def test_equals_brute_force(spark, monkeypatch):
    pick = random.Random(5)
    monkeypatch.setattr(P, "ENDS_BYTES", 40)
    rows = table(pick)
    rows = [r for k, r in enumerate(rows) if (r[0], r[1], r[2]) not in {(x[0], x[1], x[2]) for x in rows[:k]}]  # ties: tested below
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1180) for t in range(8)]            # a group of copies
    rows += [(c, t, "user", f"long {t}") for c in (2000, 2007, 2008) for t in range(700)]           # long shared chains
    rows += [(3000 + i, t, "user", "same") for i in range(40) for t in range(i + 1)]               # each extends the one before
    rows += [(None, 0, "user", "lost"), (4000, 0, "user", "x" * 300_000), (4000, 1, None, None)]
    assert run(spark, rows) == brute(rows)


def test_repeated_and_tied_rows(spark):
    rows = [(0, 1, "user", "same")] * 3 + [(0, 0, "user", "q"), (0, 2, "a", "x"), (0, 2, "b", "y")]
    assert run(spark, rows, 1) == run(spark, rows[::-1], 4) == brute(rows)
    tied = [(0, 0, "user", x) for x in "abcdef"]
    assert run(spark, tied, 1) == run(spark, tied[::-1], 3)


def test_empty_table_and_turnless_conversations(spark):
    assert run(spark, []) == [] == run(spark, [(None, 0, "user", "x")])
    short = [(c, 0, "user", "x") for c in range(1, 60)]           # no base: those with h > 0 have no rebuilt turn
    assert run(spark, short) == brute(short)


def test_colliding_hashes_are_found_and_redone(spark, monkeypatch):
    rows = [(0, 0, "user", "a"), (1, 0, "user", "b"), (100, 0, "user", "a"), (100, 1, "user", "b"), (200, 0, "user", "b"), (200, 1, "user", "a")]
    rows += [(c + t, 0, "user", f"t{t}") for c in (300, 500) for t in range(100)]
    real, seeds = P.turn_table, []

    def weak(conversations, seed):
        seeds.append(seed)
        turns = real(conversations, seed)
        return turns if seed > 1 else turns.selectExpr("conv_id", "turn", "role", "text", "r1 % 2 AS r1", "0L AS r2")

    monkeypatch.setattr(P, "turn_table", weak)
    assert run(spark, rows) == brute(rows) and seeds == [0, 1, 2]


def test_compositions_are_associative_and_inverse():
    pick = np.random.default_rng(1)
    x, y, z = (P.turn_maps(*pick.integers(0, 2**63, (2, 50), dtype=np.uint64))[0] for _ in range(3))
    left, right = P.compose(P.compose(x, y), z), P.compose(x, P.compose(y, z))
    assert (left[0] == right[0]).all() and (left[1] == right[1]).all()
    one = P.compose(x, P.inverse(x))
    assert (one[0] == 1).all() and (one[1] == 0).all()


def test_query_matches_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", ["op11_prefix_trie"])["op11_prefix_trie"]["hash"]
