import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from factsift.llm import lexical_search as S
from tests.oracle_check import compare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items):
    bags = [(i, split(t)) for i, t in docs]
    bags = [(i, len(t), Counter(t)) for i, t in bags if t]
    n_docs, n_terms = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, n, bag in bags:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                    for t in terms if t in bag)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:S.TOP])]
    return sorted(out, key=str)


def run(spark, docs, items, parts=3):
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, key string, score int, rank int").repartition(parts)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in S.search(d, q).collect()), key=str)


@pytest.mark.parametrize("leaf,rows", [(4, 64), (48, 8192)])
def test_equals_brute_force(spark, monkeypatch, leaf, rows):
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "BLOCK_DOCS", rows)
    pick = random.Random(leaf)
    common = [f"w{int(pick.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(pick.randrange(900), " ".join(pick.choices(common, k=pick.choice([1, 5, 30, 200])))) for _ in range(700)]
    docs += [(1000 + i, "w1 w2 W3-w4 é") for i in range(300)]                  # a group of copies
    docs += [(None, "w1 w2 w7"), (None, "w1 w2 w7"), (5, None), (6, ""), (7, " ;"), (8, "w1 w9 " * 30_000)]
    items = [(i, " ".join(pick.choices(common, k=12))) for i in range(25)]
    items += [(25, None), (26, ""), (27, "absent words"), (28, "w1 É"), (28, "w2 é"), (None, "w1 w1 w5")]
    assert run(spark, docs, items) == brute(docs, items)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ITEM_TERMS", 3)
    docs = [(i, f"a b{i % 3} c{i % 5}") for i in range(80)]
    items = [(i, f"b{i} c{i} zz") for i in range(5)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == run(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_hold_and_prune():
    pick = np.random.default_rng(3)
    n, v = 4000, 400
    size = pick.integers(1, 20, n)
    # four languages of 100 terms each, as documents have them
    rows = [np.unique((pick.pareto(0.7, s) * 3).astype(np.int64) % 100 + 100 * (i % 4)) for i, s in enumerate(size)]
    start = np.append(0, np.cumsum([len(r) for r in rows]))
    term = np.concatenate(rows)
    tf = pick.integers(1, 9, len(term))
    df = np.bincount(term, minlength=v)
    rank = np.argsort(np.argsort(-df, kind="stable"), kind="stable")
    block = S.Block(start, term, tf, pick.integers(50, 300, n), rank)
    assert sorted(block.order.tolist()) == list(range(n))
    weights = np.array([max(0, math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1)))) for d in df.tolist()])
    terms = np.sort(pick.choice(100, 10, replace=False))
    weight_of = np.zeros(v, dtype=np.int64)
    weight_of[terms] = weights[terms]
    scores = block.scores(0, n, weight_of)
    bound = block.bounds(terms, weights[terms])
    for i, (a, b) in enumerate(zip(block.low.tolist(), block.high.tolist())):
        assert scores[a:b].max() <= bound[i]
        assert not len(block.children[i]) or block.low[block.children[i]].min() == a and block.high[block.children[i]].max() == b
    best = S.Best()
    none = np.zeros(n, dtype=bool)
    seen = S.search_block(block, np.arange(n), none, terms, weights[terms], weight_of, best)
    assert best.score.tolist() == sorted(scores.tolist(), reverse=True)[:S.TOP] and seen < n / 3


def test_query_matches_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", ["op13_fp_tree_search"])["op13_fp_tree_search"]["hash"]
