import contextlib
import hashlib
import os
import re
import threading

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factsift.llm import common, components, license_scan, minhash_paths, suffix_decontam, vector_graph, words
from factsift.session import checkpoint_root

from .conftest import LONG, TEXTS

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPLIT = {"space": re.compile(r"[^\x20\x09-\x0D]+"), "alnum": re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def split(text, kind):
    return SPLIT[kind].findall((text or "").translate(LOWER))


@pytest.mark.parametrize("kind", ["space", "alnum"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="aAbé 1.\n日-", max_size=30)), max_size=8))
def test_word_hashes_equal_words(kind, texts):
    for size in (4, words.SEGMENT_BYTES):
        old, words.SEGMENT_BYTES = words.SEGMENT_BYTES, size
        try:
            flat, offsets = words.word_hashes(pa.array(texts, type=pa.string()), words.separators(kind))
        finally:
            words.SEGMENT_BYTES = old
        want = [split(t, kind) for t in texts]
        assert np.diff(offsets).tolist() == [len(w) for w in want]
        names = [x for w in want for x in w]
        assert len({(n, int(h)) for n, h in zip(names, flat)}) == len(set(names)) == len(set(flat.tolist()))


def shingles(text):
    w = split(text, "space")
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(texts, percent=85):
    sets = [(i, shingles(t)) for i, t in texts]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1:]
             if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return classes([i for i, _ in sets], pairs)


def near_copies(n, base=120, seed=5):
    """Copies of one text with some words changed, and strangers that share a passage."""
    rng = np.random.default_rng(seed)
    origin = [f"o{i}" for i in range(base)]
    out = []
    for i in range(n):
        w = list(origin)
        for k in rng.integers(0, base, rng.integers(0, 6)):
            w[k] = f"e{rng.integers(0, 1_000_000)}"
        out.append((i, " ".join(w)))
    for i in range(n, n + 20):
        out.append((i, " ".join([*origin[:12], *(f"s{rng.integers(0, 10_000)}" for _ in range(80))])))
    return out


def test_chosen_paths_equals_brute_force_below_leaves(spark, monkeypatch):
    monkeypatch.setattr(minhash_paths, "LEAF", 12)     # grow trees, pivots and levels
    texts = near_copies(90)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in minhash_paths.near_duplicates(docs).collect()}
    want = brute(texts)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(shingles(dict(texts)[i])) for i, r in got.items())


def test_dense_group_is_done_by_its_pivot(spark, monkeypatch):
    monkeypatch.setattr(minhash_paths, "LEAF", 12)
    texts = [(i, LONG[:6000] + f" end{i}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    verts = minhash_paths.vertices(minhash_paths.sketch(docs))
    groups, link, _ = minhash_paths.grow(docs, verts, 85)
    # each tree links the whole group to a pivot and is done: no leaves, no pairs
    assert groups.count() == 0 and link.count() <= 59 * minhash_paths.TREES
    assert components.connected_components(link).select("component").distinct().count() == 1


def test_loosely_alike_group_is_parted_in_few_levels(spark, monkeypatch):
    """Texts that share half their shingles: a row meets few nodes before leaves hold it."""
    monkeypatch.setattr(minhash_paths, "LEAF", 30)
    rng = np.random.default_rng(3)
    shared = [f"o{i}" for i in range(110)]
    texts = [(i, " ".join([*shared, *(f"s{rng.integers(0, 10_000)}" for _ in range(50))])) for i in range(100)]
    texts += [(i + 100, t + " end") for i, t in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    made, store = [], minhash_paths.common.store

    def counted(df, name):
        out = store(df, name)
        made.extend([(name, out.count())] if name == "paths" else [])
        return out

    monkeypatch.setattr(minhash_paths.common, "store", counted)
    got = {r.doc_id: r.component_id for r in minhash_paths.near_duplicates(docs).collect()}
    assert got == {i: i % 100 for i, _ in texts}
    assert len(made) <= 6 and sum(n for _, n in made) <= 20 * len(texts)


def test_awkward_rows_have_components(spark, awkward, nothing):
    rows = minhash_paths.near_duplicates(awkward).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=str)
    n = len(shingles(TEXTS[0][1]))
    assert [r for r in got if r[0] in (1, 2, None)] == [(1, n, 1, True), (2, n, 1, False), (None, n, 1, False)]
    assert {r[2:] for r in got if r[0] in (3, 4)} == {(3, True), (4, True)}
    assert {r[2] for r in got if r[0] in (5, 8)} == {5} and {r[2] for r in got if r[0] in (6, 7)} == {6}
    assert len(rows) == len(TEXTS)
    kept = minhash_paths.deduplicate(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 9]
    assert minhash_paths.near_duplicates(nothing).count() == 0 and minhash_paths.deduplicate(nothing).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(31)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- suffix arrays --------------------------------------------------------------
def hits(text, items, window):
    w = split(text, "alnum")
    hit, names = [False] * len(w), set()
    for name, t in items:
        v = split(t, "alnum")
        k = min(window, len(v))
        if not k:
            continue
        for s in range(len(v) - k + 1):
            for p in range(len(w) - k + 1):
                if w[p:p + k] == v[s:s + k]:
                    hit[p:p + k] = [True] * k
                    names.add("null" if name is None else str(name))
    return len(w), sum(hit), sorted(names)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=30), min_size=1, max_size=5), st.lists(st.text(alphabet="ab ", max_size=14), max_size=4))
def test_suffix_array_equals_brute_force(texts, items):
    named = list(enumerate(items))
    h, o = words.word_hashes(pa.array(items, type=pa.string()), suffix_decontam.SEPARATORS)
    block = suffix_decontam.Block([str(i) for i, _ in named], h, o, 3)
    h, o = words.word_hashes(pa.array(texts, type=pa.string()), suffix_decontam.SEPARATORS)
    n_hit, (doc, item, s, p, n) = suffix_decontam.scan_shard(h, o, [block])
    for k, t in enumerate(texts):
        want = hits(t, named, 3)
        assert (int(n_hit[k]), sorted(set(item[doc == k]))) == (want[1], want[2])
    found = sorted((int(k), int(name), int(a), int(b), int(size)) for k, name, a, b, size in zip(doc, item, s, p, n))
    assert found == longest(texts, items, 3)


def longest(texts, items, window):
    out = []
    for k, t in enumerate(texts):
        w = split(t, "alnum")
        for i, x in enumerate(items):
            v = split(x, "alnum")
            for a in range(len(v)):
                for b in range(len(w)):
                    if a and b and v[a - 1] == w[b - 1]:
                        continue
                    n = 0
                    while a + n < len(v) and b + n < len(w) and v[a + n] == w[b + n]:
                        n += 1
                    if n >= min(window, len(v)):
                        out.append((k, i, a, b, n))
    return sorted(out)


def test_repeated_words_and_many_blocks_keep_memory_low():
    """A word 20,000 times in a document and 800 times in an item; five blocks, one at a time."""
    import tracemalloc
    h, o = words.word_hashes(pa.array(["la " * 800], type=pa.string()), suffix_decontam.SEPARATORS)
    alive = []

    def blocks():
        for k in range(5):
            alive.append(k)
            yield suffix_decontam.Block([str(k)], h, o, 10)

    dh, do = words.word_hashes(pa.array(["la " * 20_000, "la " * 9], type=pa.string()), suffix_decontam.SEPARATORS)
    tracemalloc.start()
    n_hit, (doc, item, s, p, n) = suffix_decontam.scan_shard(dh, do, blocks())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n_hit.tolist() == [20_000, 0] and alive == [0, 1, 2, 3, 4] and set(doc.tolist()) == {0}
    # a longest match a diagonal: 20,000 + 800 - 1 of them, less those under ten words
    assert len(n) == 5 * (20_000 + 800 - 1 - 2 * 9) and n.max() == 800 and peak < 100_000_000


def test_decontamination_report(spark, awkward, nothing, monkeypatch):
    items = [(1, "brown fox jumps over the lazy dog near the river bank"), (2, "ONE two, three"), (None, "one two three"), (4, None),
             (5, ""), (2, "One two three"), (6, LONG[-400:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(suffix_decontam, "SHARD_WORDS", 20)
    got = suffix_decontam.report(awkward, bench).collect()
    assert len(got) == len(TEXTS)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0))):
        if len(t or "") < 1000:
            n, k, names = hits(t, items, 10)
            assert (r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) == (i, n, k, len(names), k > 0)
            assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        else:
            assert r.contaminated and {m.item_id for m in r.matches} == {"6"}
    clean = suffix_decontam.decontaminate(awkward, bench)
    assert clean.columns == awkward.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == [3, 4, 9]
    assert suffix_decontam.decontaminate(awkward, bench.limit(0)).count() == len(TEXTS)
    assert suffix_decontam.report(nothing, bench).count() == 0


# ---- vectors ----------------------------------------------------------------------
def brute_vectors(rows, threshold=0.93):
    use = []
    for i, e, label in rows:
        if label is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        x = np.array(e, dtype=np.float32).astype(float)
        use.append((i, x / np.linalg.norm(x), label))
    n, pairs = {i: 0 for i, _, _ in rows}, []
    for k, (a, x, la) in enumerate(use):
        for b, y, lb in use[k + 1:]:
            if la == lb and len(x) == len(y) and x @ y >= threshold:
                n[a] += 1
                n[b] += 1
                pairs.append((a, b))
    return n, classes([i for i, _, _ in rows], pairs)


@pytest.mark.parametrize("cap", [4000, 40])
def test_vector_graph_equals_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(vector_graph, "CAP", cap)
    monkeypatch.setattr(vector_graph, "TARGET", max(10, cap // 3))
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.03 * rng.normal(size=16)).tolist(), 1) for i in range(100)]
    rows += [(100 + i, rng.normal(size=16).tolist(), i % 2) for i in range(100)]
    rows += [(200 + i, [2 * x for x in rows[100 + i][1]], rows[100 + i][2]) for i in range(10)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, rows[0][1], None),
             (305, [None] + [1.0] * 15, 1), (306, rows[0][1], 1), (307, rows[0][1][:8], 1), (308, [float("inf")] * 16, 0)]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, node long, sid string")
    got = {r.vec_id: r for r in vector_graph.near_duplicates(vectors).collect()}
    n, comp = brute_vectors(rows)
    assert {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == comp
    if cap == 4000:
        assert vector_graph.audit(vectors, vector_graph.near_duplicates(vectors)) >= 0.9
        assert vector_graph.near_duplicates(vectors.limit(0)).count() == 0


def sparse_vectors(n, pairs, seed=11, size=64):
    """Strangers, and pairs of cosine 0.93 to 0.96."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=(pairs, size))
    other -= (other * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = rng.uniform(0.9301, 0.96, size=(pairs, 1))
    x[n - pairs:] = cos * x[:pairs] + np.sqrt(1 - cos ** 2) * other
    return x


def test_sparse_links_survive_deep_cuts(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "CAP", 60)
    monkeypatch.setattr(vector_graph, "TARGET", 45)
    x = sparse_vectors(2000, 500).astype(np.float32).astype(float)
    sims = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(sims, 0)
    vectors = spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = vector_graph.near_duplicates(vectors)
    assert {r.vec_id: r.n_links for r in found.collect()} == dict(enumerate((sims >= 0.93).sum(axis=1).tolist()))


@pytest.mark.parametrize("together", [1, 3])
def test_units_and_rounds_equal_brute_force(spark, monkeypatch, together):
    """Cells cut within a unit, cells uncut and larger than one, units of several trees and rounds."""
    for name, value in (("CAP", 40), ("TARGET", 15), ("TOGETHER", together), ("ROUND_ROWS", 0)):
        monkeypatch.setattr(vector_graph, name, value)
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.05 * rng.normal(size=16)).tolist(), i % 2) for i in range(260)]
    rows += [(260 + i, rng.normal(size=16).tolist(), 1) for i in range(200)]
    rows += [(460 + i, rows[255 + i][1], 1) for i in range(20)]
    rows += [(480, [0.0] + [1.0] * 15, 1), (481, [-0.0] + [1.0] * 15, 1), (482, [1.0] * 8, 1), (483, [2.0] * 8, 1), (484, None, 1)]
    vectors = spark.createDataFrame([r for r in rows], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vector_graph.near_duplicates(vectors).collect()}
    n, comp = brute_vectors(rows)
    assert {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == comp


def test_disk_stays_a_few_times_the_vectors(spark, monkeypatch):
    """Scratch tables and shuffle files, at their peak; each vector has 27 cells here."""
    for name, value in (("CAP", 60), ("TARGET", 45), ("ROUND_ROWS", 0)):
        monkeypatch.setattr(vector_graph, name, value, raising=False)
    x = sparse_vectors(3000, 300).astype(np.float32)
    vectors = spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(x)], "vec_id long, embedding array<float>, label int")
    common.prepare(spark)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [checkpoint_root(spark).removeprefix("file:"), *disk.localDirsString()]

    def used():
        total = 0
        for top in folders:
            for at, _, names in os.walk(top):
                for name in names:
                    with contextlib.suppress(OSError):
                        total += os.lstat(os.path.join(at, name)).st_size
        return total

    start, most, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            most[0] = max(most[0], used() - start)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        links = {r.vec_id: r.n_links for r in vector_graph.near_duplicates(vectors).collect()}
    finally:
        over.set()
        watcher.join()
    assert sum(links.values()) == 600
    assert 0 < most[0] < 4 * x.nbytes


def test_cuts_meet_their_bound():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    lost = np.ones(len(a), dtype=bool)
    for tree in range(vector_graph.TREES):
        alone = np.zeros(len(a), dtype=bool)
        for depth in range(2):
            u, v = vector_graph.nearest(a, tree, depth), vector_graph.nearest(b, tree, depth)
            apart = ~(u[:, :, None] == v[:, None, :]).any(axis=(1, 2))
            assert apart.mean() <= 1.25 * vector_graph.MISS
            alone |= apart
        lost &= alone
    assert lost.mean() <= 2e-4


# ---- licenses -----------------------------------------------------------------------
def test_licenses(spark, awkward, nothing):
    body = "some words before it and many more words that go on "
    rows = [(i, body + text, name) for i, (name, text) in enumerate(license_scan.TEMPLATES)]
    rows += [(100, "Released under the MIT License", "mit"), (101, "released UNDER the mit license, really", "mit"), (102, None, ""),
             (103, "", ""), (104, "MIT License", ""), (105, body * 3000 + "Licensed under CC BY-NC 4.0." + body * 3000, "cc-by-nc-4.0"),
             (105, "Released under the MIT License", "mit"), (None, "Released under the MIT License", "mit")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license string, template long")
    got = sorted((str(r.doc_id), r.licenses) for r in license_scan.report(docs).collect())
    assert got == sorted((str(i), name) for i, _, name in rows)
    assert {r.licenses for r in license_scan.report(awkward).collect()} == {""}
    assert license_scan.report(nothing).count() == 0


def test_other_terms_of_a_family_are_reported(spark):
    by, sa = "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International Licence."
    gpl = "This work is licensed under the GNU General Public License, version "
    rows = [(1, f"{by} and the rest: {sa}", "cc-by-4.0,cc-by-sa-4.0"), (2, f"some {gpl}2.", "gpl-2.0"),
            (3, f"{gpl}2. or {gpl}3.", "gpl-2.0,gpl-3.0"), (4, f"only {sa}", "cc-by-sa-4.0")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_licenses) for r in license_scan.report(docs).collect()}
    assert got == {i: (names, names.count(",") + 1) for i, _, names in rows}


def test_license_twin_on_mixed_notices(spark):
    """Texts of several notices, some with a word changed, as the SQL reads them."""
    rng = np.random.default_rng(3)
    texts = [t for _, t in license_scan.TEMPLATES]
    rows = []
    for i in range(150):
        parts = [texts[k].split() for k in rng.integers(0, len(texts), rng.integers(0, 4))]
        for p in parts:
            if rng.random() < 0.5:
                p[rng.integers(0, len(p))] = "other"
        rows.append((i, " and ".join(map(" ".join, parts))))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    got = license_scan.report(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").toPandas()
    connection = duckdb.connect()
    connection.register("documents", documents)
    want = connection.execute(f"SELECT * FROM ({license_scan.SQL}) ORDER BY doc_id").df()
    assert got.values.tolist() == want[got.columns].values.tolist() and got.licenses.str.contains(",").sum() > 10


def test_license_bands_meet_their_bound():
    assert (1 - 1 / license_scan.STRIDE) ** license_scan.BANDS <= license_scan.MISS
