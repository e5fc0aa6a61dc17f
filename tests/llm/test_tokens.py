import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factsift.llm import packing, token_store, tokens

from .conftest import LONG, TEXTS

PATH = tokens.public_tokenizer()
ENCODER = tokens.WordEncoder(PATH)
LIBRARY = Tokenizer.from_file(PATH)     # a fresh one, as anybody loads it


def direct(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab'.,!5 é\n\tĠ日 <|>", max_size=40), st.text(max_size=20),
                         st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "hello", "<|", "é"]), max_size=8).map("".join)), max_size=6))
def test_words_put_together_equal_the_library(texts):
    ids, offsets = ENCODER.encode(pa.array(texts, type=pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [direct(t) for t in texts]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_BYTES", 500)
    e = tokens.WordEncoder(PATH)
    assert direct("hello <|endoftext|> world")[:4] == [31373, 220, 50256, 995]
    for t in ["a b c d e f g", "a b c x", "<|endoftext|> x<|endoftext|>"] * 2:
        assert e.encode(pa.array([t]))[0].tolist() == direct(t)


@pytest.mark.parametrize("plane", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 200])
def test_planes_and_shard_round_trip(plane, n):
    rng = np.random.default_rng(n)
    docs = [rng.integers(0, 50_257, k, dtype=np.uint32) for k in ([1, 0, n, 3] if n else [])]
    out = io.BytesIO()
    w = token_store.ShardWriter(out, block=16, plane=plane)
    if docs:
        w.add(np.arange(4), np.array([True, False, True, True]), np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs])))
    assert w.close() == len(docs)
    r = token_store.ShardReader(out, out.tell())
    assert [d.tolist() for d in r.documents()] == [d.tolist() for d in docs]
    flat = np.concatenate(docs) if docs else np.empty(0)
    for a in range(0, len(flat), 5):
        assert r.ids(a, min(len(flat), a + 37)).tolist() == flat[a:a + 37].tolist()


def test_files_hold_every_row_in_order(spark, awkward, nothing):
    manifest, _ = token_store.token_files(spark, awkward)
    got = token_store.read_documents(manifest).orderBy("start").collect()
    assert len(got) == len(TEXTS)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    start = 0
    for r in got:
        ids = np.array(direct(dict(TEXTS)[r.doc_id]), dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.read_documents(token_store.token_files(spark, nothing)[0]).count() == 0


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by)


def test_packing_is_whole_and_tight(spark, awkward, nothing):
    rows = packing.pack(awkward, size=1024).collect()
    n = check_packing(rows, 1024)
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1
    long_ids = direct(LONG)
    own = sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.piece)
    assert sum(r.length for r in own) == len(long_ids) and all(r.length == 1024 for r in own[1:])
    for r in own:
        part = np.array(long_ids[r.start:r.start + r.length], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
    assert sum(r.doc_id == 8 for r in rows) == 2
    assert packing.pack(nothing).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=12))
def test_plan_places_every_piece_once(histogram):
    frame, n_seq = packing.plan(histogram, 32)
    room = {}
    for length, group in frame.groupby("length"):
        at = 0
        for f in group.itertuples():
            assert f.first == at
            at = f.last
            for k in range(f.last - f.first):
                room.setdefault(f.sequence + k, []).append((f.offset, length))
        assert at == histogram[length]
    assert len(room) == n_seq and set(frame["length"]) == set(histogram)
    for members in room.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 32
