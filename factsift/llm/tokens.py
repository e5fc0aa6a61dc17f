"""Fast exact encoding of text columns with the ``tokenizers`` library.

A byte-level BPE cuts text into pieces before merging, and a single space that
is followed by a non-space always starts a new piece. So a text's ids are its
first word's ids followed by those of `` word`` for each later word. Each
distinct word is encoded by the library once per worker (all words of a batch
that are not known yet go through it as one string; a token that starts with
the space byte marks the next word), and texts are put together from the known
words with numpy. Texts with other white space after a space, and texts that
hold one of the tokenizer's added tokens (``<|endoftext|>``), go through the
library whole. The result equals ``Tokenizer.encode`` id for id. Texts of any
length are encoded whole, in slices of rows of SLICE_BYTES (one row at least).
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 12_000_000      # text encoded at once
KNOWN_BYTES = 64_000_000      # memory of known words before a worker starts afresh
WORD_BYTES = 160              # what a known word takes besides its characters
JOIN_CHARS = 200_000          # characters given to the library at once
END_ID = 2
# what follows a space that does not simply start the next word
_ODD = r"^(?:[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]|$)"


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes string columns to one flat id array and row offsets."""

    def __init__(self, path: str, end_id: int | None = END_ID):
        self.tok = load_tokenizer(path)
        self.end = [] if end_id is None else [end_id]
        self.added = sorted(t.content for t in self.tok.get_added_tokens_decoder().values() if t.content)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.spaced[i] = token.startswith("Ġ")
        self._forget()

    def _forget(self) -> None:
        """Start with no known words; their ids lie in one pool, by slot."""
        self.words: dict[str, int] = {}
        self.pool = np.empty(1 << 20, dtype=np.uint32)
        self.start = np.empty(1 << 18, dtype=np.int64)
        self.size = np.empty(1 << 18, dtype=np.int64)
        self.filled = self.slots = self.known_bytes = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Put consecutive runs of ids into the pool; the first one's slot."""
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.slots + len(sizes) > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.size = np.concatenate([self.size, np.empty_like(self.size)])
        self.pool[self.filled:self.filled + len(ids)] = ids
        at = self.slots
        self.size[at:at + len(sizes)] = sizes
        self.start[at:at + len(sizes)] = self.filled + np.cumsum(sizes) - sizes
        self.filled += len(ids)
        self.slots += len(sizes)
        return at

    def _learn(self, words: list[str]) -> int:
        """Slots (consecutive, from the returned one) of `` word`` for each word."""
        ids, sizes = [], []
        at = 0
        while at < len(words):
            to, chars = at, 0
            while to < len(words) and (to == at or chars < JOIN_CHARS):
                chars += len(words[to]) + 1
                to += 1
            got = self._ids(" " + " ".join(words[at:to]))
            starts = np.flatnonzero(self.spaced[got])
            if len(starts) == to - at:
                ids.append(got)
                sizes.append(np.diff(starts, append=len(got)))
            else:  # cannot be told apart: one by one
                each = [self._ids(" " + w) for w in words[at:to]]
                ids += each
                sizes.append(np.array([len(x) for x in each]))
            at = to
        return self._add(np.concatenate(ids), np.concatenate(sizes)) if ids else self.slots

    def _slots(self, words: list[str]) -> np.ndarray:
        """Slots of `` word`` for distinct words without a space in them."""
        known = self.words
        slots = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(slots < 0)
        if not len(new):
            return slots
        names = [words[i] for i in new.tolist()]
        slots[new] = np.arange(len(names)) + self._learn(names)
        known.update(zip(names, slots[new].tolist()))
        self.known_bytes += WORD_BYTES * len(names) + sum(map(len, names))
        return slots

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of a sequence of slots."""
        size = self.size[slots]
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return np.empty(0, dtype=np.uint32)
        out = np.empty(int(ends[-1]), dtype=np.uint32)
        for at in range(0, len(slots), 500_000):
            s, e = size[at:at + 500_000], ends[at:at + 500_000]
            lo = int(e[0] - s[0])
            out[lo:e[-1]] = self.pool[np.repeat(self.start[slots[at:at + 500_000]] - (e - s) + lo, s)
                                      + np.arange(e[-1] - lo)]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (null is empty), each with the end id, and row offsets."""
        if self.known_bytes > KNOWN_BYTES:
            self._forget()
        column = column.fill_null("") if column.null_count else column
        n = len(column)
        if n == 0:
            return np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        parts = pc.split_pattern(column, " ")
        begin = parts.offsets.to_numpy().astype(np.int64)
        begin -= begin[0]
        coded = parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        heads = coded.dictionary.take(pa.array(index[begin[:-1]])).to_pylist()
        later = np.ones(len(index), dtype=bool)
        later[begin[:-1]] = False
        odd = pc.match_substring_regex(coded.dictionary, _ODD).to_numpy(zero_copy_only=False)
        strange = odd[index] & later
        for token in self.added:
            strange |= pc.match_substring(coded.dictionary, token).to_numpy(zero_copy_only=False)[index]
        if any(" " in token for token in self.added):
            held = [pc.match_substring(column, t).to_numpy(zero_copy_only=False) for t in self.added if " " in t]
            strange[begin[:-1]] |= np.logical_or.reduce(held)
        rows = np.unique(np.searchsorted(begin, np.flatnonzero(strange), side="right") - 1)
        whole = {r: column[r].as_py() for r in rows.tolist()}
        if whole:  # these rows keep only a first word, and that is the whole text
            keep = np.ones(len(index), dtype=bool)
            for r in whole:
                keep[begin[r] + 1:begin[r + 1]] = False
            index, later = index[keep], later[keep]
            begin = np.append(0, np.cumsum(np.add.reduceat(keep, begin[:-1])))
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[index[later]] = True
        names = np.flatnonzero(used)
        slot = np.zeros(len(used), dtype=np.int64)
        slot[names] = self._slots(coded.dictionary.take(pa.array(names)).to_pylist())
        kept_slots, kept_ids = self.slots, self.filled
        index = slot[index]
        # a text's first word has no space before it; it and the end id go to
        # slots that are given back afterwards
        first = self.tok.encode_batch_fast([whole.get(r, h) for r, h in enumerate(heads)], add_special_tokens=False)
        first = [e.ids for e in first] + [self.end]
        sizes = np.array([len(x) for x in first], dtype=np.int64)
        at = self._add(np.fromiter(chain.from_iterable(first), dtype=np.uint32, count=int(sizes.sum())), sizes)
        index[begin[:-1]] = at + np.arange(n)
        index = np.insert(index, begin[1:], at + n)
        ids = self._gather(index)
        ends = np.append(0, np.cumsum(self.size[index]))
        self.slots, self.filled = kept_slots, kept_ids
        return ids, ends[begin + np.arange(n + 1)]


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, end_id: int | None = END_ID) -> WordEncoder:
    """The worker's encoder (its known words outlive a task)."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, end_id)
    return _ENCODERS[key]


def slices(column: pa.Array, size: int = SLICE_BYTES):
    """Row ranges of at most ``size`` bytes of text (one row at least)."""
    lens = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lens)
    at = 0
    while at < len(lens):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
