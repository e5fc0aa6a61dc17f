"""Vectorised word hashing of UTF-8 text columns (no per-word Python).

Words are the maximal runs of non-separator bytes after A-Z are lower-cased.
Both word definitions of this package only name ASCII separators, so working
on bytes equals working on characters. A word's 64-bit hash is a sum of random
byte values times powers of a random odd number, then mixed; equal words have
equal hashes on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from factsift.llm.common import seed64

_R = np.uint64(seed64("word", "base") | 1)
_BYTES = np.array([seed64("word", "byte", b) for b in range(256)], dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SEGMENT_BYTES = 1 << 22

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(pattern: str) -> np.ndarray:
    """Separator table: ``"space"`` (U+0020, U+0009-U+000D) or ``"alnum"``
    (everything in ASCII but 0-9, A-Z, a-z)."""
    sep = np.zeros(256, dtype=bool)
    if pattern == "space":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    else:
        sep[:0x80] = True
        for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            sep[lo:hi + 1] = False
    return sep


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _R, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _segment(data: np.ndarray, sep: np.ndarray, powers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and hash of every word of ``data``."""
    inside = ~sep[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    lens = ends - starts
    top = int(lens.max())
    if len(powers[0]) < top:
        powers[0] = _powers(max(top, 2 * len(powers[0])))
    values = _BYTES[LOWER[data[inside]]]
    begin = np.cumsum(lens) - lens
    values *= powers[0][np.arange(len(values)) - np.repeat(begin, lens)]
    return starts, mix(np.add.reduceat(values, begin) + lens.astype(np.uint64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset:]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, flat, and each row's offsets into them."""
    data, offsets = column_bytes(column)
    n = len(offsets) - 1
    hashes, counts, powers = [], np.zeros(n, dtype=np.int64), [_powers(64)]
    row = 0
    while row < n:
        # whole rows up to a segment's size; a longer row is cut at separators
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT_BYTES, side="right")) - 1)
        lo, hi = offsets[row], offsets[last]
        if last == row + 1:
            at = lo
            while at < hi:
                to = min(hi, at + SEGMENT_BYTES)
                while to < hi and not sep[data[to]]:
                    stop = data[to:to + 65536]
                    stop = stop[: hi - to]
                    found = np.flatnonzero(sep[stop])
                    to += int(found[0]) if len(found) else len(stop)
                _, h = _segment(data[at:to], sep, powers)
                hashes.append(h)
                counts[row] += len(h)
                at = to
        else:
            # rows are split from each other by a separator put between them
            lens = np.diff(offsets[row:last + 1])
            joined = np.full(hi - lo + (last - row), 0x20, dtype=np.uint8)
            joined[np.arange(hi - lo) + np.repeat(np.arange(last - row), lens)] = data[lo:hi]
            starts, h = _segment(joined, sep, powers)
            begin = offsets[row:last] - lo + np.arange(last - row)
            counts[row:last] = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
            hashes.append(h)
        row = last
    flat = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    return flat, np.concatenate([[0], np.cumsum(counts)])


_SHINGLE = [np.uint64(seed64("shingle", i) | 1) for i in range(16)]


def shingle_sets(words: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each row; a row of fewer
    words, but not none, has its whole sequence as one shingle."""
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        rolled += words[i:i + n] * _SHINGLE[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for i in range(b - a):
                short = np.uint64((int(short) + int(words[a + i]) * int(_SHINGLE[i + 8])) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
