"""Words and word shingles of Arrow string columns, by numpy over the raw UTF-8 bytes.

Words are runs of anything but space and the control characters 9 to 13; A-Z count as a-z.
All of these are single bytes in UTF-8, so the bytes need no decoding. A word's hash mixes its
blocks of eight bytes, each with its place, so words of up to eight bytes and of one length never
share a hash; a shingle's hash mixes the hashes of its words. ``exact_sets`` uses no hash at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
SLICE_BYTES = 1 << 20
SLICE_ROWS = 512
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Of eight bytes, the first k.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return raw[lo:hi], offsets - lo


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and SLICE_ROWS rows each; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, a + SLICE_ROWS, max(a + 1, b))
        yield a, b
        a = b


def words_at(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_IS_SPACE[raw]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    ends = np.append(~solid[1:] | first[1:n], True) & solid
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    folded = np.zeros(n + 8, dtype=np.uint8)
    folded[:n] = _FOLD[raw]
    block = np.ndarray(n + 1, dtype="<u8", buffer=folded.data, strides=(1,))
    size = e - s
    h = scramble(block[s] & _FIRST[np.minimum(size, 8)])
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        first = np.cumsum(more) - more
        k = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        x = block[np.repeat(s[long], more) + 8 * k] & _FIRST[np.minimum(np.repeat(size[long], more) - 8 * k, 8)]
        h[long] += np.add.reduceat(scramble(x ^ scramble(k.astype(np.uint64) * _U(_BASE))), first)
    return scramble(h + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), s, e


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each text the number of words before it (one entry more)."""
    h, s, _ = words_at(raw, offsets)
    return h, np.searchsorted(s, offsets)


#: Odd multipliers, one for each place of a word in a shingle.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 5-word shingles in order, with bounds; 1 to 4 words give one shingle."""
    counts = np.diff(bounds)
    many = np.maximum(counts - (SHINGLE - 1), (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(many)])
    if not len(words):
        return np.zeros(0, np.uint64), out
    turned = [w * p for w, p in ((words, p) for p in _PLACE)]
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(min(n, SHINGLE)):
        rolled[: n - k] += scramble(turned[k][k:] + _U(k))
    last = np.repeat(bounds[1:], counts)
    keep = np.arange(n) + SHINGLE <= last
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    for d in short:
        a, b = int(bounds[d]), int(bounds[d + 1])
        rolled[a] = _U((sum(int(scramble(turned[k][a + k : a + k + 1] + _U(k))[0]) for k in range(b - a)) + (b - a) * _BASE) & (2**64 - 1))
        keep[a] = True
    return scramble(rolled[keep]), out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, one after the other, with bounds."""
    h, bounds = shingle_hashes(*word_hashes(raw, offsets))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), dtype=bool)
    if len(h):
        fresh[1:] = h[1:] != h[:-1]
        heads = bounds[:-1][np.diff(bounds) > 0]
        fresh[heads] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return h[fresh], kept[bounds]


def exact_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, but numbers of the shingles themselves: equal in this call where the words are."""
    data = raw.tobytes().lower()  # of bytes, A-Z alone
    words: list[bytes] = []
    bounds = [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        words += data[a:b].split()
        bounds.append(len(words))
    number = {w: k for k, w in enumerate(dict.fromkeys(words), 1)}
    many = np.diff(bounds)
    row = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(words)) + (SHINGLE - 1) * row
    w = np.zeros(len(words) + (SHINGLE - 1) * len(many), dtype=np.int64)  # each text, then zeros
    w[at] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    base = len(number) + 1
    rank = lambda x: np.unique(x, return_inverse=True)[1]
    two = rank(w[:-1] * base + w[1:]) if len(w) > 1 else w
    four = rank(two[:-2] * len(w) + two[2:]) if len(w) > 3 else w
    left = np.repeat(np.array(bounds[1:]), many) - np.arange(len(words))
    head = (left >= SHINGLE) | ((left == many[row]) & (many[row] < SHINGLE))
    i = at[head]
    x, r = four[i] * base + w[i + SHINGLE - 1], row[head]
    order = np.lexsort((x, r))
    x, r = x[order], r[order]
    fresh = np.ones(len(x), dtype=bool)
    fresh[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    return x[fresh], np.searchsorted(r[fresh], np.arange(len(many) + 1))
