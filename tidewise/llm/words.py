"""Word hashing over Arrow batches of texts with numpy, without a Python loop
over words.

A batch's UTF-8 bytes are one array; a running sum of per-byte random values
times powers of an odd constant gives every word's 64-bit hash by difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = int(_RNG.integers(1, 2**62)) * 8 + 5
_BACK = pow(_STEP, -1, 2**64)
_GRAM = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        if n > 4 * SLICE_BYTES:  # one very long text: not kept
            return np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, base, np.uint64)]))
        size = max(n, SLICE_BYTES)
        have = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        _powers[base] = have
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES of text each."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def _runs(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None):
    """Starts and ends of the maximal runs of ``inside``, broken at texts'
    ends and wherever ``cut`` (a class per byte) changes."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if cut is not None:
        edge[1:n] |= cut[1:] != cut[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_runs(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(_BYTE[folded] * _power(_STEP, len(folded)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_BACK, len(folded) + 1)[starts])


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of non-blank bytes, A-Z lowered) and, per
    text, the offsets of its words."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    folded = LOWER[raw]
    starts, ends = _runs(~SPACE[folded], offsets)
    return _hash_runs(folded, starts, ends), np.searchsorted(starts, offsets)


_CLASS = np.full(256, 3, np.uint8)  # 0 blank, 1 letters (bytes over 127 too), 2 digits, 3 the rest
_CLASS[SPACE] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def token_hashes(raw: np.ndarray, offsets: np.ndarray):
    """Like ``word_hashes`` for tokens: runs of letters, of digits and of other
    signs are tokens of their own. Also gives each token's starts and ends."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), empty, empty
    kind = _CLASS[raw]
    starts, ends = _runs(kind > 0, offsets, kind)
    return _hash_runs(LOWER[raw], starts, ends), np.searchsorted(starts, offsets), starts, ends


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, over text borders too."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += words[k: k + m] * _GRAM[k]
    return mix(total)


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text. Fewer than n words
    are one shingle; no word gives an empty set."""
    for a, b in slices(texts):
        words, at = word_hashes(*buffers(texts.slice(a, b - a)))
        grams = gram_hashes(words, n)
        for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if e - s >= n:
                yield a + i, np.unique(grams[s: e - n + 1])
            elif e > s:
                short = int(np.sum(words[s:e] * _GRAM[8: 8 + e - s], dtype=np.uint64))
                yield a + i, mix(np.array([short ^ (e - s)], np.uint64))
            else:
                yield a + i, np.zeros(0, np.uint64)
