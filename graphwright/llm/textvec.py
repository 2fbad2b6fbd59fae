"""Vectorised word and shingle hashing over Arrow text columns.

Texts are handled as UTF-8 bytes, a run of documents at a time, so that the
cost is a few numpy passes per byte and no Python object per word.  A word is
a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased
before hashing.  Hashes are 64 bits wide, stable across processes and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step works on; bounds the scratch memory (about 40 bytes a byte).
STEP_BYTES = 1 << 20

_SEED = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), out of place."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_SEED) + np.uint64(seed))


_EXACT = stream(11, 256)
_FOLDED = _EXACT[_LOWER]
_BASE = 0xD6E8FEB86659FD93
_PLACES = stream(12, 64) | np.uint64(1)
_SHORT = stream(13, 16)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def _both_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for the bytes of one step."""
    global _UP, _DOWN
    if not len(_UP):
        _UP, _DOWN = _powers(_BASE, STEP_BYTES + 1), _powers(pow(_BASE, -1, 1 << 64), STEP_BYTES + 1)
    return _UP, _DOWN


def _long_word(values: np.ndarray) -> np.uint64:
    """The polynomial of a word longer than a step."""
    up, _ = _both_powers()
    total, ahead, step = 0, 1, pow(_BASE, STEP_BYTES, 1 << 64)
    for at in range(0, len(values), STEP_BYTES):
        part = values[at : at + STEP_BYTES]
        total = (total + int((part * up[: len(part)]).sum(dtype=np.uint64)) * ahead) % (1 << 64)
        ahead = ahead * step % (1 << 64)
    return np.uint64(total)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def runs(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `step` bytes, each of one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per document the range of its words (n + 1 offsets)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_word = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased if `fold`: a polynomial of its bytes by prefix sums, then mixed."""
    values = _FOLDED if fold else _EXACT
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + STEP_BYTES, "right")))
        at = starts[lo]
        part = data[at : ends[hi - 1]]
        if len(part) > STEP_BYTES:
            out[lo] = _long_word(values[part])
            lo = hi
            continue
        up, down = _both_powers()
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = (sums[e] - sums[s]) * down[s]
        lo = hi
    return mix(out)


def shingle_hashes(words: np.ndarray, word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-word window and per document the range of its windows.

    A document of 1 to k - 1 words has one window, its whole sequence; one
    without words has none.
    """
    counts = np.diff(word_offsets)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(offsets[-1], np.uint64)
    if len(words) >= k:
        full = words[: len(words) - k + 1] * _PLACES[0]
        for i in range(1, k):
            full += words[i : len(words) - k + 1 + i] * _PLACES[i]
        doc = np.repeat(np.arange(len(counts)), counts)
        inside = doc[: len(words) - k + 1] == doc[k - 1 :]
        long_rows = np.repeat(counts >= k, made)
        out[long_rows] = full[inside]
    for n in range(1, k):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            at = word_offsets[rows]
            whole = np.full(len(rows), _SHORT[n])
            for i in range(n):
                whole += words[at + i] * _PLACES[i]
            out[offsets[rows]] = whole
    return mix(out), offsets
