"""Vectorised work on the UTF-8 bytes of whole batches of texts.

Texts of a batch lie behind one another in one buffer, so words, hashes of
words and hashes of word runs come from a few numpy passes without a loop over
texts or words. All separators in use are ASCII, which never occur inside the
bytes of another character, so cutting bytes is the same as cutting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 2 * BLOCK_BYTES), _BASE)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers[:n]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of blocks of rows.

    Null reads as empty. ``offsets`` has one entry more than there are rows.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi
    pa.default_memory_pool().release_unused()


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every ``[^\\x20\\x09-\\x0D]+`` word, and the first word of
    each row with one entry more for the end."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    span = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data))
    place[: starts[0]] = 0
    place[starts[0] :] -= np.repeat(starts, span)
    value = _BYTE[data] * powers(int(span.max()) + 1)[place]
    # Bytes after a word, up to the next one, count for nothing.
    value[starts[0] :][place[starts[0] :] >= np.repeat(ends - starts, span)] = 0
    return mix64(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i + k - 1 for every i; rows must be kept apart by the caller."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weight = powers(k + 1)
    total = words[:n] * weight[1]
    for j in range(1, k):
        total += words[j : j + n] * weight[j + 1]
    return mix64(total)
