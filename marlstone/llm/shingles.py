"""Word shingles of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import lowered

#: Words per shingle.
WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_random = np.random.Generator(np.random.PCG64(2024))
_BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: all bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(2 * CHUNK, n)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (np.uint64(_BASE), np.uint64(_INVERSE))]
    return _powers[0][:n], _powers[1]


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one, a hash of each word of each text, where each word starts and ends, and how many words each text has."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _tables(len(raw))
    sums = np.cumsum(_BYTES[raw] * power)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mixed((sums[ends - 1] - before) * inverse[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return joined, hashes, starts, ends, np.diff(np.searchsorted(starts, bounds), prepend=0)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of each text, and how many words each text has."""
    _, hashes, _, _, counts = word_spans(texts)
    return hashes, counts


def chunks(texts: list[str | None]):
    """(first index, encoded texts): runs of about CHUNK bytes."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = lowered(t)
        held.append(b)
        size += len(b)
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, sorted within each text and with repeats, and how many each text has.

    A text of one to four words has one shingle of all its words; a text without words has none.
    """
    words, counts = word_hashes(texts)
    n = np.maximum(counts - (WORDS - 1), np.minimum(counts, 1))
    if not len(words):
        return words, n
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    total = np.zeros(len(words), np.uint64)
    for j in range(WORDS):
        total += padded[j : j + len(words)] * _PLACES[j]
    ends = np.cumsum(counts)
    starts = ends - counts
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        a, b = starts[i], ends[i]
        total[a] = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
    offsets = np.cumsum(n) - n
    at = np.repeat(starts - offsets, n) + np.arange(n.sum())
    out = mixed(total[at])
    for a, k in zip(offsets, n, strict=True):
        out[a : a + k].sort()
    return out, n
