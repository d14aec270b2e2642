"""Word and shingle hashes of batches of texts, vectorised over their bytes.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D`` after lower-casing A-Z; each gets a 64-bit hash. A document's
shingles are the hashes of its runs of ``k`` words, or of the whole sequence where it has fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_KEYS = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_STEPS = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(n: int) -> None:
    """Powers of the base and of its inverse modulo 2**64 up to ``n``, kept up to a few block sizes."""
    global _powers, _inverses
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, dtype=np.uint64)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE_INVERSE, dtype=np.uint64)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``BLOCK_BYTES`` bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin in them (with the end)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n = int(offsets[-1])
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    word = ~IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    _grown(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_KEYS[data] * _powers[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64) * _STEPS[40])
    if len(_powers) > 8 * BLOCK_BYTES:
        _release()
    return hashes, np.searchsorted(starts, offsets)


def _release() -> None:
    global _powers, _inverses
    _powers = _powers[:1].copy()
    _inverses = _inverses[:1].copy()


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in blocks(texts):
        hashes, at = word_hashes(texts[a:b])
        if len(hashes) >= k:
            runs = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
            for j in range(k):
                runs += hashes[j : len(hashes) - k + 1 + j] * _STEPS[j]
            runs = mix(runs)
        for i in range(b - a):
            s, e = int(at[i]), int(at[i + 1])
            if e - s >= k:
                yield np.unique(runs[s : e - k + 1])
            elif e > s:
                yield mix((hashes[s:e] * _STEPS[: e - s]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - s) * _STEPS[41])
            else:
                yield np.empty(0, np.uint64)
