"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

#: Base of the polynomial hash of a word, and the multipliers that mix hashes (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b)]), dtype=np.uint64) for b in (BASE, inverse)]
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, or of texts joined by spaces."""
    a = np.frombuffer(data, np.uint8)
    solid = np.empty(len(a) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not((a == 32) | ((a >= 9) & (a <= 13)), out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # words within CHUNK bytes of each other; a longer word is a chunk of its own
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        low, high = starts[at], ends[stop - 1]
        power, inverse = _power_tables(max(CHUNK, int(high - low)))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((a[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        hashes[at:stop] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = stop
    return mix(hashes), starts, ends


def batches(texts: list[str | None], most: int = CHUNK):
    """(first text, texts, joined bytes, start of each text): runs of texts of about ``most`` bytes; null is empty."""
    part, first, size = [], 0, 0
    for i, t in enumerate(texts):
        part.append((t or "").encode("utf-8", "replace"))
        size += len(part[-1]) + 1
        if size >= most or i == len(texts) - 1:
            lengths = np.array([len(p) + 1 for p in part])
            yield first, len(part), b" ".join(part), np.concatenate([[0], np.cumsum(lengths)[:-1]])
            part, first, size = [], i + 1, 0


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` consecutive items from each place on: places 0 to len(h) - n."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, np.uint64(n))
    for i in range(n):
        out = (out * BASE) + h[i : i + m]
        out ^= out >> np.uint64(29)
    return out
