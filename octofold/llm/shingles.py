"""Word and shingle hashes of texts, vectorised over the bytes of one text."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.RandomState(20240601)


def random_longs(n: int) -> np.ndarray:
    return _RANDOM.randint(0, 1 << 32, n, dtype=np.uint64) << np.uint64(32) | _RANDOM.randint(0, 1 << 32, n, dtype=np.uint64)


BYTE = random_longs(256)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n, at least."""
    if _powers["n"] < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", UNBASE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are no ASCII white space)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; lower: A-Z count as a-z."""
    raw = text.encode("utf-8", "surrogatepass")
    return hash_words(raw.lower() if lower else raw)


def hash_words(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    start, end = word_bounds(data)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n-word window, in order; empty if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for i in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + count]
    return mix(out)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct n-word shingles; a shorter text is one shingle, an empty one none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    return np.unique(windows(words, min(n, len(words))) ^ np.uint64(min(n, len(words)) % n))
