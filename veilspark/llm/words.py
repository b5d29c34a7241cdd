"""Words, shingles and their hashes, one text at a time in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lower_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and U+0009 to U+000D, with A-Z in lower case (bytes.split cuts at those)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()


def shingle_hashes(words: list[bytes], n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each n words joined by spaces; of all words if fewer; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    return np.fromiter((h(line[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for i, base in enumerate((_R, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring values (empty if there are fewer)."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
        return mix((total[n:] - total[:-n]) * down[:m])


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte offsets) and hashes of a text's words."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    gap = np.concatenate([[True], BLANK[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
