"""Word shingles of whole texts as sorted 64-bit sets, vectorised over many texts."""

from __future__ import annotations

import numpy as np

WORDS = 5
_RNG = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_PLACE = _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_COUNT = _RNG.integers(0, 1 << 64, WORDS + 1, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 19), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than space and 09 to 0D, A-Z
    lower-cased) of all texts, and the number of words before each text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    inside = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edge[::2], edge[1::2]
    power, inverse = _powers_to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    words = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    return words, np.concatenate([[0], np.searchsorted(starts, ends_of_text)])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted: five words, or all of fewer."""
    if not texts:
        return []
    words, before = word_hashes(texts)
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        rolled = np.full(n, _COUNT[WORDS], np.uint64)
        for k in range(WORDS):
            rolled += words[k : k + n] * _PLACE[k]
        rolled = mix(rolled)
    out = []
    for i in range(len(texts)):
        begin, end = int(before[i]), int(before[i + 1])
        if end - begin >= WORDS:
            out.append(np.unique(rolled[begin : end - WORDS + 1]))
        elif end > begin:
            few = words[begin:end]
            out.append(mix((few * _PLACE[: len(few)]).sum(keepdims=True, dtype=np.uint64) + _COUNT[len(few)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def blocks(sizes: list[int], most: int):
    """(begin, end) of consecutive items of about ``most`` in sum; a larger item stands alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
