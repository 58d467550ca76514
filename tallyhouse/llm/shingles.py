"""Sets of word shingles as sorted 64-bit hashes, made with numpy for many texts at once."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_random = np.random.RandomState(20_240_229)


def _odd(n: int) -> np.ndarray:
    return _random.randint(0, 1 << 62, size=n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


BYTE = _odd(256)
STEP = _odd(1)[0]
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
PLACE = _odd(64)
SHORT = _odd(1)[0]
# A-Z in lower case, every other byte as it is.
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
# What separates plain words: all ASCII but digits and letters.
NOT_PLAIN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((STEP, STEP_BACK)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


def word_hashes(texts: list[bytes], separates: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, and where each text's words start (one entry more than texts).

    Words are runs of bytes that do not separate; A-Z are lower-cased.
    """
    data = LOW[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
    blank = separates[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    forth, back = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTE[data] * forth[:len(data)], dtype=np.uint64)))
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * PLACE[63])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: runs of `width` words, or all words if there are fewer."""
    words, first = word_hashes(texts)
    runs = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        runs += words[j:j + len(runs)] * PLACE[j]
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(runs[a:b - width + 1]))
        elif b > a:
            out.append(mix((words[a:b] * PLACE[:b - a]).sum(dtype=np.uint64, keepdims=True) + SHORT * np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out
