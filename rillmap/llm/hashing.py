"""64-bit names of words and fingerprints of runs of words, equal in every task."""
from __future__ import annotations

from hashlib import blake2b

import numpy as np

from rillmap.llm.tokens import pieces

MOST_WORDS = 1 << 17             # known long words of a task
CHARS = 1 << 18                  # texts are hashed in groups of about this many characters
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Fingerprints of slices by prefix sums of ``value * base ** place`` modulo 2^64; two seeds give independent ones."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base & (1 << 64) - 1, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def slices(self, values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[:len(values)], out=sums[1:])
        return mix((sums[stop] - sums[start]) * self.inverse[start])

    def windows(self, values: np.ndarray, size: int) -> np.ndarray:
        """Fingerprint of ``size`` consecutive values from each place that has so many."""
        n = max(0, len(values) - size + 1)
        self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[:len(values)], out=sums[1:])
        return mix((sums[size:size + n] - sums[:n]) * self.inverse[:n])


def word_edges(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes; a word also ends where the next text begins (``begins``)."""
    word = ~_BLANK[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    cut = begins[(begins > 0) & (begins < len(data))]
    opens[cut] |= word[cut]
    closes[cut - 1] |= word[cut - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


class _LongWords(dict):
    """The two names of words of more than 16 bytes, halves of a BLAKE2b digest; emptied when it holds ``MOST_WORDS``."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= MOST_WORDS:
            self.clear()
        digest = blake2b(word, digest_size=16).digest()
        found = self[word] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
        return found


_LONG = _LongWords()
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_names(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each word of UTF-8 bytes. For words of up to 16 bytes the pair is a bijection of the word (a Feistel network over its two
    halves), longer ones have a BLAKE2b digest, so no choice of words gives equal names."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = stop - start
    high = lanes[start] & _MASK[np.minimum(size, 8)]
    low = lanes[start + 8] & _MASK[np.clip(size - 8, 0, 8)]
    one = mix((high + mix(size.astype(np.uint64))) ^ mix(low + np.uint64(0x9E3779B97F4A7C15)))
    two = mix(low ^ mix(one ^ np.uint64(0xD1342543DE82EF95)))
    long = np.flatnonzero(size > 16)
    if len(long):
        found = [_LONG[data[a:b].tobytes()] for a, b in zip(start[long].tolist(), stop[long].tolist())]
        one[long], two[long] = np.array(found, np.uint64).T
    return one, two


def word_hashes(texts: list[str | None]):
    """(first text, words per text, first names of all words) for consecutive groups of texts."""
    for first, group in pieces(texts, CHARS):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in group]
        data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        start, stop = word_edges(data, np.concatenate([[0], ends[:-1]]))
        yield first, np.diff(np.searchsorted(start, ends), prepend=0), word_names(data, start, stop)[0]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every slice, one slice after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
