"""Words of a text and 64-bit hashes of word sequences, in numpy.

A word is a run of characters other than the six ASCII white-space characters;
``bytes.split`` cuts at exactly those.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Words remembered by a process, and bytes of one: some 15 MB.
CACHED_WORDS, CACHED_BYTES = 100_000, 32


class WordHashes(dict):
    """Hash of a word, remembered for the first ``CACHED_WORDS`` short words a process meets."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS and len(word) <= CACHED_BYTES:
            self[word] = h
        return h


_hashes = WordHashes()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for i, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8").split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(word_hashes: np.ndarray) -> np.ndarray:
    """Running sums from which ``windows`` takes the hash of any window."""
    out = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * powers(len(word_hashes))[0], out=out[1:])
    return out


def windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, by its first word."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[width:] - sums[:-width]) * powers(n)[1])


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``width`` words, A-Z lower-cased.

    A shorter text is one shingle; a text without words has none.
    """
    words = split(text)
    for i, w in enumerate(words):
        if not w.islower():
            words[i] = w.lower()
    if not words:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(hashes(words))
    return np.unique(windows(sums, min(width, len(words))))
