"""64-bit hashes of all words of many texts at once, in numpy, from their bytes.

A word's hash is a polynomial in an odd base over a random table of its bytes, read off two prefix
sums modulo 2**64, then mixed. It depends on the word alone. Texts are worked through in windows
that end at separators, so memory follows the window, not the text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a new array."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def word_hashes(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, hash of each word) in ``data`` (bytes); ``separator``: a table of 256."""
    starts, hashes = [], []
    at = 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        if end < len(data):
            gaps = np.flatnonzero(separator[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word larger than the window
                while end < len(data) and not separator[data[end]]:
                    end += 1
        part = data[at:end]
        inside = ~separator[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        first, last = edge[::2], edge[1::2]
        if len(first):
            up, down = _powers(WINDOW) if len(part) <= WINDOW else _powers.__wrapped__(len(part))
            sums = np.concatenate((np.zeros(1, U), np.cumsum(_byte_values()[part] * up[: len(part)], dtype=U)))
            value = (sums[last] - sums[first]) * down[first]
            hashes.append(mix(value + (last - first).astype(U)))
            starts.append(first + at)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(starts), np.concatenate(hashes)


def texts_words(texts: list[bytes], separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of all texts in order, number of words of each text)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, hashes = word_hashes(data, separator)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))


@lru_cache(1)
def not_word() -> np.ndarray:
    """Separators that leave runs of ASCII letters and digits, underscores and non-ASCII characters."""
    table = np.ones(256, bool)
    table[128:] = False
    for c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
        table[c] = False
    return table


def shingles(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``words`` words, its text's index); a text with fewer words, but at
    least one, has a single run of all its words. Letters are lower-cased."""
    hashes, counts = texts_words([t.lower().encode("utf-8", "surrogatepass") for t in texts], not_word())
    owner = np.repeat(np.arange(len(texts)), counts)
    padded = np.concatenate((hashes, np.zeros(words, U)))
    n = len(hashes)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    left = counts[owner] - place
    total = np.zeros(n, U)
    for k in range(words):
        salt = U((2 * k + 3) * 0xA0761D6478BD642F % (1 << 64))
        total += np.where(left > k, mix(padded[k : k + n] + salt), U(0))
    keep = (left >= words) | ((place == 0) & (counts[owner] < words))
    return mix(total[keep]), owner[keep]
