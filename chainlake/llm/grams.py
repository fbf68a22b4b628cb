"""Rolling hashes of word n-grams, vectorised over a text's bytes.

Words are runs of letters, digits and non-ASCII characters, with A-Z
lower-cased.  Hashes depend on the bytes alone, so every worker agrees.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Every byte that is no word byte becomes a blank; A-Z become a-z.
_WORD = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_CLEAN = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD else 0x20 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, base, np.uint64))))
                              for base in (_BASE, _INVERSE))
    up, down = _POWERS[size]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def clean(text: bytes) -> bytes:
    """The text with its words lower-cased and blanks in place of all else."""
    return text.translate(_CLEAN)


class Words:
    """Places and hashes of the words of one cleaned text."""

    def __init__(self, text: bytes):
        self.text = clean(text)
        raw = np.frombuffer(self.text, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (raw != 0x20).view(np.int8), [0]))))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = self._hash(raw)

    def __len__(self) -> int:
        return len(self.starts)

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        """Polynomial hash of each word, in chunks of whole words."""
        out = np.empty(len(self.starts), np.uint64)
        low = 0
        while low < len(self.starts):
            origin = self.starts[low]
            high = max(low + 1, int(np.searchsorted(self.ends, origin + _CHUNK, "right")))
            part = raw[origin:self.ends[high - 1]]
            up, down = _powers(len(part))
            total = np.concatenate(([np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up)))
            s, e = self.starts[low:high] - origin, self.ends[low:high] - origin
            out[low:high] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _STEP)
            low = high
        return out

    def rolling(self, n: int) -> np.ndarray:
        """Hash of the n words that begin at each word; empty if there are fewer."""
        count = len(self) - n + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        total = np.zeros(count, np.uint64)
        for j in range(n):
            total = total * _STEP + self.hashes[j:j + count]
        return mix(total + np.uint64(n))

    def gram(self, at: int, n: int) -> bytes:
        """The n words that begin at word ``at``, joined by single blanks."""
        return b" ".join(self.text[self.starts[at]:self.ends[at + n - 1]].split())

    def grams(self, n: int) -> list[bytes]:
        return [self.gram(i, n) for i in range(len(self) - n + 1)]


FILTER_BITS = 24


def hash_filter(hashes: np.ndarray) -> bytes:
    """Bitmap of 2**24 bits (2 MB whatever the number of hashes) with each hash's bit set."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[hashes >> np.uint64(64 - FILTER_BITS)] = True
    return np.packbits(bits).tobytes()


def filter_test(bitmap: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """A function that tells for each hash whether its bit is set."""
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8)).view(bool)
    return lambda hashes: bits[hashes >> np.uint64(64 - FILTER_BITS)]
