"""Word shingles as 64-bit hashes, and fast similarity sketches of their sets.

The sketch follows the published rounds scheme: in round ``i`` every element is
hashed to a bin and offers the value ``i + h`` there; a bin keeps its least
value. After the first ``bins`` rounds, round ``bins + j`` offers all elements to
bin ``j`` alone, so every bin is filled whatever the set's size. Two sets agree
in a bin with probability equal to their Jaccard similarity, with the
concentration bounds of fully random hashing.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_LANES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_KEEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class WordHashes(dict):
    """64-bit hash of a word (bytes); remembers words, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEEP:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at space and U+0009 to U+000D; null has no words."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all ``size``-word shingles; fewer words are one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n < size:
        return mix(np.array([np.bitwise_xor.reduce(mix(h * _LANES[0] + np.arange(1, n + 1, dtype=np.uint64)))], np.uint64) + np.uint64(n))
    m = n - size + 1
    s = np.zeros(m, np.uint64)
    for j in range(size):
        s = mix(s + h[j : j + m] * _LANES[j])
    return np.unique(s)


class Sketcher:
    """``bins`` must be a power of two, and at most 256."""

    def __init__(self, bins: int, bands: int, rows: int):
        if bins & (bins - 1) or bins > 1024 or bins < bands * rows:
            raise ValueError("bins: a power of two up to 1024, and at least bands * rows")
        self.bins, self.bands, self.rows = bins, bands, rows
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.round_keys = mix(np.arange(1, 2 * bins + 1, dtype=np.uint64) * _LANES[5])
        self.low = np.uint64((1 << 53) - 1)

    def sketch(self, elements: np.ndarray) -> np.ndarray:
        """The bins' least values; elements: distinct hashes, at least one."""
        t, n = self.bins, len(elements)
        out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        empty = out[0]
        done, block = 0, max(1, min(t, -(-6 * t // n)))
        while done < t:
            keys = self.round_keys[done : min(t, done + block)]
            h = mix(elements[None, :] ^ keys[:, None])
            value = (np.arange(done, done + len(keys), dtype=np.uint64) << np.uint64(53))[:, None] | (mix(h) & self.low)
            np.minimum.at(out, (h >> self.shift).astype(np.intp).ravel(), value.ravel())
            done += len(keys)
            if not (out == empty).any():
                return out
        for j in np.flatnonzero(out == empty):
            h = mix(mix(elements ^ self.round_keys[t + j])) & self.low
            out[j] = (np.uint64(t + j) << np.uint64(53)) | h.min()
        return out

    def band_keys(self, sketch: np.ndarray) -> np.ndarray:
        rows = sketch[: self.bands * self.rows].reshape(self.bands, self.rows)
        key = mix(np.arange(1, self.bands + 1, dtype=np.uint64) * _LANES[6])
        for j in range(rows.shape[1]):
            key = mix(key + rows[:, j] * _LANES[j & 3])
        return key


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
