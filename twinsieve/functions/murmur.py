"""MurmurHash3 x64 128 and x86 32, from the published public-domain definition."""

from __future__ import annotations

_MASK = (1 << 64) - 1


def _rot(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _MASK


def _final(k: int) -> int:
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = ((k ^ (k >> 33)) * c) & _MASK
    return k ^ (k >> 33)


def x64_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    one = lambda k: (_rot((k * c1) & _MASK, 31) * c2) & _MASK
    two = lambda k: (_rot((k * c2) & _MASK, 33) * c1) & _MASK
    h1 = h2 = seed
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        h1 ^= one(int.from_bytes(data[at : at + 8], "little"))
        h1 = ((_rot(h1, 27) + h2) * 5 + 0x52DCE729) & _MASK
        h2 ^= two(int.from_bytes(data[at + 8 : at + 16], "little"))
        h2 = ((_rot(h2, 31) + h1) * 5 + 0x38495AB5) & _MASK
    rest = data[whole:]
    if len(rest) > 8:
        h2 ^= two(int.from_bytes(rest[8:], "little"))
    if rest:
        h1 ^= one(int.from_bytes(rest[:8], "little"))
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & _MASK
    h2 = (h2 + h1) & _MASK
    h1, h2 = _final(h1), _final(h2)
    h1 = (h1 + h2) & _MASK
    return h1, (h2 + h1) & _MASK


def x86_32(data: bytes, seed: int = 0) -> int:
    m = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    scramble = lambda k: (rot((k * 0xCC9E2D51) & m, 15) * 0x1B873593) & m
    h, whole = seed, len(data) // 4 * 4
    for at in range(0, whole, 4):
        h = (rot(h ^ scramble(int.from_bytes(data[at : at + 4], "little")), 13) * 5 + 0xE6546B64) & m
    h ^= scramble(int.from_bytes(data[whole:], "little")) if data[whole:] else 0
    h ^= len(data)
    for c, r in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
        h = ((h ^ (h >> r)) * c) & m
    return h ^ (h >> 16)
