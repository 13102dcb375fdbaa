"""Covering codes on 64-bit fingerprints, as tables that a rule makes.

A code is a direct sum of perfect codes on blocks of the fingerprint: every word of a block lies
within the block's covering radius of exactly one code word, so the anchor that covers a
fingerprint is found by decoding the blocks. Bits in no block are covered by the single word zero.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np


class Block:
    """A perfect linear code on `width` bits, decoded by syndromes.

    columns: the syndrome of each single bit; radius: every syndrome is that of one word of at most
    this weight.
    """

    def __init__(self, columns: list[int], radius: int):
        self.width, self.radius = len(columns), radius
        self.parts = []
        for at in range(0, self.width, 12):
            own = columns[at : at + 12]
            words = np.arange(1 << len(own), dtype=np.uint64)
            syndrome = np.zeros(len(words), dtype=np.uint16)
            for bit, column in enumerate(own):
                syndrome ^= (words >> np.uint64(bit) & np.uint64(1)).astype(np.uint16) * np.uint16(column)
            self.parts.append((np.uint64(at), np.uint64(len(words) - 1), syndrome))
        self.leader = np.zeros(1 << max(columns).bit_length(), dtype=np.uint64)
        for weight in range(1, radius + 1):
            for bits in combinations(range(self.width), weight):
                self.leader[int(np.bitwise_xor.reduce([columns[b] for b in bits]))] = sum(1 << b for b in bits)

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """The code word nearest to each word."""
        syndrome = np.zeros(words.shape, dtype=np.uint16)
        for at, mask, table in self.parts:
            syndrome ^= table[(words >> at & mask).astype(np.int64)]
        return words ^ self.leader[syndrome]


def _golay() -> Block:
    """[23, 12] binary Golay code, by its generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1."""
    columns, rest = [], 1
    for _ in range(23):
        columns.append(rest)
        rest <<= 1
        if rest >> 11:
            rest ^= 0xC75
    return Block(columns, 3)


def _hamming() -> Block:
    """[15, 11] Hamming code."""
    return Block(list(range(1, 16)), 1)


class Covering:
    """The anchors of a 64-bit space.

    blocks: names of the block codes from the lowest bit on, "golay" (23 bits, radius 3) or
    "hamming" (15 bits, radius 1); radius: the covering radius of the sum.
    """

    def __init__(self, blocks: tuple[str, ...] = ("golay", "golay", "hamming")):
        self.blocks, self.radius, at = [], 0, 0
        for b in blocks:
            block = _golay() if b == "golay" else _hamming()
            self.blocks.append((np.uint64(at), np.uint64((1 << block.width) - 1), block))
            self.radius, at = self.radius + block.radius, at + block.width
        if at > 64:
            raise ValueError("the blocks are wider than 64 bits")
        self.radius += 64 - at

    def home(self, words: np.ndarray) -> np.ndarray:
        """The anchor that covers each word."""
        out = np.zeros(words.shape, dtype=np.uint64)
        for at, mask, block in self.blocks:
            out |= block.nearest(words >> at & mask) << at
        return out

    def replicas(self, words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the word, anchor, point) for every point within reach of a word and its anchor."""
        flips = flips_within(reach)
        points = words[:, None] ^ flips[None, :]
        return np.repeat(np.arange(len(words)), len(flips)), self.home(points).ravel(), points.ravel()


def flips_within(reach: int) -> np.ndarray:
    """All 64-bit words of weight at most reach, zero first."""
    return np.array([sum(1 << b for b in bits) for w in range(reach + 1) for bits in combinations(range(64), w)], dtype=np.uint64)


_kept: dict[tuple[str, ...], Covering] = {}


def covering(blocks: tuple[str, ...]) -> Covering:
    """The code for these blocks, made once in a process."""
    if blocks not in _kept:
        _kept[blocks] = Covering(blocks)
    return _kept[blocks]
