"""Packed bit vectors with a directory of ones by block, for rank and select over whole arrays of places."""

from __future__ import annotations

import numpy as np

#: Words of 64 bits that one entry of the directory counts.
BLOCK = 8
_LOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)
#: Ones of each byte, and the place of the k-th one in it (8 if it has fewer).
_ONES = np.array([b.bit_count() for b in range(256)], np.uint8)
_NTH = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _NTH[_b, : len(_at)] = _at


class Bits:
    """A fixed vector of `size` bits. Bit i is bit i % 64 of word i // 64."""

    def __init__(self, words: np.ndarray, size: int) -> None:
        self.words, self.size = words, size
        ones = np.bitwise_count(words)
        pad = np.zeros(-len(ones) % BLOCK, ones.dtype)
        by_block = np.concatenate([ones, pad]).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        #: ones before each block, and in all
        self.before = np.concatenate([[0], np.cumsum(by_block)])

    @classmethod
    def of_flags(cls, flags: np.ndarray) -> Bits:
        """From one boolean a bit."""
        packed = np.packbits(flags, bitorder="little")
        whole = np.zeros(-(-len(packed) // 8) * 8, np.uint8)
        whole[: len(packed)] = packed
        return cls(whole.view(np.uint64), len(flags))

    @classmethod
    def of_places(cls, places: np.ndarray, size: int) -> Bits:
        """Ones at the given places."""
        flags = np.zeros(size, bool)
        flags[places] = True
        return cls.of_flags(flags)

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words, self.size)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words, self.size)

    @property
    def count(self) -> int:
        """Ones in all."""
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place; a place may be 0 to size."""
        at = np.asarray(at, np.int64)
        word, bit = at >> 6, at & 63
        out = self.before[word // BLOCK]
        first = word // BLOCK * BLOCK
        for k in range(BLOCK - 1):  # whole words of the block before the place's own
            more = first + k < word
            out[more] += np.bitwise_count(self.words[first[more] + k])
        some = bit > 0
        out[some] += np.bitwise_count(self.words[word[some]] & _LOW[bit[some]])
        return out

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Places of the ones by number, from 0; each must be below count."""
        nth = np.asarray(nth, np.int64)
        block = np.searchsorted(self.before, nth, "right") - 1
        left = nth - self.before[block]
        word = block * BLOCK
        for _ in range(BLOCK - 1):
            ones = np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)]).astype(np.int64)
            on = left >= ones
            left, word = left - ones * on, word + on
            # a word that holds the one stays: `on` is false for it from here on
        own = self.words[word].view(np.uint8).reshape(-1, 8)
        ends = np.cumsum(_ONES[own], 1, dtype=np.int64)
        byte = (ends <= left[:, None]).sum(1)
        row = np.arange(len(own))
        left -= np.where(byte > 0, ends[row, np.maximum(byte, 1) - 1], 0)
        return word * 64 + byte * 8 + _NTH[own[row, byte], left]

    def places(self) -> np.ndarray:
        """Places of all ones."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), count=self.size, bitorder="little"))
