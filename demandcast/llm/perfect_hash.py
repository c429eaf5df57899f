"""A minimal perfect hash over 128-bit keys, with arrays of fingerprints, counts and owners behind it."""

import struct
from dataclasses import dataclass

import numpy as np

#: Bits of a level for each key that is still unplaced on it.
SPACE = 2
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(one: np.ndarray, two: np.ndarray, level: int) -> np.ndarray:
    """64 bits that depend on both halves of a key and on the level."""
    x = one * _A ^ (two + np.uint64(level * int(_B) % 2**64))
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


@dataclass
class LineIndex:
    """Arrays over distinct keys (one, two), addressed by a minimal perfect hash.

    Each level is a bit array. A key sits on the first level on which its bit is its
    own; its slot is the number of set bits before that bit, over all levels. A key
    that isn't in the index leads to no slot, or to one whose fingerprint (the key's
    second half) differs: it is taken for another key with chance 2**-64.
    """

    sizes: np.ndarray  # bits of each level
    bits: np.ndarray  # uint64 words of all levels, one level after the other
    fingerprints: np.ndarray  # uint64
    counts: np.ndarray  # uint32, of a greater count 2**32 - 1
    owners: np.ndarray  # int64

    def __post_init__(self):
        self.first = np.cumsum(self.sizes // 64) - self.sizes // 64
        self.before = np.cumsum(np.bitwise_count(self.bits), dtype=np.int64) - np.bitwise_count(self.bits)

    @classmethod
    def build(cls, one, two, counts, owners) -> "LineIndex":
        """Keys must be distinct."""
        left = np.arange(len(one))
        sizes, words, placed = [], [], []
        while len(left):
            size = 64 * -(-SPACE * len(left) // 64)
            place = (_mixed(one[left], two[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            own = alone[place]
            placed.append(left[own][np.argsort(place[own])])
            left = left[~own]
        order = np.concatenate(placed) if placed else left
        return cls(
            np.array(sizes, np.int64),
            np.concatenate(words) if words else np.zeros(0, np.uint64),
            two[order],
            np.minimum(counts[order], 2**32 - 1).astype(np.uint32),
            owners[order],
        )

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that aren't in the index."""
        out = np.full(len(one), -1, np.int64)
        left = np.arange(len(one))
        for level, size in enumerate(self.sizes.tolist()):
            place = (_mixed(one[left], two[left], level) % np.uint64(size)).astype(np.int64)
            word = self.first[level] + place // 64
            shift = (place % 64).astype(np.uint64)
            bits = self.bits[word]
            here = (bits >> shift) & np.uint64(1) == 1
            lower = bits[here] & ((np.uint64(1) << shift[here]) - np.uint64(1))
            out[left[here]] = self.before[word[here]] + np.bitwise_count(lower)
            left = left[~here]
        found = np.flatnonzero(out >= 0)
        out[found[self.fingerprints[out[found]] != two[found]]] = -1
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<qqq", len(self.sizes), len(self.bits), len(self.owners))
        return head + b"".join(x.tobytes() for x in (self.sizes, self.bits, self.fingerprints, self.owners, self.counts))

    @classmethod
    def from_bytes(cls, data: bytes) -> "LineIndex":
        levels, words, keys = struct.unpack_from("<qqq", data)
        at, out = 24, {}
        parts = (("sizes", "<i8", levels), ("bits", "<u8", words), ("fingerprints", "<u8", keys), ("owners", "<i8", keys), ("counts", "<u4", keys))
        for name, kind, n in parts:
            out[name] = np.frombuffer(data, kind, n, at)
            at += out[name].nbytes
        return cls(**out)
