"""Order MinHash near-duplicates: sketches of ordered shingles, links verified by banded alignment."""

import hashlib
import re
from collections import Counter

import numpy as np

from demandcast.llm.tokens import chunk_hashes

SHINGLE = 5
SIMILAR = 0.8
SAMPLED, BANDS = 4, 32
#: Texts up to so many shingles have further, exact keys.
SHORT = 9
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHORT_SEED = np.uint64(0x8EBC6AF09C88C6E3)


def digest(text: str) -> bytes:
    """MD5 of the text: equal texts are one node of the graph. Spark's md5 gives the same."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word of the text, in order."""
    buf = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(change):
        return np.zeros(0, dtype=np.uint64)
    cuts = change if change[-1] == len(buf) else np.append(change, len(buf))
    return chunk_hashes(buf[cuts[0] :], cuts - cuts[0])[::2]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of five words in a row; fewer words make one shingle, none make none."""
    n = min(SHINGLE, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        out = out * _ODD + words[k : k + len(out)]
    return _mixed(out)


def occurrence_labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's hash together with how often it has come before."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    if len(start) == len(shingles):
        return shingles
    before = np.empty(len(shingles), dtype=np.uint64)
    before[order] = np.arange(len(shingles)) - np.repeat(start, np.diff(np.append(start, len(shingles))))
    return _mixed(shingles + before * _ODD)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One key for each band: the band's least labelled shingles in the order of the text.

    Two texts share a band's key if their least shingles are the same and stand in
    the same order: for shingle similarity s about s**SAMPLED. With 4 and 32 bands
    a long pair at 0.8 shares none with a chance of 5e-8. Draws without replacement
    miss more short pairs, so texts of 4 to SHORT shingles also have the keys of
    short_keys(); a pair that shares none of these is missed with at most 3e-6.
    Texts of fewer than 4 shingles use what they have: at 0.8 these are equal lists.
    """
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    labelled = occurrence_labelled(shingles)
    size, step = min(SAMPLED, len(labelled)), max(1, 2_000_000 // len(labelled))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for low in range(0, BANDS, step):
        part = slice(low, min(BANDS, low + step))
        drawn = (labelled ^ _SEEDS[part, None]) * _FACTORS[part, None]
        drawn ^= drawn >> np.uint64(32)
        least = np.sort(np.argpartition(drawn, size - 1, axis=1)[:, :size], axis=1)
        for k in range(size):
            keys[part] = keys[part] * _ODD + labelled[least[:, k]]
    keys = _mixed(keys)
    if SAMPLED <= len(shingles) <= SHORT:
        keys = np.concatenate([keys, short_keys(shingles)])
    return keys.view(np.int64)


def short_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the whole list and of the list without any one shingle.

    Two lists share a key if one is the other with a shingle put in, or if they
    differ in one shingle that is replaced or moved.
    """
    lists = [shingles, *(np.delete(shingles, k) for k in range(len(shingles)))]
    keys = np.full(len(lists), _SHORT_SEED, dtype=np.uint64)
    for at, part in enumerate(lists):
        for value in part:
            keys[at : at + 1] = keys[at : at + 1] * _ODD + value
    return np.unique(_mixed(keys))


_SEEDS = (np.arange(BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
_FACTORS = _MIX + np.arange(BANDS, dtype=np.uint64) * np.uint64(2)


def shingles_of(text: str) -> list[tuple]:
    words = WORD.findall(text)
    if len(words) <= SHINGLE:
        return [tuple(words)] if words else []
    return list(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def least_common(total: int) -> int:
    """Shingles in common, of `total` in both, from which common / all is SIMILAR (0.8)."""
    return -(-4 * total // 9)


def aligned(a: list, b: list) -> int:
    """The most shingles that an alignment of `a` and `b` within the allowed band pairs up.

    Longest common subsequence on bit vectors: row by row over `a`, one integer
    holds the band of `b` around the row's diagonal. Similar texts leave so few
    shingles unpaired that their alignment stays inside the band; for others the
    result is a lower bound below the limit.
    """
    low = 0
    most = min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    high = 0
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    total = len(a) + len(b)
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return low + high
    band = max(0, total - 2 * least_common(total))
    places: dict = {}
    for j, value in enumerate(b):
        places[value] = places.get(value, 0) | (1 << j)
    # Bit j of `flat` is 0 where the row's value rises at b[j].
    full = (1 << len(b)) - 1
    flat = full
    if 2 * band + 1 >= len(b):
        for value in a:
            match = places.get(value, 0)
            if match:
                u = flat & match
                flat = ((flat + u) | (flat - u)) & full
        return low + high + len(b) - flat.bit_count()
    risen, start, width = 0, 0, 2 * band + 1
    window = (1 << min(width, len(b))) - 1
    flat = window
    for i, value in enumerate(a):
        while start < i - band:
            risen += 1 - (flat & 1)
            flat >>= 1
            start += 1
            if start + width <= len(b):
                flat |= 1 << (width - 1)
        if start >= len(b):
            break
        size = min(width, len(b) - start)
        match = (places.get(value, 0) >> start) & ((1 << size) - 1)
        if match:
            u = flat & match
            flat = ((flat + u) | (flat - u)) & ((1 << size) - 1)
    size = min(width, max(len(b) - start, 0))
    return low + high + risen + size - (flat & ((1 << size) - 1)).bit_count()


def similar(a: list, b: list, bags: tuple | None = None) -> bool:
    """Whether the aligned shingles are at least SIMILAR of all shingles of both texts."""
    total = len(a) + len(b)
    need = least_common(total)
    if min(len(a), len(b)) < need:
        return False
    one, two = bags or (Counter(a), Counter(b))
    if len(one) > len(two):
        one, two = two, one
    if sum(min(n, two[x]) for x, n in one.items() if x in two) < need:
        return False
    return aligned(a, b) >= need
