"""Minimal perfect hashing of sets of 63-bit keys by levels of bit arrays.

A key set is dealt over ``SHARDS`` by a hash.  In each level of a shard the keys left over are hashed
into a bit array of twice their number; those alone at their bit are settled, the others go
on.  A key's index is the number of set bits before its own, over all levels and shards, so indexes
run from 0 without gaps.  Looking up keys verifies them: one outside the set has index -1.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Parts of a key set that are built and held apart.
SHARDS = 256

_WORD = 64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash that differs from seed to seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, -1) % np.uint64(SHARDS)).astype(np.int64)


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """The bit arrays, as 64-bit words, for distinct keys of one shard."""
    levels = []
    while len(keys):
        words = -(-2 * len(keys) // _WORD)
        spot = (mixed(keys, len(levels)) % np.uint64(words * _WORD)).astype(np.int64)
        alone = np.bincount(spot, minlength=words * _WORD) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        keys = keys[~alone[spot]]
    return levels


@dataclass
class Lookup:
    """The levels of some shards side by side; others have no words.

    ``words[l]`` holds level ``l`` of all shards, that of shard ``s`` in ``count[l][s]`` words from
    ``begin[l][s]`` on; ``ones[l]`` has the index of the first key settled in each word.
    """

    words: list[np.ndarray]
    begin: list[np.ndarray]
    count: list[np.ndarray]
    ones: list[np.ndarray]
    size: int

    @staticmethod
    def of(shards: Iterable[tuple[int, list[np.ndarray]]]) -> Lookup:
        found = sorted(shards, key=lambda s: s[0])
        depth = max((len(levels) for _, levels in found), default=0)
        words = [[] for _ in range(depth)]
        ones = [[] for _ in range(depth)]
        count = np.zeros((depth, SHARDS), np.int64)
        total = 0
        for shard, levels in found:
            for i, level in enumerate(levels):
                set_bits = np.bitwise_count(level).astype(np.int64)
                ones[i].append(total + np.cumsum(set_bits) - set_bits)
                words[i].append(level)
                count[i, shard] = len(level)
                total += int(set_bits.sum())
        return Lookup(
            [np.concatenate(w) for w in words],
            [np.cumsum(c) - c for c in count],
            list(count),
            [np.concatenate(o) for o in ones],
            total,
        )

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key of the set; any index, or -1, for other keys."""
        out = np.full(len(keys), -1, np.int64)
        left, shard = np.arange(len(keys)), shard_of(keys)
        for i, words in enumerate(self.words):
            have = self.count[i][shard]
            left, shard, have = left[have > 0], shard[have > 0], have[have > 0]
            if not len(left):
                break
            spot = (mixed(keys[left], i) % (have * _WORD).astype(np.uint64)).astype(np.int64)
            word = self.begin[i][shard] + spot // _WORD
            bit = (spot % _WORD).astype(np.uint64)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.ones[i][word] + np.bitwise_count(below))[hit]
            left, shard = left[~hit], shard[~hit]
        return out

    def verified(self, keys: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for those that ``stored``, keys by index, does not hold there."""
        at = self.index(keys)
        if not len(stored):
            return np.full(len(keys), -1, np.int64)
        return np.where((at >= 0) & (stored[at] == keys), at, -1)
