"""Static three-wise binary fuse filters over 64-bit keys, built and probed with numpy.

A filter answers "maybe" for every key it was built from and for about one in 256 others, in
about nine bits a key.  Keys are peeled in rounds: all slots that one key alone touches are
taken at once, which needs no order among the keys of a round."""

from __future__ import annotations

import math

import numpy as np


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of start segments for n keys."""
    if n < 2:
        return 4, 1
    length = min(1 << 18, max(4, 1 << int(math.log(n) / math.log(3.33) + 2.25)))
    slots = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return length, max(1, math.ceil(slots / length) - 2)


def _slots(h: np.ndarray, length: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = ((h >> np.uint64(32)) * np.uint64(length * count)) >> np.uint64(32)
    inside = np.uint64(length - 1)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & inside)
    third = (first + np.uint64(2 * length)) ^ (h & inside)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def _mark(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(seed, segment length, table) for distinct or repeated keys."""
    keys = np.unique(keys.astype(np.uint64))
    length, count = _shape(len(keys))
    size = length * (count + 2)
    for seed in range(1, 1000):
        h = _mix(keys, seed)
        slots = np.stack(_slots(h, length, count))
        load = np.bincount(slots.ravel(), minlength=size)
        # sum of the key numbers in a slot: with one key left, its number
        owner = np.bincount(slots.ravel(), np.tile(np.arange(len(keys), dtype=np.float64), 3), size).astype(np.int64)
        rounds, left = [], len(keys)
        free = np.flatnonzero(load == 1)
        while len(free):
            who, at = np.unique(owner[free], return_index=True)
            rounds.append((who, free[at]))
            left -= len(who)
            touched = slots[:, who].ravel()
            np.subtract.at(load, touched, 1)
            np.subtract.at(owner, touched, np.tile(who, 3))
            free = np.unique(touched[load[touched] == 1])
        if left == 0:
            table, mark = np.zeros(size, np.uint8), _mark(h)
            for who, slot in reversed(rounds):
                a, b, c = slots[:, who]
                table[slot] = mark[who] ^ table[a] ^ table[b] ^ table[c]
            return seed, length, table
        length, count = (length, count + 1 + count // 16)  # a little more room for the next seed
        size = length * (count + 2)
    raise RuntimeError("no seed peels these keys")


def maybe(keys: np.ndarray, seed: int, length: int, table: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never False for a key it was built from."""
    h, length = _mix(keys.astype(np.uint64), int(seed)), int(length)
    a, b, c = _slots(h, length, len(table) // length - 2)
    return table[a] ^ table[b] ^ table[c] == _mark(h)
