"""Static binary-fuse filters: an approximate set of 64-bit keys at about nine bits a key.

A key has one place in each of three neighbouring segments of a byte array; the bytes
at its places XOR to its fingerprint. A key of the set is always found, another one with
probability 1 in 256. Construction follows the published scheme: keys that are alone at a
place are peeled round by round, and their bytes are set in the opposite order.
"""

from __future__ import annotations

import math

import numpy as np

from tarnwheel.llm.base import mix64

ARITY = 3
MAX_SEEDS = 100
HEADER = np.dtype([("seed", "<u4"), ("segment", "<u4"), ("starts", "<u4"), ("keys", "<u4")])


def _shape(n: int) -> tuple[int, int]:
    """Segment length and number of segments a first place may fall into, for ``n`` keys."""
    if n <= 1:
        return 4, 1
    segment = 1 << min(18, int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
    slots = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    return segment, max(1, math.ceil(slots / segment) - (ARITY - 1))


def _places(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The three places of each key (a row each) and its fingerprint."""
    h = mix64(keys, seed + 1)
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segment * starts)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(14)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(40))) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter over 64-bit ``keys`` (repeats allowed, none at all too)."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment, starts = _shape(n)
    size = segment * (starts + ARITY - 1)
    for seed in range(MAX_SEEDS):
        places, prints = _places(keys, seed, segment, starts)
        order = _peel(places, n, size)
        if order is None:
            continue
        table = np.zeros(size, np.uint8)
        for ids, slots in reversed(order):
            # the own slot still holds zero, so the XOR of all three is that of the other two
            at = places[:, ids]
            table[slots] = prints[ids] ^ table[at[0]] ^ table[at[1]] ^ table[at[2]]
        return np.array([(seed, segment, starts, n)], HEADER).tobytes() + table.tobytes()
    raise RuntimeError(f"no seed of {MAX_SEEDS} peels {n} keys")


def _peel(places: np.ndarray, n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the place each was alone at), or None if some keys never come free."""
    count = np.bincount(places.ravel(), minlength=size)
    # the XOR of the ids at a place names its key once only one is left
    ids = np.zeros(size, np.int64)
    for row in places:
        np.bitwise_xor.at(ids, row, np.arange(n))
    order, left = [], n
    slots = np.flatnonzero(count == 1)
    while left:
        if not len(slots):
            return None
        found, first = np.unique(ids[slots], return_index=True)
        slots = slots[first]
        order.append((found, slots))
        left -= len(found)
        at = places[:, found].ravel()
        np.subtract.at(count, at, 1)
        np.bitwise_xor.at(ids, at, np.tile(found, ARITY))
        touched = np.unique(at)
        slots = touched[count[touched] == 1]
    return order


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` may be in the filter."""
    head = np.frombuffer(blob, HEADER, 1)[0]
    if not head["keys"]:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=HEADER.itemsize)
    at, prints = _places(keys, int(head["seed"]), int(head["segment"]), int(head["starts"]))
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == prints
