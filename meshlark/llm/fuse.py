"""Static binary-fuse filters (3-wise, 8-bit fingerprints), built and probed with numpy.

A filter is built once for an immutable set of 64-bit keys: never a false negative, about
1 false positive in 256, about 9 bits a key (Graf and Lemire, 2022). Peeling goes by rounds:
all slots that hold one key are taken at once, so a round is a few array operations.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from meshlark.llm.textbytes import mix

_HEAD = struct.Struct("<QQQ")


def _places(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key (columns) and its fingerprint."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(seed))
    first = (((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)).astype(np.int64)
    step = np.int64(segment)
    mask = np.uint64(segment - 1)
    one = first + step
    two = one + step
    one ^= ((h >> np.uint64(18)) & mask).astype(np.int64)
    two ^= (h & mask).astype(np.int64)
    return np.stack([first, one, two], axis=1), (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of the distinct keys, as bytes; an empty set gives a filter that holds nothing."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if not n:
        return b""
    segment = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 10)))
    segments = max(1, -(-int(n * factor) // segment) - 2)
    for seed in range(1, 200):
        if seed % 20 == 0:
            segments += 1 + segments // 8  # small sets need more room now and then
        starts = segments * segment
        slots, prints = _places(keys, mix(np.array([seed], np.uint64))[0].item(), segment, starts)
        size = starts + 2 * segment
        flat = slots.ravel()
        degree = np.bincount(flat, minlength=size)
        owner = np.zeros(size, np.int64)
        np.bitwise_xor.at(owner, flat, np.repeat(np.arange(n, dtype=np.int64), 3))
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        left = n
        while left:
            single = np.flatnonzero(degree == 1)
            if not len(single):
                break
            key, pick = np.unique(owner[single], return_index=True)
            rounds.append((key, single[pick]))
            gone = slots[key].ravel()
            np.subtract.at(degree, gone, 1)
            np.bitwise_xor.at(owner, gone, np.repeat(key, 3))
            left -= len(key)
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for key, slot in reversed(rounds):
            three = table[slots[key]]
            table[slot] = prints[key] ^ three[:, 0] ^ three[:, 1] ^ three[:, 2] ^ table[slot]
        return _HEAD.pack(seed, segment, starts) + table.tobytes()
    raise RuntimeError("no seed gave a filter")


def holds(packed: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key whether the filter may hold it."""
    keys = np.asarray(keys, np.uint64)
    if not packed:
        return np.zeros(len(keys), bool)
    seed, segment, starts = _HEAD.unpack_from(packed)
    table = np.frombuffer(packed, np.uint8, offset=_HEAD.size)
    slots, prints = _places(keys, mix(np.array([seed], np.uint64))[0].item(), segment, starts)
    three = table[slots]
    return (three[:, 0] ^ three[:, 1] ^ three[:, 2]) == prints
