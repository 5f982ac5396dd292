"""A static binary-fuse filter over 64-bit keys, built and probed in whole arrays."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_HEAD = 3  # seed, segment length, start positions: one uint64 each


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(33))) * _M1
        h = (h ^ (h >> np.uint64(33))) * _M2
        return h ^ (h >> np.uint64(33))


def _cells(h: np.ndarray, segment: int, starts: int) -> np.ndarray:
    """Three cells for each hash, in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of about 9 bits a key that has every key and, by chance, one in 256 of other keys."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    segment = max(4, 1 << int(np.log(n) / np.log(3.33) + 2.25))
    room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))) + 32
    for seed in range(1, 200):
        starts = max(1, -(-room // segment) - 2) * segment
        h = _mix(keys, seed)
        cells = _cells(h, segment, starts)
        order = _peel(cells, starts + 2 * segment)
        if order is not None:
            table = np.zeros(starts + 2 * segment, np.uint8)
            prints = _prints(h)
            for own, ids in reversed(order):  # a cell of its own, and what the other two lack goes into it
                table[own] = prints[ids] ^ np.bitwise_xor.reduce(table[cells[:, ids]], axis=0) ^ table[own]
            return np.array([seed, segment, starts], np.uint64).tobytes() + table.tobytes()
        room += room // 8 if seed % 8 == 0 else 0
    raise ValueError("no seed lets the keys peel")


def _peel(cells: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (cells with one key left, that key), or None if keys are left that share all their cells."""
    n = cells.shape[1]
    count = np.bincount(cells.ravel(), minlength=size)
    keys = np.zeros(size, np.int64)
    for row in cells:
        np.bitwise_xor.at(keys, row, np.arange(n))
    order, done = [], 0
    single = np.flatnonzero(count == 1)
    while single.size:
        ids, at = np.unique(keys[single], return_index=True)
        order.append((single[at], ids))
        done += len(ids)
        touched = cells[:, ids]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(keys, row, ids)
        touched = np.unique(touched)
        single = touched[count[touched] == 1]
    return order if done == n else None


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    head = np.frombuffer(blob, np.uint64, _HEAD)
    table = np.frombuffer(blob, np.uint8, offset=8 * _HEAD)
    h = _mix(keys.astype(np.uint64), int(head[0]))
    return np.bitwise_xor.reduce(table[_cells(h, int(head[1]), int(head[2]))], axis=0) == _prints(h)
