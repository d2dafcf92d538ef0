"""Binary fuse filters: static membership filters of about nine bits a key.

Three slots a key lie in three neighbouring segments (Graf and Lemire, 2022).  A
filter answers "maybe" for every key it was built from and for one other key in
256.  Building peels all slots that hold one key at a time, so numpy handles a
whole round at once.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QQQ")
U64 = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 over key + seed."""
    h = keys + U64(seed)
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _slots(hashes: np.ndarray, segment: int, starts: int) -> np.ndarray:
    """The three slots of every hash, one row each."""
    mask = U64(segment - 1)
    first = ((hashes >> U64(32)) * U64(starts)) >> U64(32)
    second = (first + U64(segment)) ^ ((hashes >> U64(18)) & mask)
    third = (first + U64(2 * segment)) ^ (hashes & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> U64(32))).astype(np.uint8)


def _shape(count: int) -> tuple[int, int]:
    """Segment length and number of possible first slots for so many keys."""
    if count <= 1:
        return 4, 4
    segment = 1 << min(18, max(2, int(np.log(count) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(count))
    segments = max(1, -(-int(count * factor) // segment) - 2)
    return segment, segments * segment


def build(keys: np.ndarray) -> bytes:
    """A filter of 64-bit keys; repeated keys count once, no keys give an empty filter."""
    keys = np.unique(keys.astype(U64, copy=False))
    segment, starts = _shape(len(keys))
    for seed in range(1, 1000):
        hashes = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        slots = _slots(hashes, segment, starts)
        order = _peel(slots, starts + 2 * segment)
        if order is not None:
            table = np.zeros(starts + 2 * segment, np.uint8)
            prints = _prints(hashes)
            for members, own in reversed(order):
                a, b, c = slots[:, members]
                table[own] = prints[members] ^ table[a] ^ table[b] ^ table[c]
            return HEAD.pack(seed, segment, starts) + table.tobytes()
        if seed % 10 == 0:
            starts += segment
    raise ArithmeticError("no seed separates the keys")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot each of them owns), or None if some keys stay."""
    count = slots.shape[1]
    flat = slots.ravel()
    held = np.bincount(flat, minlength=size)
    total = np.bincount(flat, weights=np.tile(np.arange(count), 3), minlength=size).astype(np.int64)
    alone, order, done = np.flatnonzero(held == 1), [], 0
    while len(alone):
        members, at = np.unique(total[alone], return_index=True)
        order.append((members, alone[at]))
        done += len(members)
        touched = slots[:, members].ravel()
        np.subtract.at(held, touched, 1)
        np.subtract.at(total, touched, np.tile(members, 3))
        touched = np.unique(touched)
        alone = touched[held[touched] == 1]
    return order if done == count else None


def contains(stored: bytes | None, keys: np.ndarray) -> np.ndarray:
    """For every key, whether the filter may hold it; a missing filter holds none."""
    if not stored:
        return np.zeros(len(keys), bool)
    seed, segment, starts = HEAD.unpack_from(stored)
    table = np.frombuffer(stored, np.uint8, offset=HEAD.size)
    hashes = _mix(keys.astype(U64, copy=False), seed * 0x9E3779B97F4A7C15 % (1 << 64))
    a, b, c = _slots(hashes, segment, starts)
    return _prints(hashes) == (table[a] ^ table[b] ^ table[c])
