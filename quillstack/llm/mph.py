"""Minimal perfect hashing by cascaded collision-free bit levels (BBHash).

``build`` maps n distinct 64-bit keys to 0..n-1.  A key that lands alone in a
level's bit array keeps that bit, the others fall to the next level; a key's
slot is the rank of its bit, counted from the rank stored for each ``BLOCK``
bytes, so a lookup costs the same in an index of any size.  A key outside the
set may get any slot or -1: the caller compares what the slot stores.
"""

from __future__ import annotations

import struct

import numpy as np

from .textscan import U, mix

GAMMA = 2.0
BLOCK = 16


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys + U((level + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) % U(bits)).astype(np.int64)


def build(keys: np.ndarray) -> bytes:
    """keys: distinct uint64."""
    out, level = [], 0
    while keys.size:
        bits = max(64, int(GAMMA * keys.size))
        at = _place(keys, level, bits)
        alone = np.bincount(at, minlength=bits) == 1
        flags = np.packbits(np.pad(alone, (0, -bits % (8 * BLOCK))))
        ones = np.bitwise_count(flags).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        out.append(struct.pack("<qq", bits, ones.sum()) + (np.cumsum(ones) - ones).astype("<u4").tobytes() + flags.tobytes())
        keys, level = keys[~alone[at]], level + 1
        if level > 200:
            raise ValueError("the keys are not distinct")
    return struct.pack("<i", level) + b"".join(out)


def lookup(index: bytes, keys: np.ndarray) -> np.ndarray:
    slot, base, at = np.full(keys.size, -1, np.int64), 0, 4
    todo = np.arange(keys.size)
    for level in range(struct.unpack_from("<i", index)[0]):
        bits, ones = struct.unpack_from("<qq", index, at)
        blocks = -(-bits // (8 * BLOCK))
        before = np.frombuffer(index, "<u4", blocks, at + 16)
        flags = np.frombuffer(index, np.uint8, blocks * BLOCK, at + 16 + 4 * blocks)
        at += 16 + blocks * (4 + BLOCK)
        p = _place(keys[todo], level, bits)
        hit = (flags[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        p, found = p[hit], todo[hit]
        left = np.arange(BLOCK) < ((p >> 3) % BLOCK)[:, None]
        inside = np.bitwise_count(flags.reshape(-1, BLOCK)[p // (8 * BLOCK)] * left).sum(1, dtype=np.int64)
        slot[found] = base + before[p // (8 * BLOCK)] + inside + np.bitwise_count(flags[p >> 3].astype(np.uint16) >> (8 - (p & 7)).astype(np.uint16))
        base, todo = base + ones, todo[~hit]
    return slot
