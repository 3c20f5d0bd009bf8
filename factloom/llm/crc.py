"""CRC-32 of texts from the CRCs of their parts: it is linear, so that of a whole is that of its beginning, moved on by the length of the rest, xor the rest's own."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Lengths whose moves are tables of their own; longer ones are made of powers of two.
SHORT = 64


@lru_cache(1)
def moves() -> tuple[np.ndarray, np.ndarray]:
    """What moving a CRC on by n bytes makes of each byte of it: for n below SHORT, and for n = 2^k."""
    poly, one = np.uint32(0xEDB88320), np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, poly ^ (one >> np.uint32(1)), one >> np.uint32(1))
    same = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    step = lambda c: one[c & 255] ^ (c >> np.uint32(8))
    short = [same]
    for _ in range(SHORT - 1):
        short.append(step(short[-1]))
    powers = [step(same)]
    for _ in range(31):
        powers.append(through(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


def through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many bytes each; xor the CRC of the bytes that follow, it is that of the whole."""
    short, powers = moves()
    out = short.reshape(-1)
    at = np.where(size < SHORT, size, 0) << 10
    out = out[at | (crc & 255)] ^ out[at | 256 | (crc >> 8 & 255)] ^ out[at | 512 | (crc >> 16 & 255)] ^ out[at | 768 | (crc >> 24)]
    far = np.flatnonzero(size >= SHORT)
    for k in range(32) if len(far) else ():
        i = far[size[far] >> k & 1 > 0]
        out[i] = through(powers[k], out[i])
    return out
