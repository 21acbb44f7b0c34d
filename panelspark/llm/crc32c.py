"""CRC-32C (Castagnoli) of many byte strings at once: equal pieces advance together, then the pieces of a string are joined."""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = 0x82F63B78
PIECE = 256


def _byte_tables() -> np.ndarray:
    tables = np.zeros((8, 256), np.uint32)
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(_POLYNOMIAL), crc >> 1).astype(np.uint32)
    tables[0] = crc
    for k in range(1, 8):
        tables[k] = tables[0][tables[k - 1] & 255] ^ (tables[k - 1] >> 8)
    return tables


_TABLES = _byte_tables()


def _zeros_tables(n: int) -> np.ndarray:
    """What ``n`` zero bytes make of each byte of a state."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(n):
        state = _TABLES[0][state & 255] ^ (state >> 8)
    return state


_OVER_PIECE = _zeros_tables(PIECE)


def _advance(words: np.ndarray) -> np.ndarray:
    """The raw register after rows of little-endian 64-bit words, starting from 0."""
    state = np.zeros(len(words), np.uint64)
    for step in range(words.shape[1]):
        x = words[:, step] ^ state
        crc = np.zeros(len(words), np.uint32)
        for k in range(8):
            crc ^= _TABLES[7 - k][(x >> np.uint64(8 * k)) & np.uint64(255)]
        state = crc.astype(np.uint64)
    return state.astype(np.uint32)


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The checksums of ``data[offsets[i]:offsets[i + 1]]``; every string has 4 bytes at least."""
    lengths = np.diff(offsets)
    if not len(lengths):
        return np.zeros(0, np.uint32)
    if lengths.min() < 4:
        raise ValueError("strings of 4 bytes at least")
    pieces = -(-lengths // PIECE)
    ends = np.cumsum(pieces)
    # zero bytes in front leave a register of 0 as it is, so every string is filled up in front
    padded = np.zeros(int(ends[-1]) * PIECE, np.uint8)
    shift = ends * PIECE - offsets[1:]
    padded[np.arange(offsets[0], offsets[-1]) + np.repeat(shift, lengths)] = data[offsets[0]:offsets[-1]]
    heads = (offsets[:-1] + shift)[:, None] + np.arange(4)
    padded[heads] ^= 255  # a register that starts with ones
    each = _advance(padded.view("<u8").reshape(-1, PIECE // 8))
    state = np.zeros(len(lengths), np.uint32)
    begin = ends - pieces
    order = np.argsort(-pieces, kind="stable")
    longer = np.cumsum(np.bincount(pieces)[::-1])[::-1]  # strings with at least so many pieces
    for j in range(int(pieces.max())):
        rows = order[:longer[j + 1]]
        s = state[rows]
        state[rows] = (_OVER_PIECE[0][s & 255] ^ _OVER_PIECE[1][(s >> 8) & 255] ^ _OVER_PIECE[2][(s >> 16) & 255] ^ _OVER_PIECE[3][s >> 24]) ^ each[begin[rows] + j]
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The rotated and shifted form that records store, so that a checksum of checksums stays meaningful."""
    return ((crc >> 15) | (crc << 17)) + np.uint32(0xA282EAD8)
