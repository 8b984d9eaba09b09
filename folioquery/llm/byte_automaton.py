"""CRC-32 of many byte strings at once, inside Arrow buffers: every start takes one step of the table-driven register at a time."""

from __future__ import annotations

import zlib

import numpy as np

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1)
_ALL = np.uint32(0xFFFFFFFF)
#: Bytes that all strings are advanced by together; what a string has beyond is read in one call.
STEPS = 64


def advanced(crc: np.ndarray, data: np.ndarray, start: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The CRC-32 of each string so far, which ended with crc, after the bytes data[start : start + long]."""
    order = np.argsort((STEPS - np.minimum(long, STEPS)).astype(np.uint8), kind="stable")  # the longest first, so those still running lead
    register, at = (crc ^ _ALL)[order], start[order]
    running = np.searchsorted(-np.minimum(long, STEPS)[order], -np.arange(STEPS), side="left")
    for j in range(min(STEPS, int(long.max(initial=0)))):
        m = running[j]
        register[:m] = _TABLE[(register[:m] ^ data[at[:m] + j]) & 0xFF] ^ (register[:m] >> 8)
    out = np.empty_like(register)
    out[order] = register ^ _ALL
    for i in np.flatnonzero(long > STEPS).tolist():
        out[i] = zlib.crc32(data[start[i] + STEPS : start[i] + long[i]], int(out[i]))
    return out


def advanced_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    """The same after one byte that all have in common."""
    register = crc ^ _ALL
    return _TABLE[(register ^ np.uint32(byte)) & 0xFF] ^ (register >> 8) ^ _ALL
