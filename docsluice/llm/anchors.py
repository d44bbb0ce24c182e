"""Anchors that cut texts into windows by their content.

A window is a string of `length` bytes. Its anchor is the piece of 32 bytes in it with
the smallest hash, the leftmost of equal ones. Equal windows have equal anchors at
equal offsets, wherever they stand, and the windows of a text that share an anchor
follow each other. So windows need only be compared with windows of the same anchor,
byte column by byte column as they are aligned at it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 32
CHUNK = 1 << 18
PLACE_BITS = np.uint64(20)
_BYTE_CODES = np.random.default_rng(20_011).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_FACTOR = 0x9E3779B97F4A7C15


def windows(data: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor in texts that lie one after the other.

    Yields key (hash of the anchor), at (its place), first and last (places of the
    first and last window). Long data goes by in chunks; a run over a border comes in
    two parts.
    """
    valid = np.zeros(len(data) + 1, np.int8)
    long = np.diff(starts) >= length
    np.add.at(valid, starts[:-1][long], 1)
    np.add.at(valid, starts[1:][long] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    for begin in range(0, len(data) - length + 1, CHUNK):
        part = data[begin : begin + CHUNK + length - 1]
        use = valid[begin : begin + len(part) - length + 1]
        if not use.any():
            continue
        hashes = _hashes(part)
        ranked = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        at = (_least(ranked, length - PIECE + 1) & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
        new = use.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~use[:-1]
        end = use.copy()
        end[:-1] &= (at[1:] != at[:-1]) | ~use[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        anchor = at[first]
        yield hashes[anchor].view(np.int64), begin + anchor, begin + first, begin + last


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the piece that begins at each place, from those of its halves."""
    found, size, factor = _BYTE_CODES[data], 1, _FACTOR
    while size < PIECE:
        found = found[:-size] * np.uint64(factor) + found[size:]
        size, factor = size * 2, factor * factor % 2**64
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(32)
    return found


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values
