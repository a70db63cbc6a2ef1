"""Hashes of all character runs of one length, in one numpy pass over a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points read at once.
_PIECE = 1 << 16


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(_PIECE, base, np.uint64))])


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(text: str, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset of the first, hashes) of the runs of ``size`` code points, piece by piece; equal runs have equal hashes anywhere."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    step = _PIECE - size
    for at in range(0, max(0, len(codes) - size + 1), step):
        part = codes[at: at + step + size - 1]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], dtype=np.uint64)])
            runs = (sums[size:] - sums[: len(sums) - size]) * _DOWN[: len(sums) - size]
        yield at, mixed(runs + np.uint64(size))
