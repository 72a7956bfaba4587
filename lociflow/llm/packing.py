"""Arrays packed into one compressed value."""

from __future__ import annotations

import numpy as np
import zstandard

_LEVEL = 3


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of bytes, each with its size, compressed; of wider numbers first all lowest bytes, then the next ones."""
    raw = [np.ascontiguousarray(a) for a in arrays]
    sizes = np.array([a.nbytes for a in raw], "<i8").tobytes()
    planes = [a.tobytes() if a.itemsize == 1 else a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in raw]
    return zstandard.ZstdCompressor(level=_LEVEL).compress(sizes + b"".join(planes))


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    """The arrays, of the given types."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, "<i8", len(types))
    at, out = 8 * len(types), []
    for t, n in zip(types, sizes.tolist()):
        kind = np.dtype(t)
        a = np.frombuffer(raw, np.uint8, n, at)
        out.append(a.view(kind) if kind.itemsize == 1 else np.ascontiguousarray(a.reshape(kind.itemsize, -1).T).reshape(-1).view(kind))
        at += n
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending unsigned numbers, which pack better; ``np.cumsum`` gives the numbers back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))
