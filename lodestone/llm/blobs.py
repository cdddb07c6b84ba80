"""Number arrays as compressed bytes: byte planes, so that small numbers and deltas take little room."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a)
    head = a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little")
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
    return head + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes) -> np.ndarray:
    kind, n = np.dtype(b[:4].decode().strip()), int.from_bytes(b[4:12], "little")
    if not n:
        return np.zeros(0, kind)
    raw = zstandard.ZstdDecompressor().decompress(b[12:], max_output_size=n * kind.itemsize)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 values, as differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)
