"""What blocks of texts and buckets of hashes tell each other: packed arrays, a note for each pair that has something to say."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

NOTE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])


def notes_of(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(list(zip(*rows)) or [()] * 3, NOTE)], schema=NOTE)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def runs(keys: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
    """by, an order that sorts the keys, in parts of equal keys."""
    return np.split(by, np.flatnonzero(keys[by][1:] != keys[by][:-1]) + 1) if len(by) else []


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of so many numbers each."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def two(head: bytes, rest: bytes) -> bytes:
    return len(head).to_bytes(4, "little") + head + rest


def untwo(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:4], "little")
    return data[4 : 4 + n], data[4 + n :]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % buckets


def low4(h: np.ndarray) -> np.ndarray:
    """What tells hashes of a bucket apart; where it doesn't, strings meet in vain."""
    return (h & np.uint64(0xFFFFFFFF)).astype("<u4")
