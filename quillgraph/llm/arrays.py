"""Arrow columns as flat numpy arrays, and small vectorised helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The word separators [\x20\x09-\x0D].
BLANKS = bytes([9, 10, 11, 12, 13, 32])


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after the other, and len + 1 offsets. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    if n == 0 or raw[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array) -> list[bytes]:
    data, offsets = flat_text(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place on a copy)."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def run_starts(keys: np.ndarray) -> np.ndarray:
    """First positions of runs of equal values in a sorted array."""
    if not len(keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def packed(values: np.ndarray) -> bytes:
    """Compressed byte planes of 8-byte or 4-byte values."""
    flat = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T.tobytes())


def unpacked(block: bytes, kind: type) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(block)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(block: bytes) -> np.ndarray:
    return np.cumsum(unpacked(block, np.uint64), dtype=np.uint64)
