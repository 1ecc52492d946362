"""Key slices: sorted 64-bit keys of a block of rows, dealt out by their highest bits.

A task turns a block of documents into few large rows of bytes, one for each range of key values.
Grouping by the range brings the same key from all blocks together, in groups whose size is set by
the number of ranges; a frequent key comes once from each block at most where the block has summed it.
"""

from __future__ import annotations

import numpy as np

#: Keys that one group of slices is meant to hold.
KEYS_IN_GROUP = 1_500_000


def bits_for(keys: float, in_group: int = KEYS_IN_GROUP) -> int:
    """Number of highest key bits that deal ``keys`` keys into groups of about ``in_group``, 64 groups at least."""
    return max(6, int(np.ceil(np.log2(max(1.0, keys / in_group)))))


def edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each range begins in sorted ``keys``, and their number at the end."""
    lows = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, lows), len(keys))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, highest bytes first and together, so that they compress."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return steps.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    steps = np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers below 2**63 as byte planes of the fewest bytes that hold them."""
    values = np.asarray(values)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    size = 4 if width <= 4 else 8
    planes = values.astype(f">u{size}").view(np.uint8).reshape(-1, size)[:, size - width :]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    size = 4 if width <= 4 else 8
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, size - width :] = planes.T
    return out.view(f">u{size}").ravel().astype(np.int64)


def squeeze(data: bytes) -> bytes:
    """``data`` in the zstd format, after its size; for rows that a shuffle moves more than once."""
    import pyarrow as pa

    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
