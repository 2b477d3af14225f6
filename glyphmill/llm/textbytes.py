"""Vectorised words and hashes over the bytes of an Arrow string column (NumPy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

NO_ID = np.iinfo(np.int64).min
#: Bytes of text handled at once; one longer text is handled alone.
SLICE = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ROOT = np.uint64(0x9E3779B97F4A7C15 | 3)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random word for each byte value; sums of these times powers of an odd root are the hashes.
BYTE_WORD = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n + 1:
        size = max(n + 1, SLICE + 1)
        inverse = np.uint64(pow(int(_ROOT), -1, 2**64))
        for name, root in (("up", _ROOT), ("down", inverse)):
            steps = np.full(size, root, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values * root**i; any span's hash follows from two of them."""
    up, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans [start, end): equal sequences hash alike wherever they stand."""
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offs


def ids(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def id_array(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def slices(offs: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together, or one longer text alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of each word; positions count from the first text's start."""
    lo, hi = int(offs[0]), int(offs[-1])
    solid = ~WHITE[body[lo:hi]]
    n = hi - lo
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    begin = offs[:-1] - lo
    begin = begin[begin < n]
    first[begin] = solid[begin]
    before = begin[begin > 0] - 1
    last[before] = solid[before]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs[1:] - lo, start, side="right")


def word_hashes(body: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word of the texts, in order."""
    start, end, text = words(body, offs)
    part = body[int(offs[0]): int(offs[-1])]
    prefix = running(BYTE_WORD[LOWER[part] if lower else part])
    return span_hash(prefix, start, end), text


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes (also across texts: the caller masks those)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, SLICE):  # keeps the power tables small
        part = hashes[lo: lo + SLICE + width - 1]
        here = at[lo: lo + SLICE] - lo
        out[lo: lo + SLICE] = span_hash(running(part), here, here + width)
    return out
