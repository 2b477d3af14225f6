"""A vocabulary as one open-addressing array, and the encoding passes over flat code arrays.

The array holds a slot's N component codes and the token's code side by side as 64-bit integers, so
it is one buffer to broadcast, of a size known beforehand (:func:`packed_bytes`).  Lookups and
replacement work on all sequences of an Arrow batch at once: a pass looks every window up, picks the
leftmost ones that do not overlap, and writes the shorter sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Slots for each entry: lookups stay short while at least half of the slots are free.
SPARE = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def slots_for(n_entries: int) -> int:
    return 1 << max(4, (SPARE * n_entries - 1).bit_length())


def packed_bytes(n_entries: int, n: int) -> int:
    """Size of the array of a vocabulary of ``n_entries`` N-sequences."""
    return 8 * (n + 1) * slots_for(n_entries)


def _slot(windows: np.ndarray, mask: int) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for j in range(windows.shape[1]):
        h = (h ^ windows[:, j].astype(np.uint64)) * _ODD
        h ^= h >> np.uint64(29)
    return (h & np.uint64(mask)).astype(np.int64)


class Packed:
    """``lookup`` of windows of ``n`` codes; -1 where a window is not an entry."""

    def __init__(self, comps: np.ndarray, codes: np.ndarray, n: int):
        self.n = n
        comps = np.asarray(comps, np.int64).reshape(-1, n)
        self.mask = slots_for(len(codes)) - 1
        self.keys = np.zeros((self.mask + 1, n), np.int64)
        self.codes = np.full(self.mask + 1, -1, np.int64)
        left, at = np.arange(len(codes)), _slot(comps, self.mask)
        while len(left):
            free = self.codes[at] < 0
            # of the entries that want one free slot, the first gets it; the others go on to the next slot
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            got = first[free[first]]
            self.keys[at[got]], self.codes[at[got]] = comps[left[got]], codes[left[got]]
            rest = np.ones(len(left), bool)
            rest[got] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def lookup(self, windows: np.ndarray) -> np.ndarray:
        out = np.full(len(windows), -1, np.int64)
        left, at = np.arange(len(windows)), _slot(windows, self.mask)
        while len(left):
            found = self.codes[at]
            same = (found >= 0) & (self.keys[at] == windows[left]).all(axis=1)
            out[left[same]] = found[same]
            on = (found >= 0) & ~same
            left, at = left[on], (at[on] + 1) & self.mask
        return out


def pick_leftmost(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of the sorted window starts a left-to-right scan takes when windows must not overlap."""
    taken = np.zeros(len(starts), bool)
    if not len(starts):
        return taken
    head = np.ones(len(starts), bool)
    head[1:] = np.diff(starts) >= n            # nothing before it can reach a chain's first window
    if n == 2:                                 # in a chain of neighbours, every other one
        first = np.flatnonzero(head)
        return (np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))) % 2 == 0
    at = np.flatnonzero(head)
    follow = np.append(np.searchsorted(starts, starts + n), len(starts))
    head = np.append(head, True)
    while len(at):
        taken[at] = True
        at = follow[at]
        at = at[~head[at]]
    return taken


def replace(codes: np.ndarray, offs: np.ndarray, starts: np.ndarray, found: np.ndarray, n: int):
    """(codes, offsets, which elements were kept, which of those are new) after replacing the windows at ``starts``."""
    take = pick_leftmost(starts, n)
    starts, found = starts[take], found[take]
    keep = np.ones(len(codes), bool)
    for j in range(1, n):
        keep[starts + j] = False
    codes = codes.copy()
    codes[starts] = found
    made = np.zeros(len(codes), bool)
    made[starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[offs], keep, made[keep]


def window_starts(offs: np.ndarray, n: int, near: np.ndarray | None = None) -> np.ndarray:
    """Starts of all windows inside a sequence; with ``near``, only of those that hold a flagged element."""
    size = int(offs[-1])
    ok = np.ones(size, bool)
    for j in range(1, n):                      # the last n - 1 places of each sequence start no window
        ends = offs[1:] - j
        ok[ends[ends >= offs[:-1]]] = False
    if near is not None:
        some = np.zeros(size + n, bool)
        for j in range(n):
            some[:size - j] |= near[j:]
        ok &= some[:size]
    return np.flatnonzero(ok)


def one_pass(codes: np.ndarray, offs: np.ndarray, table: Packed, near: np.ndarray | None = None):
    """E01 over many sequences; None when no window is an entry, else as :func:`replace`."""
    starts = window_starts(offs, table.n, near)
    windows = np.stack([codes[starts + j] for j in range(table.n)], axis=1)
    found = table.lookup(windows)
    hit = found >= 0
    if not hit.any():
        return None
    return replace(codes, offs, starts[hit], found[hit], table.n)


def encode_flat(codes: np.ndarray, offs: np.ndarray, table: Packed) -> tuple[np.ndarray, np.ndarray]:
    """Passes until nothing is replaced.  After the first, only windows around new tokens can be entries."""
    near = None
    while True:
        done = one_pass(codes, offs, table, near)
        if done is None:
            return codes, offs
        codes, offs, _, near = done


def char_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points of strings without nulls, and where each string's begin."""
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def texts_of(codes: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Strings of the code points between offsets: the inverse of :func:`char_codes`."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    widths = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])[offs]
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def flat_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column and offsets into them; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def list_column(values, offs: np.ndarray, valid: pa.Array | None = None) -> pa.Array:
    """A list column from flat values; rows where ``valid`` is false become null."""
    ends = pa.array(offs.astype(np.int32))
    if valid is not None and valid.false_count:
        ends = pa.array(offs.astype(np.int32), mask=np.append(~valid.to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(ends, values if isinstance(values, pa.Array) else pa.array(values))


def gather(flat: np.ndarray, offs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences ``which`` one behind the other, and the end of each (with a leading 0)."""
    sizes = np.diff(offs)[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) + np.repeat(offs[:-1][which] - ends[:-1], sizes)
    return flat[at], ends


def encode_pieces(pieces: pa.Array, table: Packed) -> pa.Array:
    """A list column of text pieces -> their codes, one behind the other; each distinct piece is encoded once."""
    flat, offs = flat_lists(pieces)
    coded = flat.dictionary_encode()
    codes, ends = encode_flat(*char_codes(coded.dictionary), table)
    values, piece_ends = gather(codes, ends, coded.indices.to_numpy())
    return list_column(values, piece_ends[offs], pieces.is_valid())


def encode_sequences(seqs: pa.Array, table: Packed) -> pa.Array:
    """A list column of codes, encoded further."""
    flat, offs = flat_lists(seqs)
    codes, ends = encode_flat(flat.to_numpy(zero_copy_only=False).astype(np.int64), offs, table)
    return list_column(codes, ends, seqs.is_valid())
