"""E04 works through arrays and slices of a batch, so its memory does not follow the batch's size."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.functions.text import TOK_ID_OFFSET as T
from glyphmill.operators import codec


class Sent:
    value = {"texts": {T: "ab", T + 1: "é😀", T + 7: "\0x"}}


def test_decoded_texts():
    seqs = [[T, 97, T + 1], [], None, [T + 7, 0x1F600, T], [0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(seqs, pa.list_(pa.int64()))], names=["doc_id", "tokens"])
    got = [x for b in codec.decode_fn(Sent, "tokens", "text", ["doc_id"])(iter([batch])) for x in b.column("text").to_pylist()]
    assert got == ["abaé😀", "", None, "\0x😀ab", "\0"]
    with pytest.raises(KeyError):
        list(codec.decode_fn(Sent, "tokens", "text", [])(iter([pa.RecordBatch.from_arrays([pa.array([[T + 3]], pa.list_(pa.int64()))], names=["tokens"])])))


def test_peak_memory_of_a_large_batch():
    peaks = []
    for rows in (1_000, 8_000):
        offs = np.arange(rows + 1, dtype=np.int32) * 500
        flat = np.random.default_rng(3).integers(97, 110, offs[-1])
        batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["tokens"])
        tracemalloc.start()
        for _ in codec.decode_fn(Sent, "tokens", "text", [])(iter([batch])):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
