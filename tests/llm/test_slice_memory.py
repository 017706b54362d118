"""Workers of the Bloom filter model hold one slice's arrays, and give them back before the next."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from partition_audit.llm import bloom_lm, buffers


def test_prefix_sums_take_no_further_arrays():
    data = np.arange(1 << 20, dtype=np.uint64).astype(np.uint8)
    sums = buffers.prefix_sums(data)
    expected = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * buffers._powers[0][: len(data)])
    assert sums[0] == 0 and (sums[1:] == expected).all()
    tracemalloc.start()
    buffers.prefix_sums(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 8 * len(data)


def test_memory_is_given_back_after_each_slice(monkeypatch):
    events = []
    monkeypatch.setattr(bloom_lm, "give_back_memory", lambda: events.append("back"))

    def work(batch):
        events.append(batch.num_rows)
        return [batch]

    texts = pa.array(["x" * (1 << 20)] * 5)
    found = list(bloom_lm.per_slice(work)([pa.RecordBatch.from_arrays([texts], ["text"])]))
    assert sum(b.num_rows for b in found) == 5
    assert events[1::2] == ["back"] * len(found) and len(found) > 1
