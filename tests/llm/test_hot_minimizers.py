"""Crowded minimizers are split by a second one: same repeats found, smaller buckets."""

from __future__ import annotations

import random

import numpy as np

from partition_audit.llm import suffix_repeats as rep
from partition_audit.llm.buffers import text_buffer

LEAST = 50


def texts():
    rng = random.Random(11)
    passages = ["".join(rng.choices("abcde fgh", k=rng.randrange(50, 220))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = ["".join(rng.choices("abcde fghé", k=rng.randrange(0, 160)))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), "".join(rng.choices("xyz", k=rng.randrange(0, 30)))]
        rows.append((i, "".join(parts)))
    return rows + [(500, "y" * 400), (501, "y" * 90), (502, None), (503, ""), (None, passages[0]), (504, "ab" * 300)]


def brute(rows):
    seen, wanted = set(), {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t):
        data = t.encode()
        strings = [data[at : at + LEAST] for at in range(len(data) - LEAST + 1)]
        gone = set()
        for at, s in enumerate(strings):
            if s in seen:
                gone.update(range(at, at + LEAST))
        wanted[i] = (len(gone), bytes(b for at, b in enumerate(data) if at not in gone))
        seen.update(strings)
    return wanted


def test_same_repeats_where_every_minimizer_is_crowded(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = brute(rows)
    for hot in (1 << 60, 0):
        monkeypatch.setattr(rep, "HOT_BYTES", hot)
        monkeypatch.setattr(rep, "COUNTED_PART", 1)
        assert (rep.hot_slots(docs, LEAST) is None) == (hot > 0)
        found = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in rep.without_repeats(docs, LEAST).collect() if r.doc_id is not None}
        assert {i: v for i, v in found.items() if i in wanted} == wanted
    assert rep.hot_slots(docs.limit(0), LEAST) is None


def test_a_crowded_minimizer_is_spread():
    import pyarrow as pa

    rng = random.Random(3)
    # The gram of the smallest hash that these texts hold stands in all of them, between other words.
    gram = min(("".join(rng.choices("abcdefgh", k=8)) for _ in range(50_000)), key=lambda g: rep.gram_hashes(np.frombuffer(g.encode(), np.uint8))[0])
    rows = ["".join(rng.choices("abcdefgh ", k=120)) + gram + "".join(rng.choices("abcdefgh ", k=120)) for _ in range(2_000)]
    data, places = text_buffer(pa.array(rows))
    _, n, _, low = rep.runs_of(data, places, LEAST)
    key, size = np.unique(low, return_inverse=True)
    weight = np.bincount(size, n + LEAST - 1)
    hot = np.zeros(rep.SLOTS, bool)
    hot[rep.slot_of(key[[weight.argmax()]])] = True
    _, n2, _, low2 = rep.runs_of(data, places, LEAST, hot)
    spread = np.bincount(np.unique(low2, return_inverse=True)[1], n2 + LEAST - 1)
    assert weight.max() > 100_000 and spread.max() < weight.max() / 20
    # Every string is still dealt exactly once.
    assert n2.sum() == n.sum() == sum(max(len(t.encode()) - LEAST + 1, 0) for t in rows)
