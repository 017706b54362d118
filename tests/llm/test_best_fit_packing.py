"""Packing of tokenized documents: pieces against the tokenizer's library, every constraint, few sequences."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partition_audit.llm import best_fit_packing as bf

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
EDGES = [
    (1, None), (2, ""), (3, " \n"), (4, "Word"), (None, "no id"), (6, "tie"), (7, "tie"), (7, "tie"), (8, "x " * 9000),
    (9, "a<|endoftext|>b <|startoftext|> don't\x1cstop  ́x Σ ΑΣ. ΣΑΣ İ"), (10, "y" * 5000), (11, "z " * 63), (12, "z " * 127),
    (13, "Ends. Now, then;: no... e.g. x!!!!!! A1. _. ??? ÀB. \u0130. It's. \"Q.\" a.b. (c). d.\u0301 K. \u212a."),
]


def wanted(rows, tokens):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    found = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), tokens)):
            own = np.array(ids[at : at + tokens], "<u4")
            found[i, k, at, len(own), zlib.crc32(own.tobytes())] += 1
    return found


@pytest.mark.parametrize(
    "capacity,rule,parcel",
    [
        (bf.Capacity(tokens=64), "norm", 16 << 20),
        (bf.Capacity(tokens=64), "dot", 900),
        (bf.Capacity(tokens=128, documents=3, attention=6000), "norm", 16 << 20),
        (bf.Capacity(tokens=128, documents=5, weights=(1, 1, 1)), "dot", 16 << 20),
    ],
)
def test_pieces_and_constraints(spark, monkeypatch, capacity, rule, parcel):
    monkeypatch.setattr(bf, "PARCEL_TOKENS", parcel)
    rng = random.Random(6)
    words = ["the", "Packing", "of", "ÉTÉ", "don't", "1234", "漢字", "unbelievably", "\t", "e-mail"]
    rows = [(100 + i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(150)] + EDGES
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, parcel int, offset int").repartition(4)
    found = bf.pack_documents(docs, PATH, capacity, rule=rule).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted(rows, capacity.tokens)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    room = capacity.vector()
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        alone = len(pieces) == 1
        assert at <= room[0] and len(pieces) <= room[1]
        assert alone or sum(length**2 for _, length in pieces) <= room[2]
    if parcel > 1000 and capacity.documents is None:
        assert len(sequences) <= 1.02 * sum(r.length for r in found) / capacity.tokens + 1
    assert bf.pack_documents(docs.where(F.lit(False)), PATH).count() == 0


def slow_best_fit(needs, capacity, weights, rule):
    """Of every piece, longest first, over all sequences."""
    rooms, found = [], {}
    for i in sorted(range(len(needs)), key=lambda i: [-x for x in needs[i]]):
        best = None
        for k, room in enumerate(rooms):
            if all(r >= n for r, n in zip(room, needs[i])):
                if rule == "norm":
                    score = -sum(w * ((r - n) / c) ** 2 for w, r, n, c in zip(weights, room, needs[i], capacity))
                else:
                    score = sum(w * r * n / c**2 for w, r, n, c in zip(weights, room, needs[i], capacity))
                if best is None or score > best[0] + 1e-12:
                    best = (score, k)
        if best is None:
            rooms.append(list(capacity))
            best = (0, len(rooms) - 1)
        found[i] = best[1]
        rooms[best[1]] = [r - n for r, n in zip(rooms[best[1]], needs[i])]
    return rooms, found


@pytest.mark.parametrize("rule", bf.RULES)
def test_best_fit_against_all_sequences(rule):
    rng = random.Random(7)
    for _ in range(40):
        capacity, weights = (100, 6, 3000), (1.0, 0.37, 0.61)
        needs = [(n, 1, n * n) for n in (rng.randrange(1, 50) for _ in range(rng.randrange(1, 60)))]
        rooms, _ = slow_best_fit(needs, capacity, weights, rule)
        found = bf.vector_best_fit(np.array(needs), np.array(capacity), weights, rule)
        left = np.tile(capacity, (found.max() + 1, 1))
        np.subtract.at(left, found, np.array(needs))
        assert sorted(map(tuple, left.tolist())) == sorted(map(tuple, rooms))
    assert len(bf.vector_best_fit(np.zeros((0, 3), np.int64), np.array([5, 5, 25]), (1, 1, 1))) == 0
    with pytest.raises(ValueError):
        bf.vector_best_fit(np.ones((1, 3), np.int64), np.array([5, 5, 25]), (1, 1, 1), "first")
