"""Alignment of two tokenizers against brute force with the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from partition_audit.llm import token_alignment as al

public_tokenizers = pytest.importorskip("public_tokenizers")


def brute_force(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbols = al.byte_of_symbol()
    vocabulary = {i: t for t, i in a.get_vocab().items()}
    docs, links = [], Counter()
    for doc_id, text in rows:
        none = (doc_id, 0, 0, [], "")
        if not text:
            docs.append(none)
            continue
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(symbols[c] for c in vocabulary[i]) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append(none)
            continue
        ends_a, ends_b = {}, {}
        for ends, pieces in ((ends_a, bytes_a), (ends_b, bytes_b)):
            at = 0
            for n, piece in enumerate(pieces):
                at += len(piece)
                ends[at] = n
        common = sorted(ends_a.keys() & ends_b.keys())
        own = [(ids_a[ends_a[e]], ids_b[ends_b[e]]) for e in common]
        groups, i, j = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, ids_a[i : ends_a[e] + 1])) + "|" + ",".join(map(str, ids_b[j : ends_b[e] + 1])))
            i, j = ends_a[e] + 1, ends_b[e] + 1
        links.update(own)
        docs.append((doc_id, len(ids_a), len(ids_b), own, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    return Counter(
        (i, n_a, n_b, len(own), len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), digest)
        for i, n_a, n_b, own, digest in docs
    )


EDGES = [
    (1, None), (2, ""), (3, " "), (4, "a"), (None, "no id"), (5, "tie tie"), (5, "tie tie"), (6, "tie tie"),
    (7, "has ▁ of its own"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"), (9, "line\nline\r\n\ttab  two   three"),
    (10, "café 漢字 \U0001f600 é \x00 \x1c   　"), (11, "x" * 5000), (12, " lead and trail "), (13, "word " * 20000), (14, " " * 3000),
]


def aligned(docs):
    return al.align_tokenizers(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    )


def test_alignment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = ["the", "tokenizer", "Straße", "naïve", "123,456", "isn't", "привет", "\n\n", "::", "HelloWorld", "á", "你好"]
    rows = [(100 + i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(60)] + EDGES
    full = [(i, t, 1, "x", b"y") for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, slice long, pair string, places binary").repartition(3)
    want = brute_force(rows)
    for limit in (7 << 20, 300):
        monkeypatch.setattr(al, "PAIR_BYTES", limit)
        found = aligned(docs)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(tuple(r) for r in found.collect()) == want
    assert aligned(docs.where(F.lit(False))).count() == 0
    assert [tuple(r) for r in aligned(docs.where("text is null")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_stretches_are_all_common_ends():
    rng = random.Random(4)
    for _ in range(500):
        a, b = (sorted(rng.sample(range(60), rng.randrange(40))) for _ in range(2))
        if rng.random() < 0.5:
            b = sorted({*a[: rng.randrange(40)], *b[rng.randrange(40) :]})
        pairs = [(i + k, j + k) for i, j, n in al.common_ends(a, b) for k in range(n)]
        assert [a[i] for i, _ in pairs] == [b[j] for _, j in pairs] == sorted({*a} & {*b})


def test_rank_encoder_equals_the_vocabulary_file():
    """Over every character, next to letters, digits, marks and spaces."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    fast = al.byte_level(path, public_tokenizers.PATTERN)
    rng = random.Random(1)
    points = [c for c in rng.sample(range(0x110000), 6000) if not 0xD800 <= c < 0xE000] + list(range(0x3000))
    texts = [f"{chr(c)}a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}" for c in points]
    for text, found in zip(texts, slow.encode_batch([" " + t for t in texts], add_special_tokens=False)):
        assert fast.encode(text) == found.ids
    assert fast.encode(" " * 2_000_000) == slow.encode(" " * 2_000_001, add_special_tokens=False).ids
