"""Links of the n-gram join: counts, many blocks, the sketches that stand before the texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from partition_audit.llm import ngram_join as ngj


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def sets_of(rows, width):
    found = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        found.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return found


def brute_force(rows, width, percent):
    """(doc_id, n_shingles, component_id, n_links) of every row."""
    sets = sets_of(rows, width)
    near = [
        [j for j, b in enumerate(sets) if j != i and a and 100 * len(a & b) >= percent * len(a | b)]
        for i, a in enumerate(sets)
    ]
    least = [i for i, _ in rows]
    for _ in rows:
        least = [min([least[i], *(least[j] for j in near[i])]) for i in range(len(rows))]
    return Counter((rows[i][0], len(sets[i]), least[i], len(near[i])) for i in range(len(rows)))


def near_copies(seed, groups, members, length, changes):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randrange(*length))]
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randrange(changes)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows) * 3, " ".join(words)))
    rows += [(90_001, rows[0][1]), (90_002, rows[0][1]), (90_003, None), (90_004, ""), (90_005, "one"), (90_006, "One")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,percent,limit", [(3, 90, 4 << 20), (2, 80, 2000), (1, 60, 700)])
def test_counts_equal_brute_force(spark, monkeypatch, width, percent, limit):
    monkeypatch.setattr(ngj, "BLOCK_BYTES", limit)
    monkeypatch.setattr(ngj, "SHORT_LIST", 8 if limit == 2000 else 100_000)
    rows = near_copies(width, 6, 14, (4, 120), 5)
    found = ngj.near_duplicates(table(spark, rows), width, percent, count_links=True)
    assert Counter(tuple(r) for r in found.collect()) == brute_force(rows, width, percent)


def test_large_group_is_met_in_pairs_of_blocks_that_can_link(spark, monkeypatch):
    members = table(spark, [(i, "") for i in range(60)]).selectExpr(
        "1L as grp", "doc_id as node", "int(1 + doc_id * 10) as n_shingles", "1L as copies", "cast(repeat('x', 100) as binary) as payload"
    )
    dealt = ngj._dealt(members, 80, 300).select("node", "n_shingles", "bundle", "side").collect()
    met = {}
    for r in dealt:
        met.setdefault(r.bundle, []).append(r)
    pairs = {frozenset((a.node, b.node)) for rows in met.values() for a in rows for b in rows}
    assert all(
        frozenset((a, b)) in pairs
        for a in range(60) for b in range(60) if 0.8 * (1 + 10 * a) <= 1 + 10 * b <= (1 + 10 * a) / 0.8
    )
    assert max(len(rows) for rows in met.values()) < 30
    assert not any({0, 59} <= {r.node for r in rows} for rows in met.values())


def test_sketches_never_differ_by_more_than_the_sets():
    rng = random.Random(5)
    for _ in range(200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 400))]
        other = [w if rng.random() > 0.1 else "z" + w for w in base] + ["q"] * rng.randrange(3)
        h, ends = ngj.shingle_sets(pa.array([" ".join(base), " ".join(other)]), 1)
        one, two = (np.frombuffer(x, np.uint64) for x in ngj.sketches(h, ends))
        one, two = sorted((one, two), key=len)
        while len(two) > len(one):
            two = two[: len(two) // 2] ^ two[len(two) // 2 :]
        apart = len(set(h[: ends[1]].tolist()) ^ set(h[ends[1] :].tolist()))
        assert int(np.bitwise_count(one ^ two).sum()) <= apart
