"""Hard negatives against brute force over all rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partition_audit.llm import hard_negatives as hn

SCHEMA = "id long, label int, vector array<float>, tile int, score long, key string"


def brute_force(rows, positives=5, negatives=3, percent=(50, 95), every=5):
    """Rows (id, label, vector); anchors have ids divisible by `every`."""
    ok = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    ok = list(ok)
    found = Counter()
    for a in ok:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in ok if r is not a)
        for p, positive, _ in [x for x in scored if x[2] == a[1]][:positives]:
            fit = [x for x in scored if x[2] != a[1] and percent[0] * -p <= 100 * -x[0] <= percent[1] * -p]
            for rank, (n, negative, _) in enumerate(fit[:negatives], 1):
                found[a[0], positive, rank, negative, -p, -n] += 1
    return found


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k") for r in rows], SCHEMA).repartition(4)


def mined(spark, rows, every=5, **options):
    found = hn.hard_negatives(table(spark, rows), F.col("id") % every == 0, **options)
    return Counter(tuple(r) for r in found.collect())


def clustered(seed, n, dim, labels):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim)) * 0.3
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        rows.append((i * 3 + 1 if i % 2 else i * 5, label, (centres[label] + rng.normal(size=dim) * 0.2).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("seed,dim,tile,leaf,tiles", [(1, 6, 4096, 128, 4096), (2, 3, 40, 8, 4096), (3, 12, 16, 4, 5)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, dim, tile, leaf, tiles):
    for name, value in (("TILE_ROWS", tile), ("LEAF_ROWS", leaf), ("FANOUT", 3), ("BLOCK_ANCHORS", 20), ("MAX_TILES", tiles)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(seed, 300, dim, 4)
    # A third of all rows hold one vector; ties, repeated rows and rows that take no part.
    rows += [(20_000 + i, i % 2, rows[0][2]) for i in range(150)]
    rows += [rows[3], rows[4], (None, 1, rows[1][2]), (7000, None, rows[1][2]), (7005, 1, None), (7010, 1, [float("nan")] * dim)]
    rows += [(7015, 1, [None] + [0.1] * (dim - 1)), (7020, 2, [float("inf")] + [0.1] * (dim - 1)), (7025, 2, [0.0] * dim), (7030, 3, [1.0])]
    found, want = mined(spark, rows), brute_force(rows)
    assert found == want and len(want) > 100


def test_sizes_below_k_and_empty_tables(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.5, 0.0]), (2, 2, [0.4, 0.1]), (10, 3, [0.3, 0.3]), (15, 9, [])]
    assert mined(spark, rows) == brute_force(rows) == Counter({(0, 1, 1, 2, 32768, 26112): 1, (0, 1, 2, 10, 32768, 19456): 1})
    assert not mined(spark, rows[1:2]) and not mined(spark, rows, every=1000, positives=1)[(1, 1, 1, 1, 1, 1)]
    assert hn.hard_negatives(table(spark, rows).where("id < 0"), F.col("id") % 5 == 0).count() == 0
    assert hn.hard_negatives(table(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_scores_beyond_double_precision(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, [rng.choice([-1, 1]) * (3e6 + rng.randrange(9)), 2e6 + rng.randrange(5)]) for i in range(60)]
    assert mined(spark, rows) == brute_force(rows)


def test_boxes_bound_every_score():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-300, 300, size=(500, 7)).astype(float)
    labels = rng.integers(0, 5, size=500)
    tree = hn.Tree(np.arange(500), np.arange(500), labels, vectors)
    assert sorted(tree.ids.tolist()) == list(range(500)) and max(b - a for a, b in tree.leaves) <= hn.LEAF_ROWS
    anchor = rng.integers(-300, 300, size=7).astype(float)
    low, high = tree.levels[0].score_bounds(anchor)
    for (a, b), lower, upper in zip(tree.leaves, low, high):
        scores = tree.vectors[a:b] @ anchor
        assert lower <= scores.min() and scores.max() <= upper
