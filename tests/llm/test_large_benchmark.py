"""A benchmark beyond the broadcast limit gives the same result; no document's words travel with its windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from partition_audit.llm import decontaminate as dec


@pytest.fixture
def tables(spark):
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "É", "d9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 3, 10, 11, 14, 25, 0, 10])]
    items += [(90, None), (91, "..."), (3, "zz zz"), (None, "zz yy xx"), (5, items[5][1])]
    rows = [(i, "; ".join(rng.choices(vocabulary + ["Q"], k=rng.randrange(0, 60)))) for i in range(40)]
    rows += [(100 + i, f"q {items[i % 9][1]} q") for i in range(9)]
    rows += [(200, "zz yy XX"), (200, "zz yy XX"), (200, "other"), (None, "zz zz"), (None, None), (7, ""), (8, "a " * 20_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_same_result_without_a_broadcast(tables, monkeypatch):
    docs, items = tables
    facts = lambda: Counter(tuple(map(str, r)) for r in dec.contamination(docs, items).collect())
    spans = lambda: Counter(tuple(r) for r in dec.decontaminate(docs, items, "spans").collect())
    wanted, cleaned = facts(), spans()
    monkeypatch.setattr(dec, "BROADCAST_BYTES", 0)
    assert facts() == wanted and spans() == cleaned
    assert dec.contamination(docs.limit(0), items).count() == 0


def test_a_hash_that_clashes_is_no_hit(tables, monkeypatch, spark):
    docs, items = tables
    monkeypatch.setattr(dec, "BROADCAST_BYTES", 0)
    grams = dec.benchmark_grams(items)
    shifted = grams.withColumn("gram", dec.F.concat(dec.F.lit("not "), "gram"))
    ks = [r.k for r in grams.select("k").distinct().collect()]
    assert not dec._hits_by_shuffle(docs, shifted, sorted(ks)).where("size(spans) > 0").count()


def test_windows_travel_as_hashes(tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(dec, "BROADCAST_BYTES", 0)
    text = dec.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
    below = re.findall(r"hashpartitioning\(wh#[^\n]*\n[^\n]*Project \[([^\]]*)\]", text)
    assert below and not any(re.search(r"(^|, )w#\d+(,|$)", cut) for cut in below)
