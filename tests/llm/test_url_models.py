"""The URL models against plain counting, whole and in shards."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from partition_audit.llm import url_filter as url
from partition_audit.llm.queries import URL_RULES


def _rows():
    rng = random.Random(8)
    hosts = ["shop.example.com", "www.example.com", "news.org", "x.net", "b.com"]
    rows = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['en/', 'es/', 'fr/', ''])}{''.join(rng.choices('abé/-1', k=rng.randrange(30)))}") for i in range(400)]
    return [*rows, (1000, None), (1001, "none"), (1002, rows[0][1]), (1002, rows[0][1]), (None, rows[1][1]), (1003, "http://b.com/" + "long/" * 20_000)]


def _plain(rows):
    """host, path, rule, verdict and score of every row, by Counters."""
    judged, models = [], {"allow": (Counter(), Counter()), "block": (Counter(), Counter())}
    for i, link in rows:
        rest = link.split("://", 1)[1] if link and "://" in link else ""
        rest = rest.split("#")[0].split("?")[0]
        host, slash, path = rest.partition("/")
        host, path, best = host.lower(), slash + path, (None, None)
        for verdict, rule in sorted(URL_RULES, key=lambda r: len(r[1])):
            own, _, start = rule.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
                best = (rule, verdict)
        judged.append([i, host, path, *best])

    def places(address):
        data = bytes(url.ORDER) + address.encode() + b"\0"
        for at in range(url.ORDER, len(data)):
            yield [data[at - k : at] for k in range(url.ORDER + 1)], data[at]

    fold = lambda address: zlib.crc32(address.encode()) % url.FOLDS
    for _, host, path, rule, verdict in judged:
        if rule and fold(host + path) != 0:
            seen, pairs = models[verdict]
            for contexts, byte in places(host + path):
                seen.update(contexts)
                pairs.update((c, byte) for c in contexts)
    for row in judged:
        total, n = 0.0, 0
        for contexts, byte in places(row[1] + row[2]):
            n += 1
            for verdict, sign in (("allow", 1), ("block", -1)):
                seen, pairs = models[verdict]
                p = 1 / 256
                for c in contexts:
                    p = (pairs[c, byte] + url.WEIGHT * p) / (seen[c] + url.WEIGHT)
                total += sign * math.log10(p)
        row.append(total / n)
    held = [(r[4] == "allow", math.floor(r[5] / url.BIN_WIDTH)) for r in judged if r[3] and fold(r[1] + r[2]) == 0]
    good, bad = sum(a for a, _ in held), sum(not a for a, _ in held)
    rate = {e: sum(a and b >= e for a, b in held) / good + sum(not a and b < e for a, b in held) / bad for e in range(-url.BINS, url.BINS + 1)}
    best = [e for e, x in rate.items() if abs(x - max(rate.values())) < 1e-12]
    return judged, best[len(best) // 2] * url.BIN_WIDTH


@pytest.mark.parametrize("shard_bytes", [url.SHARD_BYTES, 40_000])
def test_scores_and_verdicts_equal_plain_counting(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(url, "SHARD_BYTES", shard_bytes)
    rows = _rows()
    pages = spark.createDataFrame([(i, u, "kept", "clash") for i, u in rows], "page_id long, url string, html string, score string").repartition(4)
    found = url.url_verdicts(pages, URL_RULES).collect()
    want, threshold = _plain(rows)
    key = lambda r: (str(r[0]), r[1] + r[2])
    found = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.score) for r in found), key=key)
    assert len(found) == len(want)
    for got, row in zip(found, sorted(want, key=key)):
        assert got[:4] == tuple(row[:4])
        assert got[5] == pytest.approx(row[5], abs=1e-9)
        assert got[4] == (row[4] or ("allow" if row[5] >= threshold else "block"))


def test_shards_hold_whole_parts():
    sizes = {-1: 100, **{part: 50 for part in range(url.PARTS)}}
    shards = url.shard_count(sizes)
    assert shards == 1 and url.shard_count({}) == 1
    assert url.shard_count({p: 10**6 for p in range(64)}) == 32
