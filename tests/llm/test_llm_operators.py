"""The training-data operators against brute force, tiktoken and held-out rows; edge cases of each."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partition_audit.llm import decontaminate as dec
from partition_audit.llm import language_crf as crf
from partition_audit.llm import license_scan as lic
from partition_audit.llm import ngram_join as ngj
from partition_audit.llm import suffix_repeats as rep
from partition_audit.llm import url_filter as url
from partition_audit.llm import warc
from partition_audit.llm.bloom_lm import score_documents
from partition_audit.llm.byte_bpe import decode, encode
from partition_audit.llm.exact_dedup import drop_copies, exact_groups
from partition_audit.llm.queries import URL_RULES, fold, token_digests

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, h string"


def docs(spark, rows):
    """Rows (doc_id, text) with the other columns of documents and two with clashing names."""
    full = [(i, t, None, None, None, "x", "y") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


EDGES = [(1, None), (2, ""), (3, "  \n"), (4, "Word"), (None, "no id at all"), (6, "tie"), (7, "tie"), (7, "tie"), (8, "x " * 30000)]


def test_exact_groups_edges_and_forced_digest_clash(spark):
    rows = [(i, t) for i, t in EDGES if i is not None] + [(9, "tie "), (10, "Tie")]
    for digest in (None, lambda text: F.lit("same")):
        found = exact_groups(docs(spark, rows), *([digest] if digest else [])).collect()
        text = {}
        for i, t in rows:
            text.setdefault(t or "", []).append(i)
        assert len(found) == len(rows)
        by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in text.items()}
        for r in found:
            ids = by_hash[r.text_sha256]
            assert (r.keep_id, r.group_size) == (max(ids), len(ids))
        assert sum(r.kept for r in found) == len(text)
        assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_drop_copies_keeps_rows_whole(spark):
    kept = drop_copies(docs(spark, EDGES))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "k", "h"]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(0, "no id at all"), (2, ""), (3, "  \n"), (4, "Word"), (7, "tie"), (8, "x " * 30000)]
    )
    assert drop_copies(docs(spark, [])).count() == 0
    assert exact_groups(docs(spark, [])).count() == 0


def _dec_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "É", "é", "d9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 3, 10, 11, 14, 25, 0, 10])]
    items += [(90, None), (91, "..."), (3, "zz zz"), (None, "zz yy xx")]
    rows = [(i, "; ".join(rng.choices(vocabulary + ["Q"], k=rng.randrange(0, 60)))) for i in range(40)]
    rows += [(100 + i, f"q {items[i % 9][1].upper().replace('É', 'É')} q") for i in range(9)] + EDGES + [(200, "zz yy XX")]
    table = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for i, t in items:
        w = _dec_words(t)
        for at in range(max(0, len(w) - 9) if len(w) >= 10 else 1 if w else 0):
            grams.setdefault(tuple(w[at : at + 10]), set()).add(i)
    want = Counter()
    for i, t in rows:
        w, hit, ids = _dec_words(t), set(), set()
        for k in {len(g) for g in grams}:
            for at in range(len(w) - k + 1):
                if (g := tuple(w[at : at + k])) in grams:
                    hit |= set(range(at, at + k))
                    ids |= {str(x) for x in grams[g] if x is not None}
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        want[(i, len(w), len(hit), len(ids), sha, bool(hit))] += 1
    data = docs(spark, rows)
    found = Counter(tuple(r) for r in dec.contamination(data, table).collect())
    assert found == want
    whole = dec.decontaminate(data, table)
    assert whole.columns == data.columns
    assert whole.count() == sum(n for row, n in want.items() if not row[5])
    spans = dec.decontaminate(data, table, "spans")
    assert spans.count() == len(rows)
    for r in spans.collect():
        if r.text is not None and r.doc_id == 200:
            assert _dec_words(r.text) == []
    nothing = dec.contamination(data, table.limit(0)).collect()
    assert len(nothing) == len(rows) and not any(r.contaminated for r in nothing)
    assert dec.contamination(docs(spark, []), table).count() == 0


def test_contamination_plan_is_native(spark):
    table = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = dec.contamination(docs(spark, EDGES), table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


ODD = ["a" * 5000, "ab" * 3000 + " x", "日本語" * 400, "   x\n\n y\t\t", "\x1c\x1d a\u0085b", "don't WE'LL", "é" * 1000, "🤗 zażółć", "01" * 300, "<|endoftext|>", "\x00\x01"]


def test_bpe_equals_tiktoken(spark):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    rows = EDGES + [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(200 + i, "".join(rng.choices("abt ehn'éß1\n,日", k=rng.randrange(400)))) for i in range(150)]
    found = decode(encode(docs(spark, rows), path, public.PATTERN), path).collect()
    assert len(found) == len(rows)
    for r in found:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == own.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert token_digests(docs(spark, []), path, public.PATTERN).count() == 0


def _shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def _near_rows(seed):
    rng, rows = random.Random(seed), []
    for n in [1, 2, 3, *range(8, 44, 2)]:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(5):
            changed = list(base)
            for _ in range(rng.randrange(0, 3)):
                kind = rng.randrange(3)
                if kind == 0:
                    changed[rng.randrange(len(changed))] = f"x{rng.randrange(10**6)}"
                elif kind == 1:
                    changed.append(f"y{rng.randrange(10**6)}")
                elif len(changed) > 1:
                    changed.pop(rng.choice([0, -1]))
            rows.append((1000 + len(rows), " ".join(changed)))
    return rows + [(i, t) for i, t in EDGES if i is not None]


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 90)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rows = _near_rows(width)
    sets = {i: _shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    data = docs(spark, rows)
    found = ngj.near_duplicates(data, width, percent).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), find(i)) for i, s in sets.items()}
    kept = ngj.drop_near_duplicates(data, width, percent)
    assert kept.columns == data.columns
    assert {r.doc_id for r in kept.collect()} == {find(i) for i in sets}


def test_near_duplicates_in_blocks(spark, monkeypatch):
    rows = _near_rows(9)
    whole = {tuple(r) for r in ngj.near_duplicates(docs(spark, rows)).collect()}
    monkeypatch.setattr(ngj, "BLOCK_BYTES", 200)
    assert {tuple(r) for r in ngj.near_duplicates(docs(spark, rows)).collect()} == whole
    assert ngj.near_duplicates(docs(spark, [])).count() == 0


def test_linked_sets_share_one_of_their_rarest_elements():
    rng = random.Random(3)
    for percent in (80, 90):
        for a in range(1, 400, 7):
            for b in ngj.partner_sizes(a, percent):
                # Neither may miss more of the other than its rarest elements are, less one.
                assert ngj.rarest(a, percent) > a - ngj.least_overlap(a, b, percent)
                assert ngj.rarest(b, percent) > b - ngj.least_overlap(a, b, percent)
        for _ in range(300):
            a = rng.randrange(1, 120)
            b = rng.choice(list(ngj.partner_sizes(a, percent)))
            common = ngj.least_overlap(a, b, percent)
            order = rng.sample(range(a + b - common), a + b - common)
            first, second = sorted(order[:a]), sorted(order[a - common :])
            assert set(first[: ngj.rarest(a, percent)]) & set(second[: ngj.rarest(b, percent)])
    assert ngj.light_boundary({}, 90) == 0
    # One subset of nine elements costs less than a posting; of twelve there are thirteen.
    assert ngj.light_boundary({9: 1000, 500: 1}, 90) == 9
    assert ngj.light_boundary({12: 1000, 500: 1}, 90) == 0


def test_shared_passages_do_not_bring_sets_together(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    texts = [" ".join([*(f"d{n}w{i}" for i in range(150)), passage, f"end{n}"]) for n in range(40)]
    levels = ngj.bucket_levels(docs(spark, list(enumerate(texts))).repartition(5), 5)
    assert len(levels) == ngj.BUCKETS and levels.max() == int(6 * np.log2(41))
    h, ends = ngj.shingle_sets(pa.array(texts), 5)
    _, keys = ngj._keys(h, ends, 0, 80, levels)
    assert len(set(keys.tolist())) == len(keys) == 40 * ngj.rarest(len(h) // 40, 80)


def _without_repeats(rows, least=50):
    data, first, out = {i: (t or "").encode() for i, t in rows}, {}, {}
    for i in sorted(data):
        for at in range(len(data[i]) - least + 1):
            first.setdefault(data[i][at : at + least], i)
    for i, b in data.items():
        gone = bytearray(len(b))
        for at in range(len(b) - least + 1):
            if first[b[at : at + least]] < i:
                gone[at : at + least] = b"\1" * least
        spans = sum(1 for at in range(len(b)) if gone[at] and (at == 0 or not gone[at - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone) if not y))
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    passages = ["".join(rng.choices("abcé ", k=rng.randrange(45, 300))) for _ in range(10)]
    rows = []
    for i in range(150):
        parts = [rng.choice(["".join(rng.choices("abcdefgh ", k=rng.randrange(90))), rng.choice(passages)[rng.randrange(30) :]]) for _ in range(rng.randrange(5))]
        rows.append((i * 7 - 100, "".join(parts)))
    rows += [(5000, None), (5001, ""), (5002, "a" * 3000), (5003, "b" + "a" * 900), (5004, "ab" * 700), (5005, "ba" * 300), (-5000, rows[60][1]), (5008, "x" * 50), (5009, "x" * 49), (5010, "x" * 50)]
    found = rep.without_repeats(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found} == _without_repeats(rows)
    twice = rep.without_repeats(docs(spark, [(1, "y" * 80), (1, "y" * 80), (None, "y" * 80), (2, "y" * 80)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in twice) == [(0, 0), (1, 0), (1, 0), (2, 80)]
    assert rep.without_repeats(docs(spark, [])).count() == 0


def test_maximal_repeats_are_repeats(spark):
    rows = [(1, "q" * 5 + "the passage that several documents share word for word, and more"), (2, "zz the passage that several documents share word for word, and less"), (3, "k")]
    text = {i: t.encode() for i, t in rows}
    groups = {}
    for r in rep.maximal_repeats(docs(spark, rows), 30).collect():
        groups.setdefault((r.bucket, r.repeat), set()).add(text[r.doc_id][r.start : r.start + r.length])
    assert groups and all(len(g) == 1 for g in groups.values())


def test_prefix_intervals_against_definition():
    rng = random.Random(1)
    for _ in range(50):
        common = np.array([0, *[rng.randrange(0, 6) for _ in range(12)]])
        want = set()
        for a, b in combinations(range(13), 2):
            length = int(common[a + 1 : b + 1].min())
            if length >= 2 and common[a] < length and (b == 12 or common[b + 1] < length):
                want.add((length, a, b))
        assert set(rep.prefix_intervals(common, 2)) == want


def test_scores_equal_exact_counts_and_beat_the_base(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(1000 + i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 80)))) for i in range(200)]
    rows += [(i, t) for i, t in EDGES if i is not None]
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    text = dict(rows)
    for options in ({}, {"shard_bytes": 200, "frequent": 8}):
        found = score_documents(docs(spark, rows), fold("doc_id", 7) != 2, **options).collect()
        assert len(found) == len(rows)
        for r in found:
            own = tokens(text[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[x] > 0 for x in own), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own))
            assert r.score <= 0
        assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert score_documents(docs(spark, []), F.lit(True)).count() == 0
    untrained = score_documents(docs(spark, rows[:3]), F.lit(False)).collect()
    assert [r.base_score for r in untrained] == [0.0] * 3


def test_language_model_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not Path(path).exists():
        pytest.skip("no test data")
    table = spark.read.parquet(path)
    model = crf.fit_language_model(table.where(fold("doc_id", 4) != 2))
    found = crf.with_language(table, model).where(fold("doc_id", 4) == 2).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 + 1e-9 for r in found)
    edges = crf.with_language(docs(spark, [*EDGES, (50, "123 ... 4")]), model)
    assert {r.doc_id: r.lang_pred for r in edges.where("doc_id in (1, 2, 3, 50)").collect()} == dict.fromkeys((1, 2, 3, 50), "und")
    assert crf.drop_rejected(docs(spark, EDGES), model).columns == docs(spark, EDGES).columns
    none = crf.fit_language_model(docs(spark, EDGES))
    assert {r.lang_pred for r in crf.with_language(docs(spark, EDGES), none).collect()} == {"und"}


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    scores, transitions = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    total = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        weight = math.exp(sum(scores[t, k] for t, k in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        for t, k in enumerate(path):
            total[t, k] += weight
    want = total / total.sum(1, keepdims=True)
    both = crf.forward_backward(np.concatenate([scores[:2], scores, scores[:1]]), np.array([2, 4, 1]), transitions)
    assert both[2:6] == pytest.approx(want)


def test_url_rules(spark):
    rows = [
        (1, "http://A.example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
        (2, "http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        (3, "ftp://b.com/", "b.com", "/", "com/"),
        (4, "http://b.com", "b.com", "", None),
        (5, "http://x.net/es/1", "x.net", "/es/1", "net/es/"),
        (6, "http://notexample.org/en/", "notexample.org", "/en/", None),
        (7, None, "", "", None),
        (8, "no scheme/com/", "", "", None),
        (9, "http://net/fr/?a://b", "net", "/fr/", "net/fr/"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "clash") for r in rows], "page_id long, url string, host string")
    found = {r.page_id: r for r in url.url_verdicts(pages, URL_RULES).collect()}
    for i, _, host, path, rule in rows:
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        if rule:
            assert found[i].verdict == next(k for k, r in URL_RULES if r == rule)
        assert found[i].verdict in ("allow", "block")
    assert url.url_verdicts(pages.limit(0), URL_RULES).count() == 0


def test_url_models_separate_held_out_labels(spark):
    rng = random.Random(6)
    good = ["".join(rng.choices("aeio", k=8)) for _ in range(300)]
    bad = ["".join(rng.choices("xzqk", k=8)) for _ in range(300)]
    rows = [(i, f"http://{w}.com/p") for i, w in enumerate(good)] + [(1000 + i, f"http://{w}.net/es/") for i, w in enumerate(bad)]
    rows += [(5000 + i, f"http://{''.join(rng.choices('aeio' if i % 2 else 'xzqk', k=9))}.org/p") for i in range(100)]
    found = url.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).where("page_id >= 5000")
    right = [(r.verdict == "allow") == (r.page_id % 2 == 1) for r in found.collect()]
    assert np.mean(right) > 0.9


def test_licenses(spark):
    rows = [*EDGES, (20, "intro.\nReleased under the MIT License.\nmore"), (21, "released UNDER the old mit license, the end"), (22, "this work is licensed under the gnu general public license version 3. " * 2), (23, "the the under license")]
    found = {r.doc_id: r for r in lic.scan_licenses(docs(spark, rows)).collect()}
    assert found[20].license == "MIT" and found[20].coverage == 1.0 and found[20]["at"] == 1
    assert found[21].license == "MIT"
    assert found[22].license == "GPL-3.0" and found[22]["at"] == 0
    assert all(found[i].license is None and found[i].coverage == 0 for i in (1, 2, 3, 4, 23))
    assert lic.scan_licenses(docs(spark, EDGES), []).count() == len(EDGES)
    assert lic.patience_pairs([1, 9, 2, 3, 9, 4], [1, 2, 3, 4]) == [(0, 0), (2, 1), (3, 2), (5, 3)]
    assert lic.increasing_run([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])


def test_warc_records(spark, tmp_path):
    html = '<html lang="fr"><head><title>T &amp; t</title></head><body><p>Eins<br>zwei &amp;lt;</p><script>x</script><a href="/q">l</a></body></html>'
    rows = [("<urn:uuid:1>", "http://a/", html), ("<urn:uuid:2>", None, None), (None, "http://b/", "x")]
    responses = spark.createDataFrame(rows, "record_id string, target_uri string, payload string").withColumns({"date": F.lit("2024-01-01T00:00:00Z"), "content_type": F.lit("text/html")})
    records = warc.derivatives(responses)
    found = {(r.refers_to, r.type): r for r in records.collect()}
    assert set(found) == {(i, t) for i in ("<urn:uuid:1>", "<urn:uuid:2>") for t in ("metadata", "conversion")}
    text = found["<urn:uuid:1>", "conversion"]
    assert text.block == "Eins\nzwei &lt;\nl"
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    assert text.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert "title: T & t\r\nlanguage: fr\r\noutlinks: 1\r\noutlink: /q\r\npayload-length: " in found["<urn:uuid:1>", "metadata"].block
    warc.write_warc(records, str(tmp_path / "out"), "none")
    whole = "".join(p.read_bytes().decode() for p in (tmp_path / "out").glob("part-*"))
    assert whole.count("WARC/1.1\r\n") == 4 and whole.count("WARC-Refers-To: <urn:uuid:1>\r\n") == 2
    assert whole.count("WARC-Target-URI") == 2 and whole.endswith("\r\n\r\n")


def test_pipeline_stages_equal_brute_force(spark):
    sf_dir = Path("/root/testdata/sf0.001")
    if not sf_dir.exists():
        pytest.skip("no test data")
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    table = spark.read.parquet(str(sf_dir / "documents.parquet"))
    known = crf.drop_rejected(table, crf.fit_language_model(table.where(fold("doc_id", 4) != 2))).collect()
    assert len(known) >= table.count() - 2
    last = {r.text: r.doc_id for r in sorted(known, key=lambda r: r.doc_id)}
    sets = {i: _shingles(t, 5) for t, i in last.items()}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((a, b))
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
    text = {i: t for t, i in last.items()}
    grams = set()
    for r in spark.read.parquet(str(sf_dir / "benchmark.parquet")).collect():
        w = _dec_words(r.text)
        grams |= {tuple(w[at : at + 10]) for at in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    clean = set()
    for i in (i for i in root if root[i] == i):
        w = _dec_words(text[i])
        if not any(tuple(w[at : at + k]) in grams for k in sizes for at in range(len(w) - k + 1)):
            clean.add(i)
    found = corpus_pipeline.run(spark, str(sf_dir)).collect()
    assert {r.doc_id for r in found} == clean
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in found)
