"""License scan: full texts, seeds against all windows, several licenses in one text."""

from __future__ import annotations

import random

import numpy as np
import pytest

from partition_audit.llm import license_scan as lic


def scanned(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in lic.scan_licenses(table).collect()}


def edited(text, seed):
    """The text with every thirtieth word changed, and others around it."""
    words = text.split()
    for i in range(seed, len(words), 30):
        words[i] = f"edit{i}"
    return f"Copyright 2020 some author\n{' '.join(words)}\nint main() {{ return 0; }}"


def test_edited_full_texts_and_headers(spark):
    texts = lic.license_texts()
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "ISC"} <= {n for n, _ in texts}
    found = scanned(spark, [(i, edited(text, 7)) for i, (_, text) in enumerate(texts)])
    assert {i: found[i].license for i in found} == {i: name for i, (name, _) in enumerate(texts)}
    assert all(0.9 < r.coverage < 1 and r.licenses == [r.license] for r in found.values())


def test_notices_are_told_apart(spark):
    found = scanned(spark, list(enumerate(text for _, text in lic.NOTICES)))
    for i, (name, _) in enumerate(lic.NOTICES):
        assert (found[i].license, found[i].coverage, found[i].licenses) == (name, 1.0, [name])


def test_word_that_is_rarest_elsewhere_and_second_license(spark):
    far = " ".join(f"w{i}" for i in range(40))
    twice = f"Released under the MIT Licence. {far} Released under the MIT Licence. {far} license"
    dual = f"Licensed under CC BY-NC 4.0. {far} Released under the MIT License. {far} Licensed under the Apache License, Version 2.0."
    found = scanned(spark, [(1, twice), (2, dual), (3, far), (4, None)])
    assert (found[1].license, found[1].coverage, found[1]["at"]) == ("MIT", 0.8, 0)
    assert found[2].licenses == ["CC-BY-NC-4.0", "MIT", "Apache-2.0"]
    assert [(found[i].license, found[i].licenses) for i in (3, 4)] == [(None, [])] * 2


@pytest.mark.parametrize("size", [1, 4, 5, 12, 20, 40])
def test_seeded_windows_equal_all_windows(size):
    rng = random.Random(size)
    for _ in range(30):
        template = np.array([rng.randrange(size) for _ in range(size)])
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [rng.randrange(-1, size + 3) for _ in range(rng.randrange(2 * size + 9))]
            text += [w if rng.random() < 0.85 else -1 for w in template.tolist()]
        step, lengths = lic.windows(size)
        want = set()
        for length in lengths:
            for begin in range(0, len(text), step):
                pairs = lic.patience_pairs(text[begin : begin + length], template.tolist())
                if len(pairs) >= 0.7 * size:
                    want.add(tuple(begin + at for at, _ in pairs))
        assert {tuple(x) for x in lic.occurrences(np.array(text), template, 0.7)} == want
