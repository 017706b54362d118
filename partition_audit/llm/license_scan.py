"""License scan by patience alignment.

A text is compared with every template whose words it has enough of. An occurrence that covers `least` of
a template aligns one of its n - ceil(least * n) + 1 rarest words in the text, whichever these are, so
the windows around all places of these words are looked at. In each, the words that are unique both there and
in the template are anchors, the longest increasing run of anchors is kept, and the gaps between them are
aligned the same way. Coverage is the share of the template's words that are aligned.

Where occurrences share words (a two-clause license in a three-clause one) the one with more aligned words
has them; another counts if it still covers `least` of its template without them. All licenses that count
are listed, in the order of the text. The best has the highest coverage; ties go to the longer template,
then to the first place, then to the first template.

Windows of two sizes (1.5 and 3 template lengths) begin at every eighth of a template's length, at every
word for templates of less than 16 words.

NULL and empty texts, and texts without a license, have NULL as license, coverage 0 and an empty list.
Repeated rows get equal results.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partition_audit.llm.buffers import (
    NOT_WORD,
    bounded_slices,
    lowered,
    prefix_sums,
    span_hashes,
    text_buffer,
    word_spans,
)
from partition_audit.llm.shared import some_text

LEAST = 0.7
FOUND = ["license", "coverage", "at", "licenses"]

# Notices of public licenses.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    *[
        (name, f"This work is licensed under the GNU {kind} Public License, version {version}.")
        for name, kind, version in (
            ("GPL-2.0", "General", "2"),
            ("LGPL-2.1", "Lesser General", "2.1"),
            ("LGPL-3.0", "Lesser General", "3"),
            ("AGPL-3.0", "Affero General", "3"),
        )
    ],
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def license_texts() -> list[tuple[str, str]]:
    """Full texts (NAME.txt) and standard headers (NAME.header.txt) in `license_texts`."""
    files = sorted((resources.files(__package__) / "license_texts").iterdir(), key=lambda f: f.name)
    return [(f.name.removesuffix(".txt").removesuffix(".header"), f.read_text()) for f in files if f.name.endswith(".txt")]


TEMPLATES: list[tuple[str, str]] = [*NOTICES, *license_texts()]


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, places = text_buffer(texts)
    data = lowered(data)
    begin, end, text = word_spans(data, places, NOT_WORD)
    return span_hashes(prefix_sums(data), begin, end), text


def increasing_run(places: Sequence[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []  # smallest last value of a run of each length
    at, before = [], []
    for i, place in enumerate(places):
        k = bisect_left(tails, place)
        before.append(at[k - 1] if k else -1)
        tails[k : k + 1] = [place]
        at[k : k + 1] = [i]
    found, i = [], at[-1] if at else -1
    while i >= 0:
        found.append(i)
        i = before[i]
    return found[::-1]


def patience_pairs(text: Sequence[int], template: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template). Gaps without anchors match from their ends only."""
    pairs: list[tuple[int, int]] = []
    waiting = [(0, len(text), 0, len(template))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        mine, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {text[i]: i for i in range(a, b) if mine[text[i]] == 1}
        anchors = [(place[template[j]], j) for j in range(c, d) if theirs[template[j]] == 1 and template[j] in place]
        kept = [anchors[i] for i in increasing_run([x[0] for x in anchors])]
        if kept:
            pairs.extend(kept)
            low = (a, c)
            for i, j in [*kept, (b, d)]:
                waiting.append((low[0], i, low[1], j))
                low = (i + 1, j + 1)
    return sorted(pairs)


Places = list[int]  # of the aligned words in the text


def needed(size: int, least: float) -> int:
    """Aligned words that cover `least` of a template."""
    return max(1, math.ceil(least * size - 1e-9))


def windows(size: int) -> tuple[int, tuple[int, int]]:
    """Distance of the places where windows of a template of `size` words begin, and their lengths."""
    step = max(1, size // 8)
    return step, (size + size // 2 + step, 3 * size + step)


def seeded_windows(text: np.ndarray, template: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """(begin, end) of the windows that can cover `least`; words are numbers, -1 for those of no template."""
    count = np.bincount(text + 1, minlength=int(template.max()) + 2)[1:]
    rare = np.argsort(count[template], kind="stable")[: len(template) - needed(len(template), least) + 1]
    seed = np.zeros(len(count) + 1, bool)
    seed[template[rare]] = True  # the last place is that of -1
    places = np.flatnonzero(seed[text])
    of_template = np.bincount(template, minlength=len(count))
    step, lengths = windows(len(template))
    for length in lengths:
        back = np.arange(-(-length // step))
        begins = np.unique(places // step - back[:, None]) * step
        for begin in begins[begins >= 0].tolist():
            held = text[begin : begin + length]
            held = held[held >= 0]
            if len(held) >= needed(len(template), least):
                own = np.unique(held)
                common = np.minimum(np.bincount(held, minlength=len(count))[own], of_template[own]).sum()
                if common >= needed(len(template), least):
                    yield begin, min(begin + length, len(text))


def occurrences(text: np.ndarray, template: np.ndarray, least: float) -> list[Places]:
    """Aligned places of all windows that cover `least` of the template, without repetitions."""
    words, found = template.tolist(), set()
    for begin, end in seeded_windows(text, template, least):
        pairs = patience_pairs(text[begin:end].tolist(), words)
        if len(pairs) >= needed(len(words), least):
            found.add(tuple(begin + at for at, _ in pairs))
    return [list(places) for places in sorted(found)]


def settled(found: list[tuple[int, Places]], sizes: Sequence[int], least: float) -> list[tuple[int, Places]]:
    """Of (template, places) those that cover `least` without the words of others that have more of them."""
    kept, taken = [], set()
    for i, places in sorted(found, key=lambda x: (-len(x[1]), sizes[x[0]], x[1][0], x[0])):
        if len(taken.intersection(places)) <= len(places) - needed(sizes[i], least):
            kept.append((i, places))
            taken.update(places)
    return kept


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """`docs` with license, coverage, at (number of the first aligned word, NULL without a license) and licenses."""
    names = [name for name, _ in templates]
    hashes, owner = _word_hashes(pa.array([text for _, text in templates], pa.string()))
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    wanted = [numbers[owner == i] for i in range(len(names))]
    sizes = [len(template) for template in wanted]
    used = [i for i, size in enumerate(sizes) if size]
    times = [np.bincount(template, minlength=len(vocabulary)) for template in wanted]

    @F.arrow_udf("struct<license:string,coverage:double,at:bigint,licenses:array<string>>")
    def scan(texts: pa.Array) -> pa.Array:
        results: list[tuple] = []
        for batch in bounded_slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
            h, text = _word_hashes(batch.column(0))
            word = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            word[vocabulary[word] != h] = -1
            held = np.unique(text[word >= 0] * len(vocabulary) + word[word >= 0])
            row_of, word_of = held // len(vocabulary), held % len(vocabulary)
            begin = np.searchsorted(text, np.arange(batch.num_rows + 1))
            found: dict[int, list[tuple[int, Places]]] = {}
            for i in used:
                has = np.bincount(row_of, times[i][word_of], batch.num_rows)
                for row in np.flatnonzero(has >= needed(sizes[i], least)).tolist():
                    own = occurrences(word[begin[row] : begin[row + 1]], wanted[i], least)
                    found.setdefault(row, []).extend((i, places) for places in own)
            for row in range(batch.num_rows):
                kept = settled(found.get(row, []), sizes, least)
                if not kept:
                    results.append((None, 0.0, None, []))
                    continue
                i, places = min(kept, key=lambda x: (-len(x[1]) / sizes[x[0]], -sizes[x[0]], x[1][0], x[0]))
                listed = dict.fromkeys(names[j] for j, _ in sorted(kept, key=lambda x: (x[1][0], x[0])))
                results.append((names[i], len(places) / sizes[i], places[0], list(listed)))
        types = [pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string())]
        columns = [pa.array([x[k] for x in results], kind) for k, kind in enumerate(types)]
        return pa.StructArray.from_arrays(columns, FOUND)

    kept = [f"`{c}`" for c in docs.columns if c not in FOUND]
    if not len(vocabulary):
        none = [F.lit(None).cast("string"), F.lit(0.0), F.lit(None).cast("bigint"), F.array().cast("array<string>")]
        return docs.select(*kept, *[column.alias(name) for column, name in zip(none, FOUND)])
    scanned = docs.select(*kept, scan(some_text()).alias("__found"))
    return scanned.select(*kept, *[f"__found.{name}" for name in FOUND])
