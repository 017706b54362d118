"""Byte-level BPE: encoding by ranked merges over distinct words, decoding by joining byte pieces.

Spark splits the texts into pattern matches; inside each task the distinct words of a slice become byte
arrays that are merged side by side: in every round each word merges its leftmost pair of lowest rank,
until no pair has a rank. A match that is a token of its own is not merged. Words longer than
`LONG_WORD` bytes merge through a heap, so no word costs the square of its length. Only the rank file,
whose size does not depend on the data, is broadcast.

NULL and empty texts have no ids. Special tokens have no meaning. Repeated rows get equal results.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partition_audit.llm.shared import bounded_batches, free_name, give_back_memory, some_text

LONG_WORD = 256
# Words of a slice, and places of words merged side by side; both take some tens of megabytes.
SLICE_WORDS = 1 << 18
MERGED_PLACES = 1 << 19
NO_RANK = np.int32(2**31 - 1)

# The pattern's \s is Unicode white space, Java's is not.
WHITE = r"\t-\r\x85\p{Z}"


@dataclass(frozen=True)
class Ranks:
    """tokens by rank; the rank of each pair of tokens that join to a token, sorted by pair."""

    tokens: list[bytes]
    pairs: np.ndarray
    merged: np.ndarray
    bytes_to_id: np.ndarray


def read_ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pairs, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.append(left << 32 | right)
                merged.append(rank)
    order = np.argsort(np.array(pairs, np.int64))
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Ranks(
        tokens,
        np.array(pairs, np.int64)[order],
        np.array(merged, np.int32)[order],
        np.array([ranks[bytes([b])] for b in range(256)], np.int32),
    )


def java_pattern(pattern: str) -> str:
    return (
        pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    )


def pattern_words(text: Column, pattern: str) -> Column:
    """All matches in order, each a word to encode on its own."""
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def pair_ranks(ranks: Ranks, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    keys = left.astype(np.int64) << 32 | right.astype(np.int64)
    at = np.minimum(np.searchsorted(ranks.pairs, keys), len(ranks.pairs) - 1)
    return np.where((ranks.pairs[at] == keys) & (left >= 0) & (right >= 0), ranks.merged[at], NO_RANK)


def _merged_side_by_side(ranks: Ranks, ids: np.ndarray) -> np.ndarray:
    """Rows of byte ids, filled up with -1, after all merges; still filled up with -1."""
    done = np.full(ids.shape, -1, np.int32)
    rows = np.arange(len(ids))
    rank = pair_ranks(ranks, ids[:, :-1], ids[:, 1:]).astype(np.int32)
    while len(rows):
        width = ids.shape[1]
        at = rank.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
        best = rank[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NO_RANK)
        still = best != NO_RANK
        if not still.all():
            done[rows[~still], :width] = ids[~still]
            rows, ids, rank, at, best = rows[still], ids[still], rank[still], at[still], best[still]
            if not len(rows):
                break
        each = np.arange(len(rows))
        ids[each, at] = best
        place = np.arange(width - 1)
        ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)
        if width == 2:
            rank = rank[:, :0]
            continue
        place = place[:-1]
        rank = np.take_along_axis(rank, place + (place >= at[:, None]), 1)
        has_right = at < width - 2
        rank[each[has_right], at[has_right]] = pair_ranks(
            ranks, ids[each, at][has_right], ids[each[has_right], at[has_right] + 1]
        )
        has_left = at > 0
        rank[each[has_left], at[has_left] - 1] = pair_ranks(
            ranks, ids[each[has_left], at[has_left] - 1], ids[each, at][has_left]
        )
    return done


def _merged_by_heap(ranks: Ranks, word: bytes) -> np.ndarray:
    """One long word: pairs wait in a heap by (rank, place); stale ones are passed over."""
    ids = ranks.bytes_to_id[np.frombuffer(word, np.uint8)].copy()
    first = pair_ranks(ranks, ids[:-1], ids[1:])
    heap = [(int(r), int(i)) for i, r in enumerate(first) if r != NO_RANK]
    heapq.heapify(heap)
    ids = ids.tolist()
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))

    def rank_at(i: int) -> int:
        j = after[i]
        if i < 0 or j >= len(ids) or ids[i] < 0:
            return int(NO_RANK)
        return int(pair_ranks(ranks, np.array([ids[i]]), np.array([ids[j]]))[0])

    while heap:
        rank, i = heapq.heappop(heap)
        if ids[i] < 0 or rank_at(i) != rank:
            continue
        j = after[i]
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (found := rank_at(k)) != NO_RANK:
                heapq.heappush(heap, (found, k))
    return np.array([x for x in ids if x >= 0], np.int32)


def encode_words(ranks: Ranks, words: pa.Array) -> pa.ListArray:
    """Ids of each (distinct) word."""
    words = words.cast(pa.large_binary())
    whole = pc.fill_null(pc.index_in(words, pa.array(ranks.tokens, pa.large_binary())), -1).to_numpy()
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    counts = np.where(whole >= 0, 1, 0).astype(np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word numbers, rows of ids)
    open_words = np.flatnonzero(whole < 0)
    low = 0
    for width in (4, 8, 12, 16, 24, 32, 64, 128, LONG_WORD):
        group = open_words[(sizes[open_words] > low) & (sizes[open_words] <= width)]
        low = width
        for part in np.array_split(group, max(1, len(group) * width // MERGED_PLACES)):
            if len(part):
                place = offsets[part][:, None] + np.arange(width)
                inside = np.arange(width) < sizes[part][:, None]
                ids = np.where(inside, ranks.bytes_to_id[data[np.where(inside, place, 0)]], -1)
                rows = _merged_side_by_side(ranks, ids.astype(np.int32))
                counts[part] = (rows >= 0).sum(1)
                parts.append((part, rows))
    for word in open_words[sizes[open_words] > LONG_WORD]:
        rows = _merged_by_heap(ranks, data[offsets[word] : offsets[word + 1]].tobytes())[None, :]
        counts[word] = rows.shape[1]
        parts.append((np.array([word]), rows))
    ends = np.concatenate([[0], np.cumsum(counts)])
    flat = np.empty(ends[-1], np.int32)
    flat[ends[:-1][whole >= 0]] = whole[whole >= 0]
    for part, rows in parts:
        held = rows >= 0
        flat[(ends[:-1][part][:, None] + np.cumsum(held, 1) - 1)[held]] = rows[held]
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`docs` with the column `ids`: the token ids as little-endian unsigned 32-bit integers.

    It replaces a column of that name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [f"`{c}`" for c in docs.columns if c.lower() != "ids"]
    split = bounded_batches(docs).select(*kept, pattern_words(some_text(), pattern).alias(free_name(docs, "words")))
    schema = docs.select(*kept, F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            first = 0
            ends = np.asarray(batch.column(batch.num_columns - 1).offsets)
            while first < batch.num_rows:
                last = int(np.searchsorted(ends, ends[first] + SLICE_WORDS, "right")) - 1
                last = min(max(last, first + 1), batch.num_rows)
                part = batch.slice(first, last - first)
                coded = part.column(part.num_columns - 1).flatten().dictionary_encode()
                ids = encode_words(ranks, coded.dictionary).take(coded.indices)
                at = ends[first : last + 1] - ends[first]
                places = np.asarray(ids.offsets)[at] if len(ids) else np.zeros(len(at), np.int64)
                flat = np.asarray(ids.flatten()).astype("<u4") if len(ids) else np.zeros(0, "<u4")
                out = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(),
                    last - first,
                    [None, pa.py_buffer((4 * (places - places[0])).astype(np.int64)), pa.py_buffer(flat)],
                ).cast(pa.binary())
                columns = [*part.columns[:-1], out]
                yield pa.RecordBatch.from_arrays(columns, schema=_arrow_names(part.schema, "ids"))
                first = last
            give_back_memory()

    return split.mapInArrow(run, schema)


def _arrow_names(schema: pa.Schema, last: str) -> pa.Schema:
    return pa.schema([*list(schema)[:-1], pa.field(last, pa.binary())])


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """`coded` with the column `decoded`: the bytes that the column `ids` stands for.

    It replaces a column of that name; NULL ids stand for no bytes.
    """
    shared = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path).tokens)
    others = [f"`{c}`" for c in coded.columns if c.lower() not in ("ids", "decoded")]
    schema = coded.select(*others, "ids", F.lit(b"").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            column = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2]
            ids = np.frombuffer(data, "<u4")[places[0] // 4 : places[-1] // 4] if data else np.zeros(0, "<u4")
            joined = pieces.take(pa.array(ids))
            ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
            out = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(column), [None, pa.py_buffer(ends[(places - places[0]) // 4]), joined.buffers()[2]]
            ).cast(pa.binary())
            fields = [*list(batch.schema), pa.field("decoded", pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, out], schema=pa.schema(fields))

    return bounded_batches(coded).select(*others, "ids").mapInArrow(run, schema)
