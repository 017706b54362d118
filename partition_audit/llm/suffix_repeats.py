"""Repeated byte strings across documents, from suffix arrays of text that is dealt out by minimizers.

Every string of `least` bytes is assigned to its minimizer, the smallest hash of the `GRAM`-byte grams in
it, and neighbouring strings with the same minimizer travel as one run of text. Equal strings have equal
minimizers, so all occurrences of a string meet in one bucket, and every bucket is worked on alone:

* the strings of its runs that occur more than once form an enhanced suffix array (sorted suffixes with
  the lengths of their common prefixes, up to the run's end),
* a stack scan finds the common-prefix interval tree above `least`,
* an interval whose members are preceded by different bytes, or start a run, cannot be extended to the
  left: it is a maximal repeat of its bucket, and its members are all the occurrences.

Of runs that are equal inside a slice of a task only those of the smallest document travel; the others
are known to be repeats there, so a passage of a third of all documents costs one run per slice.
Buckets are as many as the text's size asks for. Minimizers are counted in SLOTS slots beforehand, in a part of
the documents; strings of slots that would fill a bucket (`HOT_BYTES`) are told apart by their second minimizer
too, the smallest of another hash of their grams of other slots, which equal strings share as well. Results do not depend on
which slots those are. Where the longest repeats leave a run, they come out as
overlapping pieces, and their union is exact.

NULL texts count as empty. Rows without an id neither remove nor lose anything. Rows repeated in whole
do not remove each other's bytes, since no id is smaller. Ids are meant to tell texts apart; of different
texts under one id, each loses the places found in any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partition_audit.llm.buffers import SLICE_BYTES, bounded_slices, mixed, prefix_sums, span_hashes, text_buffer
from partition_audit.llm.shared import text_bytes

GRAM = 8
BUCKET_BYTES = 1 << 20
# Text whose runs are combined and packed together inside a task.
PACK_BYTES = 16 << 20
# A run holds up to 2 * least - GRAM bytes, and its size travels in one byte.
LONGEST_LEAST = 131
SPREAD = np.uint64(0x9FB21C651E98DF25)
# Slots that minimizers are counted in, the part of the documents they are counted in, and the bytes a slot may hold.
SLOTS = 1 << 20
COUNTED_PART = 16
HOT_BYTES = 8 << 20
SECOND = np.uint64(0xD1B54A32D192ED03)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place; the last GRAM - 1 places are left out."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64) | data[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    return mixed(eight * SPREAD)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values."""
    step, low = 1, h
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def slot_of(minimizer: np.ndarray) -> np.ndarray:
    return (mixed(minimizer ^ SECOND) % np.uint64(SLOTS)).astype(np.int64)


def runs_of(
    data: np.ndarray, places: np.ndarray, least: int, hot: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, text number, minimizer) of every run.

    Strings of `hot` slots (a flag per slot) have a mix of both minimizers in place of the first.
    """
    width = least - GRAM + 1
    h = gram_hashes(data)
    if len(h) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    low = window_minima(h, width)
    if hot is not None:
        low = _told_apart(h, low, width, hot)
    inside = np.zeros(len(low), bool)
    size = np.diff(places)
    text = np.flatnonzero(size >= least)
    edges = np.zeros(len(low) + 1, np.int64)
    np.add.at(edges, places[text], 1)
    np.add.at(edges, places[text] + size[text] - least + 1, -1)
    inside = np.cumsum(edges[:-1]) > 0
    cut = np.ones(len(low), bool)
    cut[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
    cut[places[text]] = True
    begin = np.flatnonzero(cut & inside)
    end = np.flatnonzero(inside & np.append(cut[1:] | ~inside[1:], True)) + 1
    # Text that repeats itself keeps its minimizer; such runs are cut to the usual length.
    pieces = -(-(end - begin) // width)
    first = np.repeat(begin, pieces) + width * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.minimum(np.repeat(end, pieces) - first, width)
    return first, count, np.searchsorted(places, first, "right") - 1, low[first]


def _told_apart(h: np.ndarray, low: np.ndarray, width: int, hot: np.ndarray) -> np.ndarray:
    """`low`, with a mix of first and second minimizer where a string's slot is hot.

    Grams of hot slots are no second minimizers: the first would often be the second too.
    """
    # Neighbours mostly share their minimizer, so slots are looked up once per change.
    change = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    crowded = hot[slot_of(low[change])]
    if not crowded.any():
        return low
    begin, n = change[crowded], np.diff(np.append(change, len(low)))[crowded]
    # The grams of each stretch of strings, one stretch after another; minima across two of them are passed over.
    grams = h[_ragged(begin, n + width - 1)]
    second = window_minima(np.where(hot[slot_of(grams)], np.uint64(2**64 - 1), mixed(grams * SECOND)), width)
    at = np.cumsum(n + width - 1) - (n + width - 1)
    place = _ragged(begin, n)
    low = low.copy()
    low[place] = mixed(low[place] ^ mixed(second[_ragged(at, n)]))
    return low


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the given stretches, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _packed(columns: list[np.ndarray]) -> bytes:
    """Integer columns by byte planes, compressed; the first column is the text as it is."""
    plain = b"".join(
        c.tobytes() if c.dtype == np.uint8 else c.view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns
    )
    return pa.Codec("zstd", 6).compress(plain, asbytes=True)


def _unpacked(blob: bytes, size: int, n: int) -> tuple[np.ndarray, ...]:
    """Text bytes, left bytes (256: none), text sizes, ids and starts."""
    plain = np.frombuffer(pa.decompress(blob, size + 15 * n, "zstd", asbytes=True), np.uint8)
    at, columns = size, [plain[:size]]
    for kind in (np.uint16, np.uint8, np.int64, np.int32):
        width = np.dtype(kind).itemsize
        planes = plain[at : at + width * n].reshape(width, n).T
        columns.append(np.ascontiguousarray(planes).view(kind)[:, 0])
        at += width * n
    columns[3] = np.cumsum(columns[3])
    return tuple(columns)


PARCEL = "bucket bigint, blob binary, size bigint, n bigint, doc bigint, low int, high int"


def _parcel(parts: list[tuple], buckets: int) -> pa.RecordBatch:
    data, first, size, left, h, bucket, doc, start = (np.concatenate([p[i] for p in parts]) for i in range(8))
    # The smallest document of each run's text travels, with all its places.
    order = np.lexsort((doc, h))
    new = np.ones(len(order), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    leader = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    repeat = np.zeros(len(order), bool)
    repeat[order] = doc[order] > doc[leader]
    known = _by_doc(doc[repeat], start[repeat], (start + size)[repeat])
    keep = np.flatnonzero(~repeat)
    keep = keep[np.lexsort((start[keep], doc[keep], bucket[keep]))]
    cuts = np.flatnonzero(np.diff(bucket[keep])) + 1
    packed: list[tuple] = []
    for a, b in zip([0, *cuts], [*cuts, len(keep)]):
        if b > a:
            mine = keep[a:b]
            columns = [
                data[_ragged(first[mine], size[mine])],
                left[mine],
                size[mine].astype(np.uint8),
                np.diff(doc[mine], prepend=0),
                start[mine].astype(np.int32),
            ]
            packed.append((int(bucket[mine[0]]), _packed(columns), int(size[mine].sum()), b - a))
    n, m = len(packed), len(known[0])

    def column(i: int, kind: pa.DataType) -> pa.Array:
        return pa.array([p[i] for p in packed] + [None] * m, kind)

    def stretch(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(n, np.int64), x]), kind, mask=np.arange(n + m) < n)

    # Known stretches are dealt to groups of their own, below zero.
    dealt = pa.array([p[0] for p in packed] + [-1 - i % buckets for i in range(m)], pa.int64())
    parcels = [dealt, column(1, pa.binary()), column(2, pa.int64()), column(3, pa.int64())]
    stretches = [stretch(x, kind) for x, kind in zip(known, (pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*parcels, *stretches], ["bucket", "blob", "size", "n", "doc", "low", "high"])


def hot_slots(docs: DataFrame, least: int) -> np.ndarray | None:
    """Flags of the slots whose runs would hold more than HOT_BYTES, by every COUNTED_PART-th document; None without any.

    Only sums per slot leave the tasks, and SLOTS numbers at most reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in bounded_slices(batches):
            data, places = text_buffer(batch.column("text"))
            _, n, _, low = runs_of(data, places, least)
            slots, at = np.unique(np.concatenate([slots, slot_of(low)]), return_inverse=True)
            sizes = np.bincount(at, np.concatenate([sizes, n + least - 1]), len(slots)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sizes)], ["slot", "bytes"])

    part = docs.where(f"doc_id is not null and text is not null and pmod(xxhash64(doc_id, 'part'), {COUNTED_PART}) = 0")
    sums = part.select("text").mapInArrow(count, "slot bigint, bytes bigint").groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    found = sums.where(F.col("bytes") * COUNTED_PART > HOT_BYTES).select("slot").toArrow()["slot"].to_numpy()
    if not len(found):
        return None
    flags = np.zeros(SLOTS, bool)
    flags[found] = True
    return flags


def _deal(docs: DataFrame, least: int, buckets: int) -> DataFrame:
    """Parcels of runs by bucket, and the stretches (doc, low, high) already known to be repeats."""
    if not GRAM <= least <= LONGEST_LEAST:
        raise ValueError(f"least must be between {GRAM} and {LONGEST_LEAST}")
    shared = docs.sparkSession.sparkContext.broadcast(hot_slots(docs, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0
        for batch in bounded_slices(batches):
            data, places = text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            first, count, text, low = runs_of(data, places, least, shared.value)
            end = first + count + least - 1
            left = np.where(first > places[text], data[first - 1] if len(first) else first, 256).astype(np.uint16)
            h = span_hashes(prefix_sums(data), first, end)
            bucket = (mixed(low + SPREAD) % np.uint64(buckets)).astype(np.int64)
            start = first - places[text]
            parts.append((data.copy(), first + size, end - first, left, h, bucket, ids[text], start))
            size += len(data)
            if size >= PACK_BYTES:
                yield _parcel(parts, buckets)
                parts, size = [], 0
        if parts:
            yield _parcel(parts, buckets)

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(run, PARCEL)


def _merged(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each text joined where they overlap or touch."""
    order = np.lexsort((low, text))
    text, low, high = text[order], low[order], high[order]
    if not len(text):
        return text, low, high
    base = text.astype(np.int64) << 40
    reach = np.maximum.accumulate(base + high)
    new = np.ones(len(text), bool)
    new[1:] = base[1:] + low[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text)) - 1
    return text[at], low[at], reach[last] - base[last]


def suffix_array(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and each one's common prefix with the one before it (0 for the first)."""
    size = end - begin
    columns = []
    for at in range(0, width, 8):
        # Eight bytes as a big-endian number order as the bytes do; past the end they are zero.
        word = np.zeros(len(begin), np.uint64)
        for step in range(at, at + 8):
            inside = step < size
            byte = data[np.where(inside, begin + step, 0)].astype(np.uint64)
            word = word << np.uint64(8) | np.where(inside, byte, np.uint64(0))
        columns.append(word)
    order = np.lexsort((size, *columns[::-1]))
    size, common = size[order], np.zeros(len(begin), np.int64)
    equal = np.ones(max(len(begin) - 1, 0), bool)
    for word in columns:
        word = word[order]
        gap = word[1:] ^ word[:-1]
        alike = np.full(len(gap), 8)
        for byte in range(8):
            alike -= gap >= np.uint64(1 << 8 * byte)
        common[1:] += np.where(equal, alike, 0)
        equal &= gap == 0
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    return order, common


def prefix_intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of every common-prefix interval of at least `least`, by one stack scan."""
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (length, first)
    for i, length in enumerate(common.tolist()):
        first = i - 1
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            found.append((top, first, i - 1))
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))
    while stack:
        top, first = stack.pop()
        found.append((top, first, len(common) - 1))
    return found


def _stretch_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int | None) -> np.ndarray:
    """Hash of every run, or of each of its strings of `least` bytes; some runs at a time."""
    found = [np.zeros(0, np.uint64)]
    ends = np.cumsum(size)
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE_BYTES, "right")))
        n = size[low:high]
        text = data[_ragged(begin[low:high], n)]
        at = np.cumsum(n) - n
        sums = prefix_sums(text)
        if least is None:
            found.append(span_hashes(sums, at, at + n))
        else:
            place = _ragged(at, n - least + 1)
            found.append(span_hashes(sums, place, place + least))
        low = high
    return np.concatenate(found)


def _bucket_repeats(table: pa.Table, least: int) -> tuple[np.ndarray, ...]:
    """(group, length, doc, start, smallest doc) of every occurrence of the bucket's maximal repeats."""
    parts = [_unpacked(*x) for x in zip(table["blob"].to_pylist(), table["size"].to_pylist(), table["n"].to_pylist())]
    data, left, size, doc, start = (np.concatenate([p[i] for p in parts]) for i in range(5))
    size = size.astype(np.int64)
    begin = np.cumsum(size) - size
    # Equal runs are one run with several occurrences.
    _, shown, run = np.unique(_stretch_hashes(data, begin, size, None), return_index=True, return_inverse=True)
    by_run = np.argsort(run, kind="stable")
    at_run = np.concatenate([[0], np.cumsum(np.bincount(run, minlength=len(shown)))])
    smallest = np.minimum.reduceat(doc[by_run], at_run[:-1])
    often = (at_run[1:] - at_run[:-1] > 1) | False
    edge_byte = left[shown]

    # Suffixes that start a string found more than once.
    strings = size[shown] - least + 1
    owner = np.repeat(np.arange(len(shown)), strings)
    place = _ragged(begin[shown], strings)
    h = _stretch_hashes(data, begin[shown], size[shown], least)
    order = np.argsort(h)
    same = np.zeros(len(h), bool)
    equal = h[order][1:] == h[order][:-1]
    same[order[1:]] |= equal
    same[order[:-1]] |= equal
    same |= often[owner] & (place == begin[shown][owner])
    owner, place = owner[same], place[same]
    if not len(owner):
        return (np.zeros(0, np.int64),) * 5
    finish = (begin + size)[shown][owner]
    order, common = suffix_array(data, place, finish, int((finish - place).max()))
    owner, place, finish = owner[order], place[order], finish[order]

    # A lone suffix whose run occurs more than once is an interval too.
    intervals = prefix_intervals(common, least)
    # A byte before a run's first string belongs to another bucket: such members count as extendable by none.
    opens = place == begin[shown][owner]
    before = np.where(opens, -1 - np.arange(len(place)), data[np.maximum(place - 1, 0)])
    groups, length, first, last = [], [], [], []
    alone = np.flatnonzero(often[owner] & opens)
    for top, a, b in intervals:
        kinds = before[a : b + 1]
        if kinds.max() != kinds.min():
            length.append(top)
            first.append(a)
            last.append(b)
    length = np.concatenate([np.array(length, np.int64), (finish - place)[alone]])
    first, last = np.concatenate([np.array(first, np.int64), alone]), np.concatenate([np.array(last, np.int64), alone])
    members = _ragged(first, last - first + 1)
    group = np.repeat(np.arange(len(first)), last - first + 1)
    low = np.minimum.reduceat(smallest[owner[members]], np.cumsum(last - first + 1) - (last - first + 1)) if len(first) else first
    copies = (at_run[1:] - at_run[:-1])[owner[members]]
    occurrence = by_run[_ragged(at_run[:-1][owner[members]], copies)]
    offset = np.repeat(place[members] - begin[shown][owner[members]], copies)
    group = np.repeat(group, copies)
    return group, length[group], doc[occurrence], start[occurrence] + offset, low[group]


def maximal_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """(bucket, repeat, length, doc_id, start, first_doc): every occurrence of every maximal repeat.

    Places are bytes of the UTF-8 text. Copies of a run that stayed in their task are not listed apart
    from `repeated_stretches`, which has them.
    """
    return _repeats(_parcels(docs, least), least)


def _parcels(docs: DataFrame, least: int) -> DataFrame:
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // BUCKET_BYTES), 1)
    return _deal(docs, least, buckets)


def _repeats(parcels: DataFrame, least: int) -> DataFrame:
    def find(table: pa.Table) -> pa.Table:
        group, length, doc, start, low = _bucket_repeats(table, least)
        bucket = np.full(len(group), table["bucket"][0].as_py())
        return pa.table(
            [pa.array(x, pa.int64()) for x in (bucket, group, length, doc, start, low)],
            ["bucket", "repeat", "length", "doc_id", "start", "first_doc"],
        )

    schema = "bucket bigint, repeat bigint, length bigint, doc_id bigint, start bigint, first_doc bigint"
    return parcels.where("blob is not null").groupBy("bucket").applyInArrow(find, schema)


def repeated_stretches(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, lows, highs): stretches also found in a document with a smaller id; they may overlap."""

    def find(table: pa.Table) -> pa.Table:
        table = table.filter(table["blob"].is_valid()) if table["blob"].null_count else table
        empty = np.zeros(0, np.int64)
        doc, low, high = empty, empty, empty
        if table.num_rows:
            _, length, doc, start, first = _bucket_repeats(table, least)
            later = doc > first
            doc, low, high = _by_doc(doc[later], start[later], (start + length)[later])
        return pa.table([pa.array(doc, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["doc", "low", "high"])

    parcels = _parcels(docs, least)
    # Parcels and known stretches leave one pass over the texts; the latter pass through as they are.
    found = parcels.groupBy("bucket").applyInArrow(_either(find), "doc bigint, low int, high int")
    return found.groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")
    )


def _either(find):
    def run(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table.select(["doc", "low", "high"])
        return find(table)

    return run


def _by_doc(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, number = np.unique(doc, return_inverse=True)
    text, low, high = _merged(number, low, high)
    return ids[text] if len(ids) else ids, low, high


def without_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document."""

    @F.arrow_udf("struct<n_removed:bigint,n_spans:bigint,kept:binary>")
    def cut(texts: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        removed, spans, kept = [], [], []
        for text, low, high in zip(texts, lows, highs):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            n = len(data)
            low = np.minimum(low.values.to_numpy(), n)
            high = np.minimum(high.values.to_numpy(), n)
            depth = np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))[:n]
            gone = depth > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if n else 0)
            kept.append(data[~gone].tobytes())
        return pa.StructArray.from_arrays(
            [pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["n_removed", "n_spans", "kept"],
        )

    text = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.select("doc_id", text.alias("bytes"))
    joined = whole.join(repeated_stretches(docs, least), "doc_id", "left")
    nowhere = F.array().cast("array<int>")
    found = joined.select(
        "doc_id",
        F.octet_length("bytes").cast("bigint").alias("n_bytes"),
        cut("bytes", F.coalesce("lows", nowhere), F.coalesce("highs", nowhere)).alias("r"),
    )
    return found.select("doc_id", "n_bytes", "r.n_removed", "r.n_spans", "r.kept")
