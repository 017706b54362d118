"""Near-duplicate classes by an n-gram Jaccard join, size-aware, split into light and heavy sets.

A document's set holds the hashes (64 bits) of its distinct word shingles; a shorter text is one
shingle. Two sets link when 100 * |A n B| >= `percent` * |A u B|.

1. Equal sets collapse to one node, so copies are never paired.
2. Linked sets differ in a bounded number of elements, which gives keys that both must share:
   light sets (up to a boundary) list all subsets of the smallest overlap sizes that a partner can have;
   heavy sets are put in the inverted lists of their rarest elements, one more than can be missing from a
   partner. As all sets order elements alike, linked ones have one of these in common. Sets just below
   the boundary do both. The boundary is the one of least cost for the table's set sizes.
   Elements are ordered by how often those with the same `BUCKETS`-valued hash occur in all sets, then by
   hash: lines and passages that many documents share come last, so they do not bring sets together.
3. Lists of at least two sets are scanned, cut where sizes leave a gap that no link bridges; of lists that hold
   the same sets, one.
4. Inside a list, sets are compared by sketches: bit maps that differ in no more bits than the sets in
   elements, so no link is lost. What passes ties sets to groups that are nearly all linked; only the texts of
   these travel on. Lists too long for one task are cut like the groups of step 5.
5. These groups are verified with the texts, by scanning the inverted lists of their elements. Links that
   form a spanning forest come out, and on demand every set's number of links, all of them counted.
   Groups of more than `BLOCK_BYTES` are cut by set size into blocks, and pairs of blocks whose sizes can
   link are verified on their own.

NULL and blank texts have an empty set and link with nothing, not with each other. Rows repeated in
whole are copies of each other. Of rows without an id, `component_id` is the smallest id of the class,
or NULL if it has none. Sets find their texts by a hash of id and text, so neither rows without an id nor
different texts under one id are taken for one another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partition_audit.llm.buffers import (
    bounded_slices,
    lowered,
    mixed,
    prefix_sums,
    span_hashes,
    text_buffer,
    word_spans,
)
from partition_audit.llm.components import connected_components
from partition_audit.llm.shared import bounded_batches, discard, give_back_memory, some_text, written

BLOCK_BYTES = 4 << 20
# Text shingled at a time: about 50 times as much memory is used for it.
TEXT_BYTES = 1 << 20
SHORT_LIST = 100_000
# Cost of a posting of a heavy set against one of a light set: its list is less selective.
HEAVY_POSTING = 4
# Shingles are counted by hash bucket; the levels that come of it are a byte each.
BUCKETS = 1 << 24
COUNT_BLOCK = 1 << 12
COUNT_TASKS = 64
LEVELS_PER_DOUBLING = 6
DIGEST = ["n_shingles", "d1", "d2"]

C1, C2, C3, C4 = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and where each begins."""
    data, places = text_buffer(texts)
    data = lowered(data)
    begin, end, text = word_spans(data, places)
    words = span_hashes(prefix_sums(data), begin, end)
    count = np.bincount(text, minlength=len(texts))
    first = np.cumsum(count) - count
    # A text shorter than a shingle is a shingle of its own kind, by its number of words.
    shingles = np.maximum(np.where(count > 0, count - width + 1, 0), np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), shingles)
    at = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(len(owner))
    last = first + count
    h = np.full(len(at), width, np.uint64)
    h = np.where(count[owner] < width, count[owner].astype(np.uint64), h)
    for step in range(width):
        there = at + step < last[owner]
        word = words[np.minimum(at + step, len(words) - 1)] if len(words) else words
        h = np.where(there, mixed(h * C1 + word), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each set's values, modulo 2**64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[ends[1:]] - total[ends[:-1]]


def _digests(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sums(mixed(h ^ C2), ends).view(np.int64), _sums(mixed(h ^ C3), ends).view(np.int64)


def set_sizes(docs: DataFrame, width: int, sketched: bool = False) -> DataFrame:
    """`docs` with n_shingles and two digests of the set, on demand with its sketch."""
    names = [*DIGEST, "sketch"] if sketched else DIGEST

    @F.arrow_udf("struct<n_shingles:bigint,d1:bigint,d2:bigint" + (",sketch:binary>" if sketched else ">"))
    def digest(texts: pa.Array) -> pa.Array:
        parts, maps = [], []
        for batch in bounded_slices([pa.RecordBatch.from_arrays([texts], ["text"])], limit=TEXT_BYTES):
            h, ends = shingle_sets(batch.column(0), width)
            parts.append((np.diff(ends), *_digests(h, ends)))
            if sketched:
                maps.extend(sketches(h, ends))
        give_back_memory()
        columns = [pa.array(np.concatenate(x)) for x in zip(*parts)] or [pa.array([], pa.int64())] * 3
        return pa.StructArray.from_arrays([*columns, *([pa.array(maps, pa.binary())] if sketched else [])], names)

    kept = [f"`{c}`" for c in docs.columns]
    found = bounded_batches(docs).select(*kept, digest(some_text()).alias("__set"))
    return found.select(*kept, *[F.col(f"__set.{c}").alias(c) for c in names])


def least_overlap(a: int, b: int, percent: int) -> int:
    """100 i >= percent (a + b - i), solved for i."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, percent: int) -> list[int]:
    """Overlaps that a set of n elements needs with its possible partners."""
    return sorted({least_overlap(n, b, percent) for b in partner_sizes(n, percent)})


def rarest(n, percent: int):
    """Elements of a set of n (number or array) of which every partner has at least one."""
    return n + -percent * n // 100 + 1


def light_boundary(sizes: dict[int, int], percent: int) -> int:
    """Largest size whose sets list subsets: the cheapest boundary for {set size: sets}."""
    if not sizes:
        return 0
    order = sorted(sizes)
    heavy = {n: HEAVY_POSTING * sizes[n] * rarest(n, percent) for n in order}
    cost = least = sum(heavy.values())
    boundary = 0
    for n in order:
        cost += sizes[n] * sum(math.comb(n, c) for c in subset_sizes(n, percent)) - heavy[n]
        if cost <= least:
            boundary, least = n, cost
        elif cost > 2 * least:
            break
    return boundary


def _light_keys(values: np.ndarray, percent: int) -> np.ndarray:
    """Of every subset that could be the overlap with a partner."""
    n, parts = len(values), []
    total = values.sum(dtype=np.uint64)
    for size in subset_sizes(n, percent):
        left_out = np.array(list(combinations(range(n), n - size)), np.int64).reshape(math.comb(n, size), n - size)
        parts.append(mixed(total - values[left_out].sum(1, dtype=np.uint64) + np.uint64(size * int(C4) & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(parts)


def band_width(percent: int) -> float:
    """Of the logarithm of set sizes: linked sets are in one band or in neighbouring ones."""
    return math.log(1.001 * 100 / percent)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mixed(h ^ C4) & np.uint64(BUCKETS - 1)).astype(np.int64)


def bucket_levels(docs: DataFrame, width: int) -> np.ndarray:
    """For each hash bucket the logarithm of how often its shingles occur, as a byte.

    The array's size does not depend on the table. Every task counts its texts; counts are added up per block
    of buckets, so a frequent shingle is one number of each task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's count stops at 65,535: any order that all sets share gives the same links.
        seen = np.zeros(BUCKETS, np.uint16)
        for batch in bounded_slices(batches, limit=TEXT_BYTES):
            at, n = np.unique(_bucket(shingle_sets(batch.column(0), width)[0]), return_counts=True)
            seen[at] = np.minimum(seen[at] + n, 65535)
        give_back_memory()
        blocks = seen.reshape(-1, COUNT_BLOCK)
        held = np.flatnonzero(blocks.any(1))
        blobs = [pa.compress(blocks[i].tobytes(), "zstd", asbytes=True) for i in held]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(blobs, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(pa.decompress(blob, 2 * COUNT_BLOCK, "zstd", asbytes=True), np.uint16)
                total[block] = total.get(block, np.zeros(COUNT_BLOCK, np.uint64)) + counts
        levels = [np.minimum(LEVELS_PER_DOUBLING * np.log2(x + 1.0), 255).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(levels, pa.binary())], ["block", "levels"])

    counted = docs.select(some_text().alias("text")).mapInArrow(count, "block bigint, counts binary")
    summed = counted.repartition(COUNT_TASKS, "block").mapInArrow(add, "block bigint, levels binary")
    levels = np.zeros((BUCKETS // COUNT_BLOCK, COUNT_BLOCK), np.uint8)
    rows = summed.collect()
    for row in rows:
        levels[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    del rows
    give_back_memory()
    return levels.ravel()


def _keys(
    h: np.ndarray, ends: np.ndarray, boundary: int, percent: int, levels: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of every key."""
    size = np.diff(ends)
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i in np.flatnonzero((size > 0) & (size <= boundary)):
        found = _light_keys(mixed(h[ends[i] : ends[i + 1]] ^ C2), percent)
        owners.append(np.full(len(found), i))
        keys.append(found)
    heavy = size >= max(1, -(-percent * (boundary + 1) // 100))
    owner = np.repeat(np.arange(len(size)), size)
    mine = heavy[owner]
    h, owner = h[mine], owner[mine]
    # Hashes of a set are sorted, and both sorts are stable.
    order = np.lexsort((levels[_bucket(h)], owner))
    size = size * heavy
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    first = order[place < np.repeat(rarest(size, percent), size)]
    return np.concatenate([*owners, owner[first]]), np.concatenate([*keys, mixed(h[first] ^ C3)])


def _postings(docs: DataFrame, width: int, percent: int, boundary: int) -> DataFrame:
    """(key, node) of every key of every set, once for each slice of text that holds the set."""
    levels = docs.sparkSession.sparkContext.broadcast(bucket_levels(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, limit=TEXT_BYTES):
            h, ends = shingle_sets(batch.column(0), width)
            owner, key = _keys(h, ends, boundary, percent, levels.value)
            node = _digests(h, ends)[0][owner]
            order = np.lexsort((node, key))
            key, node = key[order].view(np.int64), node[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(node[new])], ["key", "node"])
        give_back_memory()

    return docs.select(some_text().alias("text")).mapInArrow(run, "key bigint, node bigint")


def _lists(postings: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(grp, node): inverted lists of at least two sets that can link by their sizes, one of those that hold the same sets.

    In the order of size, a list is cut where the next set is too large for any set before it. Lists of more than
    `SHORT_LIST` postings are left whole, so no list has to be sorted by one task beyond that.
    """
    several = (
        postings.groupBy("key")
        .agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("sum"))
        .where("lo < hi")
    )
    chosen = several.groupBy("lo", "hi", "n", "sum").agg(F.min("key").alias("key")).select("key", "n")
    members = postings.join(chosen, "key").select("key", "n", "node").distinct()
    sized = written(members.join(nodes.select(F.col("d1").alias("node"), "n_shingles"), "node"))
    order = Window.partitionBy("key").orderBy("n_shingles", "node")
    before, size = F.lag("n_shingles").over(order), F.col("n_shingles")
    cut = sized.where(F.col("n") <= SHORT_LIST).withColumn("cut", (F.coalesce(before, F.lit(0)) * 100 < size * percent).cast("int"))
    cut = cut.withColumns({"ends": F.coalesce(F.lead("cut").over(order), F.lit(1)), "part": F.sum("cut").over(order)})
    short = cut.where("cut = 0 or ends = 0").select(F.xxhash64("key", "part").alias("grp"), "node")
    return short.union(sized.where(F.col("n") > SHORT_LIST).select("key", "node"))


def sketches(h: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Of each set a bit map of 2 to 4 bits an element: element i flips bit hash(i) modulo the map's length.

    Two maps of one length differ in at most as many bits as the sets differ in elements. Lengths are 64 times a
    power of two, so a longer map is folded to a shorter one by the exclusive or of its halves.
    """
    size = np.diff(ends)
    bits = 64 << np.ceil(np.log2(np.maximum(2 * size, 64) / 64)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(size)), size)
    at = first[owner] + (mixed(h ^ C1) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=int(first[-1])).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


class _Forest:
    """Labels of items that are linked step by step."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, one: int, others: np.ndarray) -> np.ndarray:
        """Of `others` those that bring `one` to items it was not linked with, one for each such label."""
        labels, first = np.unique(self.label[others], return_index=True)
        new = labels != self.label[one]
        labels, first = labels[new], first[new]
        if len(labels):
            self.label[np.isin(self.label, labels)] = self.label[one]
        return others[first]


def _sketch_edges(rows: pa.Table, percent: int) -> np.ndarray:
    """Places (a, b) that tie together all rows whose sketches allow a link."""
    size = rows.column("n_shingles").to_numpy()
    side = rows.column("side").to_numpy()
    maps = rows.column("payload").to_pylist()
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    width = np.array([len(maps[i]) for i in order])
    folded: dict[int, np.ndarray] = {}
    for w in sorted(set(width.tolist()), reverse=True):
        # Rows of width w and all wider ones, folded; rows are in order of size, so these are the last rows.
        wider = np.flatnonzero(width > w)
        own = np.frombuffer(b"".join(maps[i] for i in order[width == w]), np.uint64).reshape(-1, w // 8)
        if len(wider):
            up = folded[int(width[wider[0]])]
            while up.shape[1] > w // 8:
                up = up[:, : up.shape[1] // 2] ^ up[:, up.shape[1] // 2 :]
            own = np.concatenate([own, up])
        folded[w] = own
    cross = side[0] > 0
    forest, edges, n = _Forest(len(size)), [], len(size)
    for p in range(n):
        last = int(np.searchsorted(size, 100 * size[p] // percent, "right"))
        q = np.arange(p + 1, last)
        q = q[(forest.label[q] != forest.label[p]) & (not cross or side[q] != side[p])]
        if not len(q):
            continue
        maps_here = folded[int(width[p])]
        shift = n - len(maps_here)
        apart = np.bitwise_count(maps_here[q - shift] ^ maps_here[p - shift]).sum(1, dtype=np.int64)
        most = size[q] + size[p] - 2 * (-(-percent * (size[q] + size[p]) // (100 + percent)))
        near = forest.join(p, q[apart <= most])
        edges.append(np.stack([np.full(len(near), p), near], 1))
    found = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    return order[found]


def _text_links(rows: pa.Table, width: int, percent: int, count: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that form a spanning forest of all links; and, on demand, how many rows each links with.

    Every set scans the inverted lists of its shingles. Without counts, sets that are linked already are left out.
    """
    texts = rows.column("payload").cast(pa.string()).combine_chunks()
    side = rows.column("side").to_numpy()
    copies = rows.column("copies").to_numpy()
    parts = [
        shingle_sets(batch.column(0), width)
        for batch in bounded_slices([pa.RecordBatch.from_arrays([texts], ["text"])], limit=TEXT_BYTES)
    ]
    h = np.concatenate([part[0] for part in parts])
    size = np.concatenate([np.diff(part[1]) for part in parts])
    ends = np.concatenate([[0], np.cumsum(size)])
    token = np.unique(h, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(size)), size)
    cross, held = side[0] > 0, np.zeros(len(size), np.int64)
    forest, links = _Forest(len(size)), []
    # Across two blocks the first block's sets look for those of the second.
    seekers = np.flatnonzero(side == 1) if cross else np.argsort(size, kind="stable")
    waiting = side == 2 if cross else np.ones(len(size), bool)
    indexed = None
    for p in seekers.tolist():
        if not cross:
            waiting[p] = False
        left = int(waiting.sum())
        if not left:
            break
        if indexed is None or left * 2 < indexed:
            mine = waiting[owner]
            order = np.argsort(token[mine], kind="stable")
            listed = owner[mine][order]
            at = np.concatenate([[0], np.cumsum(np.bincount(token[mine], minlength=int(token.max()) + 1))])
            indexed = left
        own = token[ends[p] : ends[p + 1]]
        length = at[own + 1] - at[own]
        place = np.repeat(at[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        common = np.bincount(listed[place], minlength=len(size))
        near = np.flatnonzero(waiting & (100 * common >= percent * (size + size[p] - common)))
        if count:
            held[p] += copies[near].sum()
            held[near] += copies[p]
        joined = forest.join(p, near)
        links.append(np.stack([np.full(len(joined), p), joined], 1))
    found = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
    return found, held


def _dealt(members: DataFrame, percent: int, limit: int) -> DataFrame:
    """`members` (node, n_shingles, grp, payload, copies) with the `bundle` and `pair` they are worked on in, and a `side`:
    0 where all are compared with one another, 1 and 2 where those of one block are compared with those of another.

    Small groups share bundles of about a quarter of `limit` bytes. A larger one is cut into bands of set sizes, so that linked
    sets are in one band or in neighbouring ones, and each band into blocks of `limit` bytes. Every pair of blocks
    that can hold a link is a bundle; only there is a row repeated, once for each block it meets.
    """
    banded = members.withColumn("band", F.floor(F.log("n_shingles") / band_width(percent)).cast("int"))
    sized = banded.groupBy("grp", "band").agg(F.sum(F.octet_length("payload")).alias("bytes"))
    groups = sized.groupBy("grp").agg(
        F.sum("bytes").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("bytes") / limit).cast("int")))).alias("blocks"),
    )
    groups = written(groups)
    total = groups.agg(F.sum("total")).first()[0] or 0
    bundles = 1 + 4 * total // limit
    rows = banded.join(groups, "grp")
    spread = F.pmod(F.xxhash64("grp"), F.lit(bundles))
    kept = ["grp", "node", "n_shingles", "copies", "payload"]
    small = rows.where(F.col("total") <= limit).select(*kept, spread.alias("bundle"), F.lit(0).cast("bigint").alias("pair"), F.lit(0).alias("side"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")[F.col("band")]).cast("int")
    meet = """flatten(array(
        transform(sequence(0, blocks[band] - 1), q -> struct(band as lb, least(own, q) as lp, band as hb, greatest(own, q) as hp, case when q = own then 0 when q > own then 1 else 2 end as side)),
        if(blocks[band + 1] is null, array(), transform(sequence(0, blocks[band + 1] - 1), q -> struct(band as lb, own as lp, band + 1 as hb, q as hp, 1 as side))),
        if(blocks[band - 1] is null, array(), transform(sequence(0, blocks[band - 1] - 1), q -> struct(band - 1 as lb, q as lp, band as hb, own as hp, 2 as side)))))"""
    large = rows.where(F.col("total") > limit).withColumn("own", own).withColumn("met", F.explode(F.expr(meet)))
    pair = F.xxhash64("grp", "met.lb", "met.lp", "met.hb", "met.hp")
    large = large.select(*kept, (-1 - F.pmod(pair, F.lit(1 << 60))).alias("bundle"), pair.alias("pair"), F.col("met.side").alias("side"))
    return small.unionByName(large)


def _tied(dealt: DataFrame, find: Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    """(a, b, n): linked nodes, and for nodes with b NULL how many rows they link with."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("pair", "ascending")])
        grp, pair = table.column("grp").to_numpy(), table.column("pair").to_numpy()
        node = table.column("node").to_numpy()
        cut = np.flatnonzero((grp[1:] != grp[:-1]) | (pair[1:] != pair[:-1])) + 1
        a, b, nodes, counts = [], [], [], []
        for first, last in zip([0, *cut.tolist()], [*cut.tolist(), len(grp)]):
            found, held = find(table.slice(first, last - first))
            a.append(node[first + found[:, 0]])
            b.append(node[first + found[:, 1]])
            if held is not None:
                some = np.flatnonzero(held)
                nodes.append(node[first + some])
                counts.append(held[some])
        give_back_memory()
        a, b, nodes, counts = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (a, b, nodes, counts))
        empty = [pa.nulls(len(nodes), pa.int64()), pa.nulls(len(a), pa.int64())]
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(a, pa.int64()), pa.array(nodes, pa.int64())]),
                "b": pa.concat_arrays([pa.array(b, pa.int64()), empty[0]]),
                "n": pa.concat_arrays([empty[1], pa.array(counts, pa.int64())]),
            }
        )

    return dealt.groupBy("bundle").applyInArrow(run, "a bigint, b bigint, n bigint")


def row_key() -> Column:
    """Of a row's id and text, with 128 bits."""
    text = some_text()
    return F.struct(F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.lit(1)).alias("k2"))


def jaccard_classes(
    docs: DataFrame, width: int = 5, percent: int = 80, count_links: bool = False
) -> tuple[DataFrame, DataFrame]:
    """`docs` with n_shingles, d1, d2; and (n_shingles, d1, d2, component_id, pick, repeats, n_links) of every linked set.

    `pick` is the row_key of the class's first row (by id, rows without one last, then by row_key), `repeats`
    the number of rows that have it. `n_links` is the number of other rows that a row of the set links with, its
    copies included, or NULL without `count_links`.
    """
    sized = set_sizes(docs, width)
    rows = (
        set_sizes(docs, width, sketched=True).where("n_shingles > 0")
        .select(*DIGEST, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row_key().alias("pick")).alias("row"), F.octet_length("text").alias("bytes"), "sketch")
        .groupBy(*DIGEST, "row")
        .agg(F.count(F.lit(1)).alias("repeats"), F.max("bytes").alias("bytes"), F.max("sketch").alias("sketch"))
    )
    first = F.struct("row.none", "row.doc_id", "row.pick", "repeats")
    nodes = written(
        rows.groupBy(*DIGEST)
        .agg(F.min(first).alias("first"), F.sum("repeats").alias("copies"), F.max("bytes").alias("bytes"), F.max("sketch").alias("sketch"))
        .withColumn("pick", F.col("first.pick"))
    )
    sizes = {r["n_shingles"]: r["count"] for r in nodes.groupBy("n_shingles").count().collect()}
    boundary = light_boundary(sizes, percent)
    postings = written(_postings(docs, width, percent, boundary))
    # Sets that share a key, then those of them whose sketches allow a link, then links by the texts.
    lists = _lists(postings, nodes, percent)
    members = nodes.join(lists, nodes["d1"] == lists["node"])
    sketched = written(members.select("grp", "node", "n_shingles", "copies", F.col("sketch").alias("payload")))
    discard(postings)
    alike = connected_components(
        _tied(_dealt(sketched, percent, BLOCK_BYTES), lambda rows: (_sketch_edges(rows, percent), None)).select("a", "b")
    )
    discard(sketched)
    members = nodes.join(alike.withColumnRenamed("component", "grp"), nodes["d1"] == alike["node"])
    texts = docs.select(row_key().alias("pick"), some_text().alias("payload"))
    of_sets = members.select("pick", "node", "n_shingles", "copies", "grp").join(texts, "pick").dropDuplicates(["pick", "node"])
    held = written(of_sets.select("grp", "node", "n_shingles", "copies", F.col("payload").cast("binary").alias("payload")))
    found = written(_tied(_dealt(held, percent, BLOCK_BYTES), _finder(width, percent, count_links)))
    linked = connected_components(found.where("b is not null").select("a", "b"))
    discard(held)
    member = nodes.join(linked, nodes["d1"] == linked["node"])
    least = member.groupBy("component").agg(F.min("first").alias("least"))
    classes = member.join(least, "component").select(*DIGEST, "copies", "least")
    single = nodes.join(linked, nodes["d1"] == linked["node"], "left_anti")
    classes = classes.union(single.where("copies > 1").select(*DIGEST, "copies", "first"))
    n_links = F.lit(None).cast("bigint")
    if count_links:
        counts = found.where("b is null").groupBy(F.col("a").alias("d1")).agg(F.sum("n").alias("n"))
        classes = classes.join(counts, "d1", "left")
        n_links = F.col("copies") - 1 + F.coalesce("n", F.lit(0))
    result = written(
        classes.select(
            *DIGEST, F.col("least.doc_id").alias("component_id"), "least.pick", "least.repeats", n_links.alias("n_links")
        )
    )
    for done in (nodes, found, linked, alike):
        discard(done)
    return sized, result


def _finder(width: int, percent: int, count: bool) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]]:
    def find(rows: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
        found, held = _text_links(rows, width, percent, count)
        return found, held if count else None

    return find


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, count_links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id of its class).

    With `count_links` also n_links: the number of other documents that it links with, copies included.
    """
    sized, classes = jaccard_classes(docs.select("doc_id", "text"), width, percent, count_links)
    found = sized.select("doc_id", *DIGEST).join(classes.select(*DIGEST, "component_id", "n_links"), DIGEST, "left")
    counts = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *counts)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of each class one row with its smallest doc_id, with all columns; others are not touched.

    Among different texts under that id, and in classes without an id, the smallest row_key is kept.
    """
    _, classes = jaccard_classes(docs.select("doc_id", "text"), width, percent)
    prefixed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    sized = set_sizes(prefixed, width)
    found = sized.join(classes.select(*DIGEST, "pick", "repeats"), DIGEST, "left")
    found = found.where(F.col("pick").isNull() | (row_key() == F.col("pick")))
    if classes.where("repeats > 1").isEmpty():
        kept = found.select("row")
    else:
        # Only rows with id and text of the class's first row are left, so a group is those alone.
        again = found.where("repeats > 1").groupBy("pick").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = found.where("repeats is null or repeats = 1").select("row").union(again.select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
