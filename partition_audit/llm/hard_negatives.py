"""Hard negatives by an STR-packed R-tree over integer vectors.

A row's score with an anchor is their integer inner product. An anchor's positives are its best-scoring other rows
of the same label. For each positive, its negatives are the best-scoring rows of other labels whose score lies in
a window that the positive's score sets. Higher scores come first, ties go to the smaller id.

1. The tree's upper part is sort-tile-recursive: rows are sliced by label, then by one coordinate after another (those
   of greatest variance first) into tiles of about `TILE_ROWS` rows. The cuts are fitted on at most `SAMPLE_ROWS` rows;
   every row is put in its tile, and a tile that comes out larger (repeated vectors, more than `MAX_TILES`) is dealt into
   parts. Tiles have bounding boxes, computed from all their rows; these are broadcast: at most `MAX_TILES` boxes.
2. A task that visits a part of a tile packs its rows by the same slicing into leaves of `LEAF_ROWS` rows, and leaves
   into nodes of `FANOUT` children, each with its bounding box.
3. A box bounds every coordinate, so each coordinate's product with the anchor lies in an interval, and their sums
   bound the score of every row below. A best-first queue takes nodes by that upper bound. It leaves out boxes that
   hold no row of a wanted label, whose bounds miss every window, or whose upper bound is strictly below the k-th
   score that is known.
4. Each anchor first visits the tile that promises most, which gives it a k-th score, then all tiles that this score
   does not rule out. An anchor's tiles are visited by different tasks, in blocks of at most `BLOCK_ANCHORS` anchors.

Rows with a NULL label, id or vector or a NULL or non-finite component take no part; rows repeated in whole count
once, and different rows under one id are rows of their own. A vector shorter than the longest one is taken as
zero in the components it lacks. Components beyond 64 bits are taken at that limit, and so are returned scores;
they are ranked exactly. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partition_audit.llm.shared import discard, written

TILE_ROWS = 4096
MAX_TILES = 4096
SAMPLE_ROWS = 20_000
LEAF_ROWS = 128
FANOUT = 16
BLOCK_ANCHORS = 8192
# Sums of products up to here are exact in double precision.
EXACT = 2**53
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def slices(labels: np.ndarray, vectors: np.ndarray, capacity: int) -> list[tuple[list, np.ndarray]]:
    """Sort-tile-recursive: (path of cuts, rows) of every tile of about `capacity` rows.

    The first dimension is the label, which gets a slice of its own for each value as long as tiles allow; then
    come coordinates by falling variance. A path is a list of (dimension, lowest value beyond the slice or None).
    """
    spread = np.argsort(-vectors.astype(float).var(0), kind="stable") if len(vectors) else np.zeros(0, np.int64)
    dims = [-1, *spread.tolist()]

    def cut(rows: np.ndarray, depth: int) -> Iterator[tuple[list, np.ndarray]]:
        tiles = -(-len(rows) // capacity)
        if tiles <= 1 or depth == len(dims):
            yield [], rows
            return
        dim = dims[depth]
        values = labels[rows] if dim < 0 else vectors[rows, dim]
        rows = rows[np.argsort(values, kind="stable")]
        values = np.sort(values, kind="stable")
        left = len(dims) - depth
        count = min(tiles, len(np.unique(values))) if dim < 0 else int(np.ceil(tiles ** (1 / left) - 1e-9))
        # Equal values stay in one slice, so that a row's tile follows from its values.
        ends = np.unique(np.searchsorted(values, values[np.arange(1, max(count, 2)) * len(rows) // max(count, 2)], "left"))
        ends = [e for e in ends.tolist() if e]
        for a, b in zip([0, *ends], [*ends, len(rows)]):
            beyond = int(values[b]) if b < len(rows) else None
            for path, own in cut(rows[a:b], depth + 1):
                yield [(dim, beyond), *path], own

    return list(cut(np.arange(len(labels)), 0))


@dataclass
class Cuts:
    """A tree of slices: rows go to the first slice whose end lies beyond their value."""

    dim: int = -1
    ends: list = field(default_factory=list)
    below: list = field(default_factory=list)
    tile: int | None = None

    @staticmethod
    def of(tiles: list[list]) -> Cuts:
        numbered = [(path, i) for i, path in enumerate(tiles)]

        def build(paths: list) -> Cuts:
            if len(paths) == 1 and not paths[0][0]:
                return Cuts(tile=paths[0][1])
            node, groups = Cuts(dim=paths[0][0][0][0]), {}
            for path, i in paths:
                groups.setdefault(path[0][1], []).append((path[1:], i))
            for end, own in groups.items():
                node.ends.append(end)
                node.below.append(build(own))
            return node

        return build(numbered)

    def assign(self, labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        found = np.zeros(len(labels), np.int32)

        def walk(node: Cuts, rows: np.ndarray) -> None:
            if node.tile is not None:
                found[rows] = node.tile
                return
            values = labels[rows] if node.dim < 0 else vectors[rows, node.dim]
            inner = np.array([e for e in node.ends if e is not None], np.int64)
            at = np.searchsorted(inner, values, "right")
            for k, below in enumerate(node.below):
                walk(below, rows[at == k])

        walk(self, np.arange(len(labels)))
        return found


@dataclass(frozen=True)
class Boxes:
    """Per box: least and greatest label and components."""

    label_lo: np.ndarray
    label_hi: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def score_bounds(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every box: sums of the intervals that each coordinate's product lies in."""
        up, down = np.maximum(vector, 0), np.minimum(vector, 0)
        return self.lo @ up + self.hi @ down, self.hi @ up + self.lo @ down

    def holds(self, label: int, same: bool) -> np.ndarray:
        """Boxes that can hold a row of the label, or of another one."""
        if same:
            return (self.label_lo <= label) & (self.label_hi >= label)
        return (self.label_lo != label) | (self.label_hi != label)

    def take(self, rows) -> Boxes:
        return Boxes(self.label_lo[rows], self.label_hi[rows], self.lo[rows], self.hi[rows])


def boxes_of(labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, groups: list[np.ndarray], label_hi=None) -> Boxes:
    label_hi = labels if label_hi is None else label_hi
    return Boxes(
        np.array([labels[g].min() for g in groups]),
        np.array([label_hi[g].max() for g in groups]),
        np.stack([lo[g].min(0) for g in groups]),
        np.stack([hi[g].max(0) for g in groups]),
    )


class Tree:
    """An R-tree packed by sort-tile-recursive slicing. Levels of boxes run from the leaves to the root's children."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        leaves = [rows for _, rows in slices(labels, vectors, LEAF_ROWS)]
        leaves = [part for rows in leaves for part in np.array_split(rows, -(-len(rows) // LEAF_ROWS))]
        order = np.concatenate(leaves)
        self.ids, self.keys, self.labels, self.vectors = ids[order], keys[order], labels[order], vectors[order]
        ends = np.cumsum([len(x) for x in leaves])
        self.leaves = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        boxes = boxes_of(self.labels, self.vectors, self.vectors, [np.arange(a, b) for a, b in self.leaves])
        self.levels, self.children = [boxes], []
        # Slices come out in order of place, so neighbours share a parent.
        while len(boxes.lo) > FANOUT:
            groups = np.array_split(np.arange(len(boxes.lo)), -(-len(boxes.lo) // FANOUT))
            self.children.append(groups)
            boxes = boxes_of(boxes.label_lo, boxes.lo, boxes.hi, groups, boxes.label_hi)
            self.levels.append(boxes)

    def search(self, anchor: Anchor) -> list[list[tuple[int, int, int]]]:
        """Per window its best rows (score, id, key), no more than `anchor.k`."""
        best = [[] for _ in anchor.lo]
        floor = list(anchor.floor)
        queue: list[tuple] = []

        def wanted(low, high) -> bool:
            return any(high >= f and low <= h for f, h in zip(floor, anchor.hi))

        def push(level: int, nodes: np.ndarray) -> None:
            boxes = self.levels[level].take(nodes)
            low, high = boxes.score_bounds(anchor.vector)
            ok = boxes.holds(anchor.label, anchor.same)
            for node, lower, upper, held in zip(nodes.tolist(), low.tolist(), high.tolist(), ok.tolist()):
                if held and wanted(lower, upper):
                    heapq.heappush(queue, (-upper, level, node, lower))

        push(len(self.levels) - 1, np.arange(len(self.levels[-1].lo)))
        while queue:
            upper, level, node, lower = heapq.heappop(queue)
            if not wanted(lower, -upper):
                continue
            if level:
                push(level - 1, self.children[level - 1][node])
                continue
            a, b = self.leaves[node]
            scores = self.vectors[a:b] @ anchor.vector
            same = self.labels[a:b] == anchor.label
            fit = same & (self.keys[a:b] != anchor.key) if anchor.same else ~same
            for w, hi in enumerate(anchor.hi):
                rows = np.flatnonzero(fit & (scores >= floor[w]) & (scores <= hi))
                if not len(rows):
                    continue
                if len(rows) > anchor.k:
                    kth = np.partition(scores[rows], -anchor.k)[-anchor.k]
                    rows = rows[scores[rows] >= kth]
                found = [(int(scores[r]), int(self.ids[a + r]), int(self.keys[a + r])) for r in rows.tolist()]
                best[w] = heapq.nsmallest(anchor.k, best[w] + found, key=lambda x: (-x[0], x[1], x[2]))
                if len(best[w]) == anchor.k:
                    # Rows of the k-th score itself still count: their ids may be smaller.
                    floor[w] = max(floor[w], best[w][-1][0])
        return best


@dataclass(frozen=True)
class Anchor:
    """What an anchor looks for: its label's rows or others, per window scores from `floor` (at least `lo`) to `hi`."""

    key: int
    label: int
    vector: np.ndarray
    same: bool
    k: int
    lo: list
    hi: list
    floor: list


def matrix(column: pa.Array, exact: bool) -> np.ndarray:
    """A list column of equally long lists. Double precision where that is exact, else Python's integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    values = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return values.astype(np.float64) if exact else values.astype(object)


def finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


REQUEST = "key bigint, label bigint, vector array<bigint>, lo array<bigint>, hi array<bigint>, floor array<bigint>"


class _Index:
    """Tiles of a table, their boxes, and visits to them."""

    def __init__(self, rows: DataFrame) -> None:
        """`rows`: key, id, label, vector, all of one length."""
        spark = rows.sparkSession
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).select("label", "vector").toArrow().combine_chunks()
        labels = sample.column("label").to_numpy()
        vectors = _whole(_chunk(sample, "vector")) if n else np.zeros((0, 0), np.int64)
        tiles = min(MAX_TILES, -(-n // TILE_ROWS))
        cuts = Cuts.of([path for path, _ in slices(labels, vectors, -(-len(labels) // tiles))])
        # Slicing rounds the number of slices up in every dimension.
        shared = spark.sparkContext.broadcast(cuts)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tile = shared.value.assign(batch.column("label").to_numpy(), _whole(batch.column("vector")))
                yield batch.append_column("tile", pa.array(tile, pa.int32()))

        kept = "key bigint, id bigint, label bigint, vector array<bigint>, tile int"
        tiled = written(rows.select("key", "id", "label", "vector").mapInArrow(assign, kept))
        self.boxes, counts, self.tile = _tile_boxes(tiled)
        self.parts = -(-counts // TILE_ROWS)
        # At most a row for each tile.
        parts = spark.createDataFrame(list(zip(self.tile.tolist(), self.parts.tolist())), "tile int, parts int")
        self.rows = tiled.join(F.broadcast(parts), "tile").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
        self.tiled = tiled
        reach = max((abs(int(x)) for x in (*self.boxes.lo.ravel().tolist(), *self.boxes.hi.ravel().tolist())), default=0)
        self.exact = reach * reach * max(1, self.boxes.lo.shape[1]) < EXACT

    def requests(self, anchors: DataFrame, same: bool, first: bool) -> DataFrame:
        """(tile, part) to visit of every anchor: the most promising tile, or all others that are not ruled out."""
        exact = self.exact
        kind = float if exact else object
        boxes = Boxes(self.boxes.label_lo, self.boxes.label_hi, self.boxes.lo.astype(kind), self.boxes.hi.astype(kind))
        shared = anchors.sparkSession.sparkContext.broadcast((boxes, self.parts, self.tile))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            boxes, parts, tile = shared.value
            for batch in batches:
                vectors, labels = matrix(batch.column("vector"), exact), batch.column("label").to_pylist()
                lo, hi, floor = (batch.column(c).to_pylist() for c in ("lo", "hi", "floor"))
                rows, tiles, at = [], [], []
                for i in range(batch.num_rows):
                    low, high = boxes.score_bounds(vectors[i])
                    ok = np.zeros(len(tile), bool)
                    promise = np.zeros(len(tile), kind)
                    for f, h, least in zip(floor[i], hi[i], lo[i]):
                        # The most promising tile is chosen by the windows alone, so that both visits agree on it.
                        ok |= (high >= f) & (low <= h)
                        promise = promise + np.where((high >= least) & (low <= h), np.minimum(high, h) - (0 if same else least) + 1, 0)
                    held = boxes.holds(labels[i], same)
                    if held.any():
                        best = int(np.flatnonzero(held)[np.argmax(promise[held])])
                        chosen = np.array([best]) if first else np.flatnonzero(held & ok & (np.arange(len(tile)) != best))
                        for t in chosen.tolist():
                            rows.extend([i] * int(parts[t]))
                            tiles.extend([tile[t]] * int(parts[t]))
                            at.extend(range(int(parts[t])))
                out = batch.take(pa.array(rows, pa.int64()))
                yield out.append_column("tile", pa.array(tiles, pa.int32())).append_column("part", pa.array(at, pa.int32()))

        return anchors.select("key", "label", "vector", "lo", "hi", "floor").mapInArrow(run, f"{REQUEST}, tile int, part int")

    def visit(self, anchors: DataFrame, same: bool, k: int, first: bool) -> DataFrame:
        """(key, window, score, id, row_key): the best rows of every visited part, k for each anchor and window."""
        exact = self.exact
        asked = written(self.requests(anchors, same, first))
        blocks = asked.groupBy("tile", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ANCHORS).cast("int").alias("blocks"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        rows = self.rows.join(blocks, ["tile", "part"]).select("tile", "part", every, "key", "id", "label", "vector")
        own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int").alias("block")
        asked = asked.join(blocks, ["tile", "part"]).select("tile", "part", own, "key", "label", "vector", "lo", "hi", "floor")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {c: [] for c in ("key", "window", "score", "id", "row_key")}
            if left.num_rows and right.num_rows:
                tree = Tree(*(left.column(c).to_numpy() for c in ("id", "key", "label")), matrix(_chunk(left, "vector"), exact))
                vectors = matrix(_chunk(right, "vector"), exact)
                columns = [right.column(c).to_pylist() for c in ("key", "label", "lo", "hi", "floor")]
                for i, (key, label, lo, hi, floor) in enumerate(zip(*columns)):
                    found = tree.search(Anchor(key, label, vectors[i], same, k, lo, hi, floor))
                    for w, best in enumerate(found):
                        for score, row, row_key in best:
                            for c, x in zip(out, (key, w, min(max(score, LOWEST), HIGHEST), row, row_key)):
                                out[c].append(x)
            return pa.table({c: pa.array(x, pa.int32() if c == "window" else pa.int64()) for c, x in out.items()})

        schema = "key bigint, window int, score bigint, id bigint, row_key bigint"
        group = ["tile", "part", "block"]
        return rows.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(run, schema)

    def best(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(key, window, rank, score, id, row_key): the k best rows of every anchor and window, in two visits."""
        order = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id", "row_key")

        def top(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        near = written(top(self.visit(anchors, same, k, True)))
        kth = near.groupBy("key", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        kth = kth.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kths"))
        raised = anchors.join(kth, "key", "left").withColumn(
            "floor", F.expr("transform(floor, (x, i) -> greatest(x, coalesce(kths[i], x)))")
        )
        found = written(top(near.drop("rank").unionByName(self.visit(raised, same, k, False))))
        discard(near)
        return found


def _chunk(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _tile_boxes(tiled: DataFrame) -> tuple[Boxes, np.ndarray, np.ndarray]:
    """Bounding box and number of rows of every tile: first per task, then per tile."""
    schema = "tile int, n bigint, label_lo bigint, label_hi bigint, lo array<bigint>, hi array<bigint>"

    def table(tiles: dict[int, list]) -> pa.Table:
        rows = [(t, *x) for t, x in tiles.items()]
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2]
        return pa.table([pa.array([list(v) for v in c] if pa.types.is_list(k) else list(c), k) for c, k in zip(columns, kinds)],
                        ["tile", "n", "label_lo", "label_hi", "lo", "hi"])

    def merge(tiles: dict[int, list], tile: np.ndarray, n, label_lo, label_hi, lo: np.ndarray, hi: np.ndarray) -> None:
        for t in np.unique(tile).tolist():
            rows = tile == t
            new = [int(n[rows].sum()), int(label_lo[rows].min()), int(label_hi[rows].max()), lo[rows].min(0), hi[rows].max(0)]
            if t in tiles:
                old = tiles[t]
                new = [old[0] + new[0], min(old[1], new[1]), max(old[2], new[2]), np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
            tiles[t] = new

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[int, list] = {}
        for batch in batches:
            vectors, label = _whole(batch.column("vector")), batch.column("label").to_numpy()
            if batch.num_rows:
                merge(tiles, batch.column("tile").to_numpy(), np.ones(batch.num_rows, np.int64), label, label, vectors, vectors)
        yield from table(tiles).to_batches()

    def per_tile(rows: pa.Table) -> pa.Table:
        tiles: dict[int, list] = {}
        merge(tiles, *(rows.column(c).to_numpy() for c in ("tile", "n", "label_lo", "label_hi")), _whole(_chunk(rows, "lo")), _whole(_chunk(rows, "hi")))
        return table(tiles)

    found = tiled.select("tile", "label", "vector").mapInArrow(per_task, schema).groupBy("tile").applyInArrow(per_tile, schema)
    found = found.orderBy("tile").toArrow().combine_chunks()
    if not found.num_rows:
        none = np.zeros(0, np.int64)
        return Boxes(none, none, none.reshape(0, 0), none.reshape(0, 0)), none, none
    boxes = Boxes(*(found.column(c).to_numpy() for c in ("label_lo", "label_hi")), *(_whole(_chunk(found, c)) for c in ("lo", "hi")))
    return boxes, found.column("n").to_numpy(), found.column("tile").to_numpy()


def _whole(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has id, label and vector; `anchors` is a condition on them. Components become floor(scale * x). A negative's
    score n fits a positive's score p when percent[0] * p <= 100 * n <= percent[1] * p; the first `negatives` that
    fit are returned, all where there are fewer.
    """
    spark = rows.sparkSession
    own = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite(F.col("vector")))
    own = own.select(
        F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), scaled(F.col("vector"), scale).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    own = own.groupBy("id", "label", "vector").agg(F.max("anchor").alias("anchor"))
    own = written(own.withColumn("key", F.monotonically_increasing_id()))
    longest = own.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], RESULT)
    missing = F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(max(longest, 1)) - F.size("vector"), F.lit(0)))
    own = own.withColumn("vector", F.concat("vector", missing))
    index = _Index(own)
    seeking = own.where("anchor")
    every, lowest = F.array(F.lit(HIGHEST)), F.array(F.lit(LOWEST))
    near = index.best(seeking.select("key", "label", "vector", lowest.alias("lo"), every.alias("hi"), lowest.alias("floor")), True, positives)
    # A window per positive: ceil(percent[0] p / 100) to floor(percent[1] p / 100), in decimals that do not overflow.
    low, high = (F.col("score").cast("decimal(20,0)") * F.lit(x).cast("decimal(10,0)") / 100 for x in percent)
    lists = near.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.ceil(low).cast("bigint").alias("lo"), F.floor(high).cast("bigint").alias("hi")))).alias("windows")
    )
    asked = seeking.join(lists, "key").select(
        "key", "label", "vector", F.col("windows.lo").alias("lo"), F.col("windows.hi").alias("hi"), F.col("windows.lo").alias("floor")
    )
    found = index.best(asked, False, negatives)
    pairs = near.select("key", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    result = written(
        found.select("key", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, ["key", "window"])
        .join(seeking.select("key", F.col("id").alias("anchor_id")), "key")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
    for done in (near, found, index.tiled):
        discard(done)
    return result
