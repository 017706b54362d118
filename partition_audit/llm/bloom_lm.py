"""Language-model scores from a log-frequency Bloom filter, broadcast to the workers.

The filter holds words and word pairs of the training texts with quantised counts: an n-gram seen c
times is inserted once for each level 1 .. 1 + floor(log2 c). To look a count up, levels are probed one
after another until one is missing. The pair estimate is smoothed with the word estimate:

    p(w | v) = (n(v w) + PRIOR * p(w)) / (n(v) + PRIOR),   p(w) = (n(w) + 1) / (N + V + 1)

The filter has `BITS_PER_TOKEN` bits for each training token, so its error rate does not rise with the
corpus. It is built in blocks of `BLOCK_BYTES`, each by one task from counts that were combined inside
the map tasks first. It is broadcast in shards of at most `SHARD_BYTES`: pairs belong to their first
word's shard, words to every shard, and texts are scored once per shard, each time for the tokens
whose preceding word belongs to it.

The base score uses exact counts. Those of the `FREQUENT` commonest tokens, a fixed number, are broadcast;
other tokens meet their counts in a join, so no single word is a hot key.

Tokens: lower-cased (A-Z) words between ASCII white space, then one end token. NULL and empty texts are
the end token alone. Rows repeated in whole count as often as they occur. Without training rows all
counts are 0. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
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
from partition_audit.llm.shared import bounded_batches, give_back_memory, some_text, written

BITS_PER_TOKEN = 8
PROBES = 5
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 256 << 20
PIECE_BLOCKS = 16
FREQUENT = 1 << 18
PRIOR = 50.0
# A count of up to 2**47.
LEVELS = 48

END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
PAIR, LEVEL = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, one text after another, and where each text's tokens begin."""
    data, places = text_buffer(texts)
    data = lowered(data)
    begin, end, text = word_spans(data, places)
    count = np.bincount(text, minlength=len(texts)) + 1
    ends = np.concatenate([[0], np.cumsum(count)])
    tokens = np.full(ends[-1], END)
    tokens[np.arange(len(begin)) + text] = span_hashes(prefix_sums(data), begin, end)
    return tokens, ends


def _before(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    previous = np.concatenate([[BEGIN], tokens[:-1]]).astype(np.uint64)
    previous[ends[:-1]] = BEGIN
    return previous


def pair_hash(previous: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(previous * PAIR + token)


def per_slice(
    work: Callable[[pa.RecordBatch], list[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` on slices of bounded size; what its arrays took is given back after each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches):
            yield from work(batch)
            give_back_memory()

    return run


def token_counts(training: DataFrame) -> DataFrame:
    """(h, c) of every token."""

    def count(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        h, c = np.unique(token_hashes(batch.column(0))[0], return_counts=True)
        return [pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])]

    return training.select("text").mapInArrow(per_slice(count), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """At most `most` tokens: all with at least a count that a histogram by powers of two to the 1/16 gives."""
    place = F.floor(16 * F.log2("c")).cast("int")
    bins = {r["place"]: r["count"] for r in counts.groupBy(place.alias("place")).count().collect()}
    held, least = 0, None
    for at in sorted(bins, reverse=True):
        held += bins[at]
        if held > most:
            break
        least = at
    return counts.where(F.lit(False) if least is None else place >= least).toArrow()


class Layout:
    """How many shards and blocks hold a corpus of so many tokens."""

    def __init__(self, tokens: int, words: int, shard_bytes: int) -> None:
        size = max(1, tokens * BITS_PER_TOKEN // 8)
        self.shards = -(-size // shard_bytes)
        self.blocks = -(-(size // self.shards + words * BITS_PER_TOKEN // 8 + 1) // BLOCK_BYTES)

    def shard(self, previous: np.ndarray) -> np.ndarray:
        return (previous >> np.uint64(17)) % np.uint64(self.shards)

    def block(self, h: np.ndarray) -> np.ndarray:
        return h % np.uint64(self.blocks)


def _rest(h: np.ndarray) -> np.ndarray:
    """What a block keeps of a hash: 40 bits."""
    return h >> np.uint64(24)


def _bit_places(rest: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """The probes of an n-gram's level, as bit numbers inside its block."""
    h = mixed(rest * PAIR + np.uint64(level * int(LEVEL) & 0xFFFFFFFFFFFFFFFF))
    for probe in range(PROBES):
        if probe:
            h = mixed(h + LEVEL)
        yield h & np.uint64(8 * BLOCK_BYTES - 1)


def _packed(block: np.ndarray, h: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
    """(block, compressed hashes and counts, entries); sorted hashes by byte planes compress well."""
    rest = _rest(h)
    order = np.lexsort((rest, block))
    block, rest, c = block[order], rest[order], c[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(block)]):
        if high > low:
            gaps = np.diff(rest[low:high], prepend=np.uint64(0))
            planes = gaps.view(np.uint8).reshape(-1, 8)[:, :5].T.copy()
            plain = planes.tobytes() + c[low:high].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            yield int(block[low]), pa.compress(plain, "zstd", asbytes=True), high - low


def _unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    plain = np.frombuffer(pa.decompress(blob, 9 * n, "zstd", asbytes=True), np.uint8)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :5] = plain[: 5 * n].reshape(5, n).T
    counts = np.ascontiguousarray(plain[5 * n :].reshape(4, n).T).view("<u4")[:, 0]
    return np.cumsum(gaps.view(np.uint64)[:, 0]), counts


def _parcels(shard: int, parts: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
    block, blob, n = zip(*parts) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(block), pa.int32()), pa.array(block, pa.int64()), pa.array(blob, pa.binary()), pa.array(n, pa.int64())],
        ["shard", "block", "blob", "n"],
    )


PARCEL = "shard int, block bigint, blob binary, n bigint"


def build_filter(training: DataFrame, counts: DataFrame, layout: Layout) -> DataFrame:
    """(shard, block, bits): the filter in blocks, each made by one task."""

    def pairs(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        tokens, ends = token_hashes(batch.column(0))
        previous = _before(tokens, ends)
        shard, parcels = layout.shard(previous), []
        for s in range(layout.shards):
            mine = shard == np.uint64(s)
            h, c = np.unique(pair_hash(previous[mine], tokens[mine]), return_counts=True)
            parcels.append(_parcels(s, list(_packed(layout.block(h), h, c))))
        return parcels

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            c = np.minimum(batch.column(1).to_numpy(), 2**32 - 1)
            parts = list(_packed(layout.block(h), h, c))
            for s in range(layout.shards):
                yield _parcels(s, parts)
        give_back_memory()

    def fill(table: pa.Table) -> pa.Table:
        bits = filled(table)
        give_back_memory()
        return pa.table({"shard": table["shard"][:1], "block": table["block"][:1], "bits": pa.array([bits], pa.binary())})

    def filled(table: pa.Table) -> bytes:
        found = [_unpacked(blob, n) for blob, n in zip(table["blob"].to_pylist(), table["n"].to_pylist())]
        rest, counts = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.argsort(rest, kind="stable")
        rest, counts = rest[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.diff(rest, prepend=rest[0] + np.uint64(1)))
        rest, total = rest[first], np.add.reduceat(counts, first)
        bits = np.zeros(8 * BLOCK_BYTES, bool)
        level = 1
        while len(rest):
            for place in _bit_places(rest, level):
                bits[place] = True
            more = total >= 2**level
            rest, total, level = rest[more], total[more], level + 1
        return np.packbits(bits, bitorder="little").tobytes()

    parcels = training.select("text").mapInArrow(per_slice(pairs), PARCEL).union(counts.mapInArrow(words, PARCEL))
    return parcels.groupBy("shard", "block").applyInArrow(fill, "shard int, block bigint, bits binary")


def estimated_counts(bits: Sequence[np.ndarray], layout: Layout, h: np.ndarray) -> np.ndarray:
    """Counts by repeated probes: the middle of the highest level that is held, 0 without level 1.

    `bits` are the shard's pieces of `PIECE_BLOCKS` blocks each.
    """
    count = np.zeros(len(h))
    block = layout.block(h).astype(np.int64)
    for number, piece in enumerate(bits):
        rows = np.flatnonzero(block // PIECE_BLOCKS == number)
        rest, base = _rest(h[rows]), block[rows] % PIECE_BLOCKS * (8 * BLOCK_BYTES)
        for level in range(1, LEVELS + 1):
            held = np.ones(len(rows), bool)
            for place in _bit_places(rest, level):
                at = place.astype(np.int64) + base
                held &= (piece[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            rows, rest, base = rows[held], rest[held], base[held]
            if not len(rows):
                break
            count[rows] = 1.0 if level == 1 else 1.5 * 2 ** (level - 1)
    return count


def _broadcast_pieces(blocks: DataFrame, layout: Layout, shard: int) -> list:
    """The shard in broadcasts of PIECE_BLOCKS blocks, so that the driver holds one piece at a time."""
    pieces = []
    for first in range(0, layout.blocks, PIECE_BLOCKS):
        last = min(first + PIECE_BLOCKS, layout.blocks)
        bits = np.zeros((last - first) * BLOCK_BYTES, np.uint8)
        mine = blocks.where((F.col("shard") == shard) & F.col("block").between(first, last - 1))
        rows = mine.select("block", "bits").collect()
        while rows:
            row = rows.pop()
            at = (row["block"] - first) * BLOCK_BYTES
            bits[at : at + BLOCK_BYTES] = np.frombuffer(row["bits"], np.uint8)
        pieces.append(blocks.sparkSession.sparkContext.broadcast(bits))
        give_back_memory()
    return pieces


def _known_counts(frequent: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Exact counts of frequent tokens, -1 for others."""
    hashes, counts = frequent
    if not len(hashes):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, counts[at], -1)


def score_documents(docs: DataFrame, trains: Column, shard_bytes: int = SHARD_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, trains, n_tokens, n_known, train_tokens, base_score, score.

    `docs` has doc_id and text; `trains` says which rows the model learns from.
    """
    spark = bounded_batches(docs).sparkSession
    rows = docs.select(
        "doc_id", some_text().alias("text"), F.coalesce(trains, F.lit(False)).alias("trains")
    ).withColumn("ref", F.xxhash64("doc_id", "text"))
    training = rows.where("trains").select("text")
    counts = written(token_counts(training))
    facts = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    n_all, n_words = facts["n"] or 0, facts["v"]
    top = _most_frequent(counts, frequent)
    top_hash = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(top_hash)
    common = spark.sparkContext.broadcast((top_hash[order], top["c"].to_numpy()[order]))

    layout = Layout(n_all, n_words, shard_bytes)
    blocks = written(build_filter(training, counts, layout))
    space = float(n_all + n_words + 1)

    def rare(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        """Tokens that are not frequent: (ref, h, times)."""
        tokens, ends = token_hashes(batch.column("text"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        mine = _known_counts(common.value, tokens) < 0
        order = np.lexsort((tokens[mine], owner[mine]))
        h, own = tokens[mine][order], owner[mine][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        ref = batch.column("ref").to_numpy()[own[at]]
        times = np.diff(np.append(at, len(h)))
        return [
            pa.RecordBatch.from_arrays(
                [pa.array(ref), pa.array(h[at].view(np.int64)), pa.array(times, pa.int32())], ["ref", "h", "times"]
            )
        ]

    rest = rows.select("text", "ref").mapInArrow(per_slice(rare), "ref bigint, h bigint, times int")
    c = F.coalesce("c", F.lit(0))
    rest = (
        rest.join(counts, "h", "left")
        .select("ref", (F.col("times") * F.log10((c + 1) / F.lit(space))).alias("base"), F.when(c > 0, F.col("times")).otherwise(0).alias("known"))
        .groupBy("ref")
        .agg(F.sum("base").alias("rest_base"), F.sum("known").alias("rest_known"))
    )

    scored = None
    for s in range(layout.shards):
        part = rows.mapInArrow(
            _scorer(_broadcast_pieces(blocks, layout, s), common, layout, s, space),
            "doc_id bigint, trains boolean, ref bigint, n_tokens bigint, known bigint, base double, score double",
        )
        scored = part if scored is None else scored.union(part)
    whole = scored.groupBy("doc_id", "trains", "ref").agg(
        F.max("n_tokens").alias("n_tokens"),
        F.max("known").alias("known"),
        F.max("base").alias("base"),
        F.sum("score").alias("scores"),
        F.count("n_tokens").alias("copies"),  # only the first shard's rows have it
    )
    found = whole.join(rest, "ref", "left")
    return found.select(
        "doc_id",
        "trains",
        "n_tokens",
        (F.col("known") + F.coalesce((F.col("rest_known") / F.col("copies")).cast("bigint"), F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("rest_base") / F.col("copies"), F.lit(0.0))).alias("base_score"),
        (F.col("scores") / F.col("copies")).alias("score"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    ).drop("copy")


def _scorer(shared, common, layout: Layout, shard: int, space: float):
    def work(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        bits = [piece.value for piece in shared]
        tokens, ends = token_hashes(batch.column("text"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        exact = _known_counts(common.value, tokens)
        frequent = exact >= 0
        base = np.bincount(owner[frequent], np.log10((exact[frequent] + 1) / space), batch.num_rows)
        known = np.bincount(owner[frequent & (exact > 0)], minlength=batch.num_rows)

        previous = _before(tokens, ends)
        mine = np.flatnonzero(layout.shard(previous) == np.uint64(shard))
        distinct, number = np.unique(np.concatenate([tokens[mine], previous[mine]]), return_inverse=True)
        words = estimated_counts(bits, layout, distinct)
        n_word, n_before = words[number[: len(mine)]], words[number[len(mine) :]]
        pairs = estimated_counts(bits, layout, pair_hash(previous[mine], tokens[mine]))
        p = (pairs + PRIOR * (n_word + 1) / space) / (np.maximum(n_before, pairs) + PRIOR)
        score = np.bincount(owner[mine], np.log10(p), batch.num_rows)
        size = pa.array(np.diff(ends), pa.int64(), mask=np.full(batch.num_rows, shard > 0))
        made = pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                batch.column("trains"),
                batch.column("ref"),
                size,
                pa.array(known, pa.int64()),
                # Sums over no tokens come as whole numbers.
                pa.array(base, pa.float64()),
                pa.array(score, pa.float64()),
            ],
            ["doc_id", "trains", "ref", "n_tokens", "known", "base", "score"],
        )
        return [made]

    return per_slice(work)
