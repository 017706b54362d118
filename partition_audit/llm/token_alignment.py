"""Alignment of two tokenizers: where tokens of A and B end at the same byte, and which pairs of ids meet there.

A is a byte-level BPE that gets a space and the text, B a piece model that adds the space itself. In every
document the end offsets of both token sequences are walked along diagonals: while A's token i + k and B's token
j + k end together for k = 0, 1, 2, ... the index shift j - i stays, and the length of such a one-to-one stretch is
found by exponential probing, comparing ever longer slices of the two end arrays. Where the ends part, the
sequence that is behind goes on token by token until both meet, which gives the shift of the next stretch.

Every place where both end closes a group and links A's and B's last token there. How many links the corpus has
for a pair of ids, and the most that any A id has with a B id, are Spark aggregations: a slice of documents
lists its distinct pairs once, with their number, and gets their counts back by a join; each document's links are
held as places in its slice's list.

Texts that are NULL or empty, or whose tokens do not give back a space and the text byte for byte (B knows no
U+2581 of the text's own), have no tokens: zeros and an empty digest. Rows without an id and repeated rows
are documents like others; columns besides `doc_id` and `text` are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partition_audit.llm.buffers import bounded_slices
from partition_audit.llm.shared import bounded_batches, some_text, written

# Text of the documents that share a list of pairs; a longer document has its own.
PAIR_BYTES = 7 << 20
# An A id and a B id as one number.
ID_BITS = 20
FIRST_PROBE = 4


@dataclass(frozen=True)
class Tokens:
    """One tokenizer: ids of texts, and the bytes and the number of bytes of every id."""

    encode: object
    pieces: np.ndarray
    lengths: np.ndarray


def tokens(encode: object, pieces: list[bytes]) -> Tokens:
    held = np.empty(len(pieces), object)
    held[:] = pieces
    return Tokens(encode, held, np.array([len(p) for p in pieces], np.int64))


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: Latin-1 letters stand for themselves, the
    other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str) -> Tokens:
    """A byte-level BPE file. Where merges come in the order of their ids, a rank encoder gives the same ids faster."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model["added_tokens"]}
    symbol = byte_of_symbol()
    ranks = {bytes(symbol[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    made = [model["model"]["vocab"]["".join(m)] for m in merges]
    pieces = [b""] * (max(model["model"]["vocab"].values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def by_library(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    encode = by_library
    if made == list(range(made[0], made[0] + len(made))) and min(made) == 256:
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def by_ranks(text: str) -> list[int]:
            try:
                return fast.encode_ordinary(text)
            except BaseException as fault:  # its regex engine gives up on very long runs of white space
                if isinstance(fault, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
                return by_library(text)

        encode = by_ranks
    return tokens(lambda text: encode(" " + text), pieces)


@lru_cache(maxsize=2)
def piece_level(path: str) -> Tokens:
    """A piece model: U+2581 in its pieces is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return tokens(lambda text: model.encode(text, num_threads=1), pieces)


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Stretches (i, j, n): a[i + k] == b[j + k] for k < n. `a` and `b` rise; together these are all equal pairs."""
    found = []
    i = j = 0
    n, m = len(a), len(b)
    # Nothing equals the ends that are put after the last ones, so no slice goes beyond them.
    a, b = [*a, -1], [*b, -2]
    while i < n and j < m:
        x, y = a[i], b[j]
        if x < y:
            i += 1
        elif y < x:
            j += 1
        else:
            first, shift = i, j - i
            i += 1
            # Most stretches are short: the first steps go one by one.
            probed = i + FIRST_PROBE
            while a[i] == b[i + shift]:
                i += 1
                if i == probed:
                    step = FIRST_PROBE
                    while a[i : i + step] == b[i + shift : i + shift + step]:
                        i += step
                        step *= 2
                    while step > 1:
                        step //= 2
                        if a[i : i + step] == b[i + shift : i + shift + step]:
                            i += step
                    break
            j = i + shift
            found.append((first, first + shift, i - first))
    return found


def names(count_a: int, count_b: int) -> np.ndarray:
    """Decimal ids with the mark that follows them: A's before `,`, A's before `|`, B's before `,`, B's before `;`."""
    return np.array([f"{i}{mark}" for count, marks in ((count_a, ",|"), (count_b, ",;")) for mark in marks for i in range(count)], object)


def group_text(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, named: np.ndarray, count_a: int, count_b: int) -> str:
    """`a1,a2|b1;a3|b2,b3`: the ids of every group, groups ending at the places `last_a` and `last_b`."""
    out = np.empty(len(a) + len(b), np.int64)
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    at_a = np.arange(len(a)) + np.repeat(last_b + 1 - size_b, size_a)
    at_b = np.arange(len(b)) + np.repeat(last_a + 1, size_b)
    out[at_a], out[at_b] = a, b + 2 * count_a
    out[at_a[last_a]] += count_a
    out[at_b[last_b]] += count_b
    return "".join(named[out].tolist())[:-1]


def aligned(text: str, one: Tokens, two: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids of A and B and the places at which tokens of both end, or None without tokens."""
    if not text:
        return None
    a, b = (np.frombuffer(array("q", x.encode(text)), np.int64) for x in (one, two))
    whole = b" " + text.encode()
    if b"".join(one.pieces[a].tolist()) != whole or b"".join(two.pieces[b].tolist()) != whole:
        return None
    runs = np.array(common_ends(np.cumsum(one.lengths[a]).tolist(), np.cumsum(two.lengths[b]).tolist()), np.int64)
    step = np.arange(runs[:, 2].sum()) - np.repeat(np.cumsum(runs[:, 2]) - runs[:, 2], runs[:, 2])
    return a, b, np.repeat(runs[:, 0], runs[:, 2]) + step, np.repeat(runs[:, 1], runs[:, 2]) + step


def _slices(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """One row per slice of documents: their figures, their links as places in `pairs`, and how often each pair occurs."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_level(path_a, pattern), piece_level(path_b)
        counts_of = len(one.pieces), len(two.pieces)
        named = names(*counts_of)
        nth = 0
        for batch in bounded_slices(batches, limit=PAIR_BYTES):
            figures, links = [], []
            for text in batch.column("text"):
                found = aligned(text.as_py(), one, two)
                if found is None:
                    figures.append((0, 0, 0, ""))
                    links.append(np.zeros(0, np.int64))
                    continue
                a, b, last_a, last_b = found
                digest = hashlib.sha256(group_text(a, b, last_a, last_b, named, *counts_of).encode()).hexdigest()
                figures.append((len(a), len(b), len(last_a), digest))
                links.append(a[last_a] << ID_BITS | b[last_b])
            pairs, place, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            blob = pa.compress(place.astype("<u4").tobytes(), "zstd", asbytes=True)
            n_a, n_b, n_groups, digests = (list(x) for x in zip(*figures))
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "slice": TaskContext.get().partitionId() << 32 | nth,
                        "doc_id": batch.column("doc_id").to_pylist(),
                        "n_a": n_a,
                        "n_b": n_b,
                        "n_groups": n_groups,
                        "groups_sha256": digests,
                        "places": blob,
                        "pairs": pairs,
                        "n": counts,
                    }
                ],
                schema=pa.schema(
                    [
                        ("slice", pa.int64()),
                        ("doc_id", pa.list_(batch.schema.field("doc_id").type)),
                        *[(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups")],
                        ("groups_sha256", pa.list_(pa.string())),
                        ("places", pa.binary()),
                        ("pairs", pa.list_(pa.int64())),
                        ("n", pa.list_(pa.int64())),
                    ]
                ),
            )
            nth += 1

    out = (
        f"slice bigint, doc_id array<{kind.simpleString()}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
        "groups_sha256 array<string>, places binary, pairs array<bigint>, n array<bigint>"
    )
    return bounded_batches(docs).select("doc_id", some_text().alias("text")).mapInArrow(run, out)


def pair_counts(listed: DataFrame) -> DataFrame:
    """(pair, links, best) from (pair, n) rows: the links that hold a pair, and whether its B id has no commoner one."""
    counts = listed.groupBy("pair").agg(F.sum("n").alias("links"))
    second = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    most = counts.groupBy(second.alias("b")).agg(F.max("links").alias("most"))
    return counts.join(most, second == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `n_best` counts links whose pair is its B id's commonest in the corpus, ties included; `count_sum` adds up how
    many links of the corpus hold the pair, over the document's links. The table of slices in the shared folder
    stays, as the result reads it.
    """
    slices = written(_slices(docs, path_a, pattern, path_b))
    listed = slices.select("slice", F.arrays_zip("pairs", "n").alias("listed")).select("slice", F.posexplode("listed").alias("place", "at"))
    listed = listed.select("slice", "place", F.col("at.pairs").alias("pair"), F.col("at.n").alias("n"))
    found = listed.join(pair_counts(listed), "pair").select(F.col("slice").alias("of_slice"), "place", "links", "best")
    figures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].values for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
        links = row["n_groups"].to_numpy()
        total = int(links.sum())
        place = np.frombuffer(pa.decompress(left.column("places")[0].as_py(), 4 * total, "zstd", asbytes=True), "<u4") if total else np.zeros(0, np.uint32)
        at = right.column("place").to_numpy()
        counts, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        counts[at] = right.column("links").to_numpy()
        best[at] = right.column("best").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(links)])

        def per_doc(values: np.ndarray) -> pa.Array:
            sums = np.concatenate([[0], np.cumsum(values[place])])
            return pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())

        return pa.table(
            {**row, "n_links": row["n_groups"], "n_best": per_doc(best), "count_sum": per_doc(counts)}
        ).select(["doc_id", *figures, "groups_sha256"])

    # A slice without links has no row in `found`.
    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in figures)}, groups_sha256 string"
    return slices.drop("pairs", "n").groupBy("slice").cogroup(found.groupBy("of_slice")).applyInArrow(run, schema)
