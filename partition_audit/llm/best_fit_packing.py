"""Vector best-fit packing of tokenized documents into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths of its pieces,
which is what attention inside documents costs). A piece takes its length, one document and its squared length.
Pieces come longest first. Each goes to an open sequence that has room for it under every capacity: the one
whose residual capacities have the greatest weighted dot product with the piece's needs (`rule="dot"`), or
whose residual would be smallest after it, by weighted squared norm (`rule="norm"`); where none has room, a new
sequence is opened. Needs and residuals are shares of the capacities.

A document is its tokens and a closing id. Only documents of more tokens than a sequence has are cut, into
pieces of a whole sequence; the last piece may be shorter. Pieces that fill a sequence stand alone. The others are
dealt by turns into parcels of about `PARCEL_TOKENS` tokens and at most `PARCEL_PIECES` pieces, each packed by one
task that sees lengths only, never texts. Parcels share no sequences, so each leaves at most a few unfilled.

Words between ASCII white space, in lower case and without the marks behind them, are encoded once per worker (as
long as it remembers them): the tokenizer lowers case, drops white space, parts letters from marks, and none of its
steps looks beyond these places. Where a slice holds the string of a special token, words are encoded as they are. NULL and empty texts are the closing id alone. Repeated rows and rows without
an id are documents of their own; columns besides `doc_id` and `text` are not looked at. A need above a capacity
(a piece whose attention cost alone is too great) gets a sequence of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partition_audit.llm.buffers import bounded_slices, lowered, prefix_sums, span_hashes, text_buffer, word_spans
from partition_audit.llm.shared import bounded_batches, some_text, written

PARCEL_TOKENS = 16 << 20
PARCEL_PIECES = 100_000
# Words that a worker remembers.
KNOWN_WORDS = 1_000_000
RULES = ("norm", "dot")
MOST_MARKS = 4
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True


@dataclass(frozen=True)
class Capacity:
    """Of a sequence. By default only tokens bind: no sequence of n tokens has more than n documents or costs over n * n."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    # Tasks are the parallelism.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Words:
    """What a worker knows of words: their ids, one word after another."""

    def __init__(self) -> None:
        self.path, self.place = "", {}
        self.ids, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def places(self, words: list[bytes], path: str) -> np.ndarray:
        """Where each of the distinct `words` is in `start` and `length`; unknown ones are encoded."""
        if path != self.path or len(self.place) + len(words) > KNOWN_WORDS:
            self.__init__()
            self.path = path
        place = self.place
        if new := [w for w in words if w not in place]:
            found = _tokenizer(path).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            own = [f.ids for f in found]
            length = np.fromiter(map(len, own), np.int64, len(own))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in own for i in x), np.int32, int(length.sum()))])
            place.update(zip(new, range(len(place), len(place) + len(new))))
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


_words = _Words()


@lru_cache(maxsize=1)
def _special(path: str) -> list[bytes]:
    return [t.content.lower().encode() for t in _tokenizer(path).get_added_tokens_decoder().values()]


def _cut_marks(data: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words with the marks behind their last letter or digit as words of their own, as the tokenizer parts these too."""
    last = end.copy()
    for _ in range(MOST_MARKS):
        last -= _MARK[data[last - 1]] & (last - 1 > begin)
    cut = (last < end) & _ALNUM[data[last - 1]]
    at = np.arange(len(begin)) + np.cumsum(cut) - cut
    out = []
    for head, mark in ((begin, last), (np.where(cut, last, end), end), (owner, owner)):
        values = np.empty(len(begin) + int(cut.sum()), np.int64)
        values[at] = head
        values[at[cut] + 1] = mark[cut]
        out.append(values)
    return tuple(out)


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and where each text's begin; words are encoded once."""
    data, places = text_buffer(texts)
    begin, end, owner = word_spans(data, places)
    if not len(begin):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    small = lowered(data)
    if not any(token in small.tobytes() for token in _special(path)):
        data = small
        begin, end, owner = _cut_marks(data, begin, end, owner)
    _, first, word = np.unique(span_hashes(prefix_sums(data), begin, end), return_index=True, return_inverse=True)
    size = end - begin
    # Words with one hash must be one word, byte by byte.
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    same = np.array_equal(size, size[first][word]) and np.array_equal(
        data[np.repeat(begin, size) + place], data[np.repeat(begin[first][word], size) + place]
    )
    if not same:
        first = word = np.arange(len(begin))
    whole = data.tobytes()
    words = [whole[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
    at = _words.places(words, path)
    count = _words.length[at][word]
    source = np.repeat(_words.start[at][word] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    per_text = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
    return _words.ids[source], np.concatenate([[0], np.cumsum(per_text)])


def pieces(docs: DataFrame, path: str, tokens: int, closing: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches):
            ids, ends = encoded(batch.column("text"), path)
            owner, nth, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                own = np.append(ids[a:b], closing).astype("<u4")
                for k, at in enumerate(range(0, len(own), tokens)):
                    piece = own[at : at + tokens]
                    owner.append(i)
                    nth.append(k)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    pa.array(nth, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    out = f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return bounded_batches(docs).select("doc_id", some_text().alias("text")).mapInArrow(run, out)


def vector_best_fit(needs: np.ndarray, capacity: np.ndarray, weights: Sequence[float], rule: str = "norm") -> np.ndarray:
    """The sequence of every piece, numbered from 0. `needs` has a row per piece, `capacity` the room of a sequence."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    order = np.lexsort(tuple(-needs[:, k] for k in reversed(range(needs.shape[1]))))
    found = np.empty(len(needs), np.int64)
    least = needs.min(0) if len(needs) else capacity
    share = np.asarray(weights, float) / capacity.astype(float) ** 2
    # Rooms of open sequences, and which they are; closed ones (no room for the smallest needs) leave the arrays.
    room = np.empty((max(16, len(needs)), len(capacity)), np.int64)
    number = np.empty(len(room), np.int64)
    used = opened = 0
    for i in order.tolist():
        need = needs[i]
        here = room[:used]
        fits = np.flatnonzero((here >= need).all(1))
        if len(fits):
            left = here[fits]
            score = -(((left - need) ** 2) @ share) if rule == "norm" else (left * need) @ share
            at = int(fits[int(score.argmax())])
        else:
            at = used
            room[at], number[at] = capacity, opened
            used += 1
            opened += 1
        found[i] = number[at]
        room[at] -= need
        if (room[at] < least).any():
            used -= 1
            room[at], number[at] = room[used], number[used]
    return found


def pack_documents(
    docs: DataFrame, path: str, capacity: Capacity = Capacity(), closing: int = 0, rule: str = "norm"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (its place there, gapless from 0)."""
    cut = written(pieces(docs, path, capacity.tokens, closing))
    open_pieces = F.col("length") < capacity.tokens
    sums = cut.agg(F.sum(F.when(open_pieces, F.col("length"))), F.count(F.when(open_pieces, 1))).first()
    parcels = max(1, -(-(sums[0] or 0) // PARCEL_TOKENS), -(-sums[1] // PARCEL_PIECES))
    room, weights = capacity.vector(), capacity.weights

    def run(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        full = length == room[0]
        needs = np.stack([length, np.ones_like(length), length**2], 1)[~full]
        packed = vector_best_fit(needs, room, weights, rule)
        sequence = np.empty(len(length), np.int64)
        sequence[~full] = packed
        sequence[full] = np.arange(full.sum()) + (packed.max(initial=-1) + 1)
        order = np.lexsort((np.arange(len(length)), sequence))
        taken = np.cumsum(length[order]) - length[order]
        first = np.ones(len(order), bool)
        first[1:] = sequence[order][1:] != sequence[order][:-1]
        offset = np.empty(len(length), np.int64)
        offset[order] = taken - taken[np.flatnonzero(first)][np.cumsum(first) - 1]
        parcel = table.column("parcel").to_numpy()
        return table.drop_columns(["parcel"]).append_column("sequence_id", pa.array(parcel << 32 | sequence)).append_column("offset", pa.array(offset))

    # By turns over the table's rows, so that repeated rows spread like others.
    dealt = cut.withColumn("parcel", F.monotonically_increasing_id() % parcels)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cut.schema)}, sequence_id bigint, offset bigint"
    return dealt.groupBy("parcel").applyInArrow(run, schema)
