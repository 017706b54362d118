"""URL filter: host and path rules, and for the rest a ratio of two character language models.

Rules label URLs as accepted or rejected. Two variable-order Markov models over the bytes of host and
path are counted from all labelled URLs outside the calibration fold: at every byte the estimates of
orders 0 to `ORDER` are interpolated, each weighted by how often its context was seen. The score is the
difference of the two log10 likelihoods per byte, and the threshold is the one that best separates the
labelled URLs of the calibration fold.

Counts are exact, one per context and per context with the byte that follows (told apart by 64-bit
hashes), and are kept as a table. They are broadcast whole up to `SHARD_BYTES`; a larger table is cut by
the last `DEAL` bytes of the context, and every shard scores the places it knows in a pass of its own. Orders
below `DEAL` go with every shard: a bounded number of contexts. The scores do not depend on the cut.

A NULL URL or one without `://` has an empty host and path, fits no rule and scores 0. Without accepted
or without rejected examples every score is 0 and the threshold is 0: such URLs are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partition_audit.llm.buffers import mixed
from partition_audit.llm.decontaminate import LOWER, UPPER
from partition_audit.llm.shared import discard, written

ORDER = 5
DEAL = 3
# Parts by which counts are dealt; a shard is made of whole parts.
PARTS = 4096
SHARD_BYTES = 64 << 20
KEY_BYTES = 24  # a hash and two counts
WEIGHT = 2.0  # pseudo-count with which a lower order enters the next one
FOLDS = 5
BINS = 2000
BIN_WIDTH = 0.005

Rule = tuple[str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    there = F.instr(url, "://")
    rest = F.when(there > 0, F.substring(url, there + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, NULL without one. Rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, own_path = text.partition("/")
        fits = (
            (host == own_host) | F.endswith(host, F.lit(f".{own_host}"))
        ) & F.startswith(path, F.lit(slash + own_path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Places:
    """Every byte of some texts, with the 0 that ends each: its contexts' and pairs' hashes by order."""

    contexts: list[np.ndarray]
    pairs: list[np.ndarray]
    part: np.ndarray
    text: np.ndarray


def _places(texts: Sequence[str]) -> Places:
    pieces = [t.encode() for t in texts]
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    padding = bytes(ORDER)
    data = np.frombuffer(b"".join(padding + p + b"\0" for p in pieces), np.uint8).astype(np.uint64)
    begin = np.cumsum(sizes + ORDER) - sizes
    text = np.repeat(np.arange(len(pieces)), sizes)
    at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[text]
    follower = (data[at] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    contexts, pairs, h, part = [], [], np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for order in range(ORDER + 1):
        if order:
            h = mixed(h + (data[at - order] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        if order == DEAL:
            part = (h % np.uint64(PARTS)).astype(np.int64)
        contexts.append(mixed(h + np.uint64(order + 1)))
        pairs.append(mixed(contexts[-1] ^ follower))
    return Places(contexts, pairs, part, text)


def model_counts(labelled: DataFrame) -> DataFrame:
    """Columns part (-1: orders below DEAL), key, accepted and rejected (counts); rows: accepted, address."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for accepted, rows in frame.groupby("accepted"):
                places = _places(rows["address"].tolist())
                for order, hashes in enumerate(zip(places.contexts, places.pairs)):
                    for h in hashes:
                        key, first, n = np.unique(h, return_index=True, return_counts=True)
                        part = places.part[first] if order >= DEAL else np.full(len(key), -1)
                        yield pd.DataFrame(
                            {"part": part, "key": key.view(np.int64), "accepted": n * accepted, "rejected": n * (not accepted)}
                        )

    rows = labelled.select("accepted", "address").mapInPandas(count, "part int, key bigint, accepted bigint, rejected bigint")
    return rows.groupBy("part", "key").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def shard_count(sizes: dict[int, int]) -> int:
    """Shards, a power of two, so that each one's keys with the common ones stay within SHARD_BYTES."""
    shards = 1
    while shards < PARTS:
        held = np.zeros(shards, np.int64)
        for part, n in sizes.items():
            if part >= 0:
                held[part % shards] += n
        if (held.max() + sizes.get(-1, 0)) * KEY_BYTES <= SHARD_BYTES:
            break
        shards *= 2
    return shards


def _shard(counts: DataFrame, shard: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts, accepted and rejected; a last row of zeros is for keys not held."""
    found = counts.where((F.col("part") < 0) | (F.col("part") % shards == shard)).drop("part").toArrow()
    key = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    table = np.zeros((len(key) + 1, 2))
    for i, name in enumerate(("accepted", "rejected")):
        table[:-1, i] = found[name].to_numpy()[order]
    return key[order], table


def _differences(keys: np.ndarray, table: np.ndarray, shard: int, shards: int, texts: Sequence[str]) -> np.ndarray:
    """Per text, the models' log10 likelihoods' difference over the shard's places, by the text's number of bytes."""
    places = _places(texts)
    own = places.part % shards == shard
    text = places.text[own]

    def counts(h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, h[own])
        held = at < len(keys)
        held[held] = keys[at[held]] == h[own][held]
        return table[np.where(held, at, len(keys))]

    p = np.full((len(text), 2), 1 / 256)
    for context, pair in zip(places.contexts, places.pairs):
        p = (counts(pair) + WEIGHT * p) / (counts(context) + WEIGHT)
    difference = np.log10(p[:, 0]) - np.log10(p[:, 1])
    return np.bincount(text, difference, len(texts)) / np.bincount(places.text, minlength=len(texts))


def _scorer(shared: Broadcast, shard: int, shards: int):
    @F.pandas_udf("double")
    def score(address: pd.Series) -> pd.Series:
        if not len(address):
            return pd.Series([], dtype=float)
        return pd.Series(_differences(*shared.value, shard, shards, address.tolist()))

    return score


def _with_scores(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """`parts` with the column score, worked out from the column address."""
    facts = counts.groupBy("part").agg(F.count("key"), F.sum("accepted"), F.sum("rejected")).collect()
    parts = parts.withColumn("score", F.lit(0.0))
    if not (any(r[2] for r in facts) and any(r[3] for r in facts)):
        return parts
    shards = shard_count({r[0]: r[1] for r in facts})
    for shard in range(shards):
        shared = parts.sparkSession.sparkContext.broadcast(_shard(counts, shard, shards))
        before, parts = parts, parts.withColumn("score", F.col("score") + _scorer(shared, shard, shards)("address"))
        if shards > 1:
            parts = written(parts)
            discard(before)
            shared.destroy()
    return parts


def scored(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """`pages` with host, path, rule, rule_verdict, address and score."""
    host, path = url_parts(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    parts = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "rule_verdict": verdict})
    parts = parts.withColumn("address", F.concat("host", "path"))
    labelled = parts.where("rule is not null").select(
        (F.col("rule_verdict") == "allow").alias("accepted"), "address"
    )
    counts = written(model_counts(labelled.where(F.crc32(F.col("address").cast("binary")) % FOLDS != 0)))
    parts = _with_scores(parts, counts)
    discard(counts)
    return parts


def calibrated_threshold(labelled: DataFrame) -> float:
    """The bin edge with the best mean of both classes' hit rates; rows: accepted, score."""
    place = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN_WIDTH)))
    rows = labelled.groupBy(place.alias("bin"), "accepted").count().collect()
    good, bad = np.zeros(2 * BINS + 1), np.zeros(2 * BINS + 1)
    for row in rows:
        (good if row["accepted"] else bad)[row["bin"] + BINS] += row["count"]
    if not good.any() or not bad.any():
        return 0.0
    rate = good[::-1].cumsum()[::-1] / good.sum() + (bad.cumsum() - bad) / bad.sum()
    best = np.flatnonzero(rate == rate.max())
    return float((best[len(best) // 2] - BINS) * BIN_WIDTH)


def url_verdicts(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """`pages` with host, path, rule, verdict (the rule's, else the models') and score.

    These replace columns of the same names.
    """
    parts = scored(pages, rules)
    results = ("host", "path", "rule", "verdict", "score", "rule_verdict", "address")
    names = [f"`{c}`" for c in pages.columns if c not in results]
    judged = written(parts.select("address", "score", "rule_verdict"))
    held_out = judged.where(
        F.col("rule_verdict").isNotNull() & (F.crc32(F.col("address").cast("binary")) % FOLDS == 0)
    )
    threshold = calibrated_threshold(held_out.select((F.col("rule_verdict") == "allow").alias("accepted"), "score"))
    discard(judged)
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return parts.select(
        *names, "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score"
    )
