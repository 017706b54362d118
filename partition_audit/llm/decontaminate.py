"""Benchmark decontamination with DataFrame functions only.

The n-grams of all benchmark items (windows of `size` normalised words; a shorter item is one window)
form a hash set. The windows of every document are hashed in place, exploded and probed against the
set, and a hit counts only if its words are the n-gram's. The set is broadcast if its measured size is
within `BROADCAST_BYTES`; a larger one is joined by shuffling.

Words: runs of 0-9, a-z (after lower-casing A-Z) and anything beyond ASCII. A text that is NULL or has
no word is never hit; an item without words has no window. Rows repeated in whole get the same result
each. An item whose id is NULL still hits, but is not counted among the items. Empty tables: nothing
is contaminated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partition_audit.llm.shared import free_name, some_text

WINDOW = 10
BROADCAST_BYTES = 256 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Words or what is between them, in the text as it was written.
PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    # lower() is the fast way where it can only touch A-Z.
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def benchmark_grams(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: k (words), h (hash), gram (words joined by a space), items (ids as strings)."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(some_text()).alias("w"))
    item = item.where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(size)))
    window = F.explode_outer(
        F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.slice("w", i, F.col("k")))
    )
    return (
        item.select("item", "k", window.alias("g"))
        .groupBy("k", F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("gram"))
        .agg(F.collect_set("item").alias("items"))
    )


def _text_key() -> Column:
    return F.sha2(some_text(), 256)


def window_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per (doc_id, text_key): rows (how often it is repeated), n_words, spans, items, n_hit.

    Rows are told apart by id and text. `spans` are the sorted (at, k) of all hits, in words. The texts
    are read and split once: every row also sends a marker (place 0, no hash) past the probe, which
    carries its word count. (Not so where the set is too large to broadcast: see `_hits_by_shuffle`.)
    """
    grams = benchmark_grams(benchmark, size)
    facts = grams.agg(
        F.sort_array(F.collect_set("k")).alias("ks"),
        F.sum(F.octet_length("gram") + 64 + 24 * F.size("items")).alias("bytes"),
    ).first()
    find = _hits_by_broadcast if (facts["bytes"] or 0) <= BROADCAST_BYTES else _hits_by_shuffle
    return find(docs, grams, facts["ks"]).withColumn("n_hit", _covered("spans"))


def _windows(docs: DataFrame, ks: Sequence[int]) -> DataFrame:
    """doc_id, text_key, w and, by place, at and wh: a window's first word and hash. Place 0 is a marker without them."""
    n, start, at, wh = F.size("w"), F.lit(1), F.lit(-1), F.lit(None).cast("bigint")
    for k in ks:
        end = start + F.greatest(n - k + 1, F.lit(0))
        here = (F.col("i") >= start) & (F.col("i") < end)
        at = F.when(here, F.col("i") - start).otherwise(at)
        wh = F.when(here, F.xxhash64(F.slice("w", F.col("i") - start + 1, F.lit(k)))).otherwise(wh)
        start = end
    # Exploding an attribute keeps the words from being copied for every window. The outer form is used
    # since the plain one gets a filter on the array's size, pushed below the projections, that would
    # split the text anew.
    return (
        docs.select("doc_id", _text_key().alias("text_key"), words(some_text()).alias("w"))
        .select("doc_id", "text_key", "w", F.sequence(F.lit(0), start - 1).alias("places"))
        .select("doc_id", "text_key", "w", F.explode_outer("places").alias("i"))
        .select("doc_id", "text_key", "w", "i", at.alias("at"), wh.alias("wh"))
    )


def _same_words() -> Column:
    return F.array_join(F.slice("w", F.col("at") + 1, F.col("k")), " ") == F.col("gram")


def _hits_by_broadcast(docs: DataFrame, grams: DataFrame, ks: Sequence[int]) -> DataFrame:
    """All in one pass: words stay where they are, and only hits and markers leave the task."""
    probed = _windows(docs, ks).join(F.broadcast(grams), (F.col("wh") == F.col("h")) & _same_words(), "left")
    hit, marker = F.col("h").isNotNull(), F.col("i") == 0
    return (
        probed.where(hit | marker)
        .select(
            "doc_id",
            "text_key",
            F.when(marker, F.size("w")).alias("n_words"),
            F.when(hit, F.struct("at", "k")).alias("span"),
            "items",
        )
        .groupBy("doc_id", "text_key")
        .agg(
            F.count("n_words").alias("rows"),
            F.max("n_words").cast("bigint").alias("n_words"),
            F.sort_array(F.collect_set("span")).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def _hits_by_shuffle(docs: DataFrame, grams: DataFrame, ks: Sequence[int]) -> DataFrame:
    """For benchmarks beyond the broadcast: windows travel as hashes, and words are compared afterwards.

    A window goes through the join as (doc_id, text_key, at, wh), and rows without windows not at all. Windows that
    occur more than once, or in repeated rows, are combined by document and hash before. Of the documents with
    candidates the texts are fetched once, to keep the candidates whose words are the n-gram's.
    """
    key, held = ["doc_id", "text_key"], ["at", "k", "gram", "items"]
    rows = docs.select("doc_id", _text_key().alias("text_key"), F.size(words(some_text())).alias("n"))
    rows = rows.groupBy(*key).agg(F.count("n").alias("rows"), F.max("n").cast("bigint").alias("n_words"))
    probes = _windows(docs, ks).where("i > 0").select(*key, "at", "wh")
    found = probes.join(grams, F.col("wh") == F.col("h")).select(*key, F.struct(*held).alias("hit"))
    found = found.groupBy(*key).agg(F.collect_set("hit").alias("hits"))
    found = found.select(F.struct(*key).alias("its"), "hits")
    texts = docs.select(F.struct("doc_id", _text_key().alias("text_key")).alias("own"), words(some_text()).alias("w"))
    right = F.filter("hits", lambda x: F.array_join(F.slice("w", x["at"] + 1, x["k"]), " ") == x["gram"])
    verified = (
        texts.join(found, F.col("own").eqNullSafe(F.col("its")))
        .select("own", right.alias("hits"))
        .groupBy("own")
        # Rows of one key have one text.
        .agg(F.first("hits").alias("hits"))
    )
    spans = F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x["k"].alias("k")))
    joined = rows.join(verified, F.struct(*key).eqNullSafe(F.col("own")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *key,
        "rows",
        "n_words",
        F.sort_array(F.array_distinct(F.coalesce(spans, F.array().cast("array<struct<at:int,k:int>>")))).alias("spans"),
        F.sort_array(F.coalesce(F.array_distinct(F.flatten("hits.items")), none)).alias("items"),
    )


def _covered(spans: str) -> Column:
    """Words inside at least one of the sorted spans."""
    begin = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))

    def add(state: Column, span: Column) -> Column:
        end = F.greatest(state["end"], span["at"] + span["k"])
        new = F.greatest(end - F.greatest(state["end"], span["at"]), F.lit(0))
        return F.struct((state["n"] + new).alias("n"), end.alias("end"))

    return F.aggregate(spans, begin, add, lambda state: state["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    judged = window_hits(docs, benchmark, size)
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.expr("sequence(1L, rows)")).alias("copy"),
    ).drop("copy")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = WINDOW
) -> DataFrame:
    """`docs` without contaminated documents, or without the words of the hits (`remove="spans"`)."""
    own, its, found = (free_name(docs, name) for name in ("row_key", "hit_key", "hit_spans"))
    hits = (
        window_hits(docs, benchmark, size)
        .where("n_hit > 0")
        .select(F.struct(F.col("doc_id"), F.col("text_key")).alias(its), F.col("spans").alias(found))
    )
    keyed = docs.withColumn(own, F.struct(F.col("doc_id"), _text_key().alias("text_key")))
    same_row = F.col(own).eqNullSafe(F.col(its))
    if remove == "documents":
        return keyed.join(hits, same_row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    cleaned = F.when(F.col(found).isNull(), F.col("text")).otherwise(_without_spans(found))
    joined = keyed.join(hits, same_row, "left")
    return joined.select(*[cleaned.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _without_spans(spans: str) -> Column:
    """The text without hit words and without what stands between two hit words."""
    pieces = F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))
    # Words and separators alternate, so a piece's place tells its word number.
    lead = F.when(F.size(words(F.element_at(pieces, 1))) == 0, 1).otherwise(0)

    def hit(word: Column) -> Column:
        return F.exists(spans, lambda s: (word >= s["at"]) & (word < s["at"] + s["k"]))

    def kept(piece: Column, i: Column) -> Column:
        place = i - lead
        word = F.floor(place / 2).cast("int")
        is_word = F.pmod(place, F.lit(2)) == 0
        return ~F.when(is_word, hit(word)).otherwise(hit(word) & hit(word + 1))

    return F.array_join(F.filter(pieces, kept), "")
