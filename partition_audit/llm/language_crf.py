"""Language identification with a linear-chain conditional random field.

Every word of a text gets a label. Features of a word, hashed to `BUCKETS` weights per language: the
word itself (lexicon), its first and last one to three bytes (affixes) and its 3- and 4-byte grams.
Transitions between the labels of neighbouring words are learned with them, from chains in which
pieces of texts in different languages follow each other, so that switches inside a text are seen.
Forward-backward gives each word's marginal probabilities; a document's are the means over its words
with letters.

The model is fitted on a bounded sample: `SAMPLE_PER_LANGUAGE` different labelled texts of each
language (all, if fewer), a stretch of at most `SAMPLE_CHARS` characters from each. Prediction reads whole texts.
NULL texts and texts without a letter are `und` with score 0. Without labelled rows all are `und`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partition_audit.llm.buffers import forget_powers, lowered, mixed, prefix_sums, span_hashes, text_buffer, word_spans
from partition_audit.llm.shared import bounded_batches, give_back_memory, some_text

BUCKETS = 1 << 18
SAMPLE_PER_LANGUAGE = 500
SAMPLE_CHARS = 2000
CHAIN_WORDS = 64  # a text is labelled in chains of at most so many words
BATCH_CHAINS = 128
# Bytes of text labelled at a time; features and marginals take some hundred times as much.
LABEL_BYTES = 1 << 19
# Bytes of text hashed at a time.
HASH_BYTES = 1 << 18
# Words of the sample whose features are made at a time.
FIT_WORDS = 1 << 13
EPOCHS = 4
RATE = 0.3
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    transitions: np.ndarray  # from x to


def word_features(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of the given words."""
    sums, size, number = prefix_sums(data), end - begin, np.arange(len(begin))
    words, hashes = [number], [span_hashes(sums, begin, end)]
    for k in (1, 2, 3):
        long = number[size >= k]
        for kind, at in ((1, begin[long]), (2, end[long] - k)):
            words.append(long)
            hashes.append(mixed(span_hashes(sums, at, at + k) + np.uint64(kind)))
    for k in (3, 4):
        count = np.maximum(size - k + 1, 0)
        word = np.repeat(number, count)
        at = begin[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        words.append(word)
        hashes.append(mixed(span_hashes(sums, at, at + k) + np.uint64(3)))
    return np.concatenate(words), (np.concatenate(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _emissions(weights: np.ndarray, words: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(words, weights[buckets, k], n) for k in range(weights.shape[1])], 1)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Marginals of every word. `scores`: words of all chains, one chain after another."""
    local = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(transitions)
    order = np.argsort(-lengths, kind="stable")
    begin, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    forward, backward = np.empty_like(local), np.empty_like(local)
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")  # chains with more than t words
    for t in range(longest):
        at = begin[: live[t]] + t
        forward[at] = _scaled(local[at] if t == 0 else local[at] * (forward[at - 1] @ step))
    for t in range(longest - 1, -1, -1):
        more = live[t + 1] if t + 1 < longest else 0
        at = begin[: live[t]] + t
        backward[at[more:]] = 1.0
        if more:
            backward[at[:more]] = _scaled((local[at[:more] + 1] * backward[at[:more] + 1]) @ step.T)
    return _scaled(forward * backward)


def _chain_lengths(words_per_text: np.ndarray) -> np.ndarray:
    """Texts cut into chains; the words keep their order."""
    chains = -(-words_per_text // CHAIN_WORDS)
    lengths = np.full(int(chains.sum()), CHAIN_WORDS, np.int64)
    ends = np.cumsum(chains)[chains > 0] - 1
    lengths[ends] = (words_per_text - (chains - 1) * CHAIN_WORDS)[chains > 0]
    return lengths


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every word; sums are taken over `HASH_BYTES` at a time, or a longer word."""
    parts, low = [np.zeros(0, np.uint64)], 0
    while low < len(begin):
        first = begin[low]
        high = max(low + 1, int(np.searchsorted(end, first + HASH_BYTES, "right")))
        sums = prefix_sums(data[first : end[high - 1]])
        parts.append(span_hashes(sums, begin[low:high] - first, end[low:high] - first))
        low = high
    return np.concatenate(parts)


def _distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct word, and every word's number among them."""
    _, first, number = np.unique(_word_hashes(data, begin, end), return_index=True, return_inverse=True)
    return first, number


def _gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the given words alone, and where each begins and ends there."""
    size = end - begin
    last = np.cumsum(size)
    return data[np.repeat(begin - (last - size), size) + np.arange(size.sum())], last - size, last


def _sorted_features(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' features, word by word, and where each word's begin; `FIT_WORDS` words at a time."""
    parts, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for low in range(0, len(begin), FIT_WORDS):
        mine = slice(low, low + FIT_WORDS)
        words, buckets = word_features(*_gathered(data, begin[mine], end[mine]))
        parts.append(buckets[np.argsort(words, kind="stable")].astype(np.int32))
        counts.append(np.bincount(words, minlength=len(begin[mine])))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    languages = sorted(set(labels))
    label_of = {name: i for i, name in enumerate(languages)}
    data, places = text_buffer(pa.array(texts, pa.string()))
    data = lowered(data)
    begin, end, text = word_spans(data, places)
    model = Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros((len(languages),) * 2))
    if not len(begin):
        return model
    first, number = _distinct(data, begin, end)
    buckets, feature_at = _sorted_features(data, begin[first], end[first])
    give_back_memory()
    gold = np.array([label_of[x] for x in labels])[text]

    # Pieces of 4 to 20 words; a chain goes on in the same text or, one time in five, in another one.
    random = np.random.default_rng(seed)
    cuts = np.flatnonzero(np.diff(text, prepend=-1))
    pieces = []
    for low, high in zip(cuts, [*cuts[1:], len(text)]):
        at = low
        while at < high:
            step = int(random.integers(4, 21))
            pieces.append(np.arange(at, min(at + step, high)))
            at += step
    jumps = np.flatnonzero(random.random(len(pieces)) < 0.2)
    runs = np.split(np.arange(len(pieces)), jumps)
    grown_w, grown_t = np.full(model.weights.shape, 1e-6), np.full(model.transitions.shape, 1e-6)
    for _ in range(EPOCHS):
        shuffled = np.concatenate([runs[i] for i in random.permutation(len(runs))])
        stream = np.concatenate([pieces[i] for i in shuffled])
        full = max(1, len(stream) // CHAIN_WORDS)
        width = min(CHAIN_WORDS, len(stream))
        chains = stream[: full * width].reshape(full, width)
        for part in range(0, full, BATCH_CHAINS):
            at = chains[part : part + BATCH_CHAINS]
            distinct, place = np.unique(number[at].ravel(), return_inverse=True)
            count = feature_at[distinct + 1] - feature_at[distinct]
            word = np.repeat(np.arange(len(distinct)), count)
            own = buckets[np.repeat(feature_at[distinct] - (np.cumsum(count) - count), count) + np.arange(len(word))]
            scores = _emissions(model.weights, word, own, len(distinct))[place].reshape(*at.shape, -1)
            marginal, pairs = _chain_expectations(scores, model.transitions)
            truth = np.eye(len(languages))[gold[at]]
            gap = (truth - marginal).reshape(-1, len(languages))
            by_word = np.stack([np.bincount(place, gap[:, k], len(distinct)) for k in range(len(languages))], 1)
            slope = np.stack([np.bincount(own, by_word[word, k], BUCKETS) for k in range(len(languages))], 1)
            slope /= len(at)
            slope_t = (np.einsum("cti,ctj->ij", truth[:, :-1], truth[:, 1:]) - pairs) / len(at)
            grown_w += slope**2
            grown_t += slope_t**2
            model.weights[:] += RATE * slope / np.sqrt(grown_w)
            model.transitions[:] += RATE * slope_t / np.sqrt(grown_t)
    return model


def _chain_expectations(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of equally long chains, and the expected number of each transition."""
    chains, width, n = scores.shape
    marginal = forward_backward(scores.reshape(-1, n), np.full(chains, width), transitions).reshape(scores.shape)
    local, step = np.exp(scores - scores.max(2, keepdims=True)), np.exp(transitions)
    backward = np.ones_like(local)
    for t in range(width - 2, -1, -1):
        backward[:, t] = _scaled((local[:, t + 1] * backward[:, t + 1]) @ step.T)
    after = local * backward
    # Given a word's label, the next one's is independent of what came before.
    onward = step[None, None] * after[:, 1:, None, :]
    onward = onward / onward.sum(-1, keepdims=True)
    return marginal, np.einsum("cti,ctij->ij", marginal[:, :-1], onward)


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language and its mean marginal, per text."""
    n = len(model.languages)
    total = np.zeros((len(texts), n))
    _, all_places = text_buffer(texts)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(all_places, all_places[low] + LABEL_BYTES, "right")) - 1
        high = min(max(high, low + 1), len(texts))
        data, places = text_buffer(texts.slice(low, high - low))
        data = lowered(data)
        begin, end, text = word_spans(data, places)
        if len(begin):
            first, number = _distinct(data, begin, end)
            words, buckets = word_features(data, begin[first], end[first])
            scores = _emissions(model.weights, words, buckets, len(first))
            lengths = _chain_lengths(np.bincount(text, minlength=high - low))
            marginal = forward_backward(scores[number], lengths, model.transitions)
            letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
            spoken = letters[end] > letters[begin]
            for k in range(n):
                total[low:high, k] = np.bincount(text[spoken], marginal[spoken, k], high - low)
        low = high
    best = total.argmax(1)
    return best, total[np.arange(len(total)), best] / np.maximum(total.sum(1), 1e-12)


def sample(labelled: DataFrame) -> list[tuple[str, str]]:
    """A bounded sample of (text, lang) for every language; rows are chosen by hash, alike in every run.

    Copies of a text count once, so a text of which a third of all rows are copies takes one place.
    """
    hashed = F.xxhash64("text", "lang")
    distinct = F.approx_count_distinct(hashed).alias("n")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(distinct).collect()}
    if not counts:
        return []
    spread, rate = 1 << 30, F.lit(0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, int(min(1.0, 1.5 * SAMPLE_PER_LANGUAGE / n) * spread)).otherwise(rate)
    at = F.pmod(hashed, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    rows = (
        labelled.where(F.pmod(F.xxhash64(hashed), F.lit(spread)) < rate)
        .select("lang", hashed.alias("h"), F.substring("text", at, F.lit(SAMPLE_CHARS)).alias("piece"))
        .distinct()
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece")))
        .where(F.col("place") <= SAMPLE_PER_LANGUAGE)
        .orderBy("h", "piece", "lang")
        .collect()
    )
    return [(r["piece"], r["lang"]) for r in rows]


def fit_language_model(labelled: DataFrame) -> Model:
    """From columns text and lang; rows without either do not count."""
    rows = sample(labelled.where("text is not null and lang is not null").select("text", "lang"))
    model = fit([r[0] for r in rows], [r[1] for r in rows])
    # The driver lives on after the fit.
    del rows
    forget_powers()
    give_back_memory()
    return model


def language_of(docs: DataFrame, model: Model) -> Column:
    """A struct (lang_pred, score) predicted from the column text alone."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def label(texts: pa.Array) -> pa.Array:
        best, score = predict(shared.value, texts)
        give_back_memory()
        names = pa.array(shared.value.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(score)], ["lang_pred", "score"])

    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.languages:
        return nothing
    text = some_text()
    return F.when(text.rlike(r"\p{L}"), label(text)).otherwise(nothing)


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with the columns lang_pred and score (which replace columns of these names)."""
    kept = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*kept, language_of(docs, model).alias("__found"))
    return found.select(*kept, "__found.lang_pred", "__found.score")


def drop_rejected(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """Rows whose language is known, with a mean marginal of at least `least`."""
    found = docs.withColumn("__found", language_of(docs, model))
    kept = found.where((F.col("__found.lang_pred") != UNKNOWN) & (F.col("__found.score") >= least))
    return kept.select(*[f"`{c}`" for c in docs.columns])
