"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partition_audit.llm.best_fit_packing import Capacity, pack_documents
from partition_audit.llm.bloom_lm import score_documents
from partition_audit.llm.byte_bpe import decode, encode
from partition_audit.llm.decontaminate import contamination
from partition_audit.llm.exact_dedup import exact_groups
from partition_audit.llm.hard_negatives import hard_negatives
from partition_audit.llm.language_crf import fit_language_model, with_language
from partition_audit.llm.license_scan import scan_licenses
from partition_audit.llm.ngram_join import near_duplicates
from partition_audit.llm.suffix_repeats import without_repeats
from partition_audit.llm.token_alignment import align_tokenizers
from partition_audit.llm.url_filter import Rule, url_verdicts
from partition_audit.llm.warc import as_record, derivatives, derived_id

Query = Callable[[SparkSession, str], DataFrame]

RANKS = "byte_bpe_multi_50k.tiktoken"
URL_RULES: list[Rule] = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
WARC_DATE = "2024-01-01T00:00:00Z"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo `folds`; NULL counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    coded = decode(encode(docs.select("doc_id", "text"), ranks_path, pattern).drop("text"), ranks_path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(
        _table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_documents(docs, fold("doc_id", 7) != 2)
    return scored.withColumn("held_out", ~F.col("trains")).drop("trains")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=90, count_links=True)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    responses = pages.select(
        derived_id("response", F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(WARC_DATE).alias("date"),
        F.lit("text/html").alias("content_type"),
        F.col("html").alias("payload"),
    )
    records = derivatives(responses)
    return records.withColumn("record_sha256", F.sha2(as_record(records), 256))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = fit_language_model(docs.where(~held_out))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    named = rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(named, F.col("id") % 50 == 0)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), Capacity(tokens=2048))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"),
    )


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_decontamination,
        op2_byte_bpe,
        op3_exact_dedup,
        op4_url_filter,
        op5_license_scan,
        op6_bloom_lm,
        op7_ngram_join,
        op8_warc_derivatives,
        op9_language_crf,
        op10_suffix_repeats,
        op11_hard_negatives,
        op12_best_fit_packing,
        op13_token_alignment,
    )
}
