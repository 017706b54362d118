"""WARC derivative builder: metadata and plain-text conversion records of responses.

Every response gives two WARC 1.1 records that point back to it: `metadata` (title, language, number of
links, one `outlink` line per link as written in the page, length of the payload, as warc-fields) and `conversion` (the page's text). Both carry WARC-Refers-To with the
response's record id, the response's target URI, date and HTTP headers' content type as
source headers, and digests of their own block and of the source payload. Record ids are derived from
the response's id, so a rerun gives the same records.

Everything works on single rows: no shuffle, and the output is as large as the text. Markup goes by Spark
SQL functions; character references (all named, decimal and hexadecimal ones of HTML) are decoded in
Arrow batches once the markup is gone, so that a decoded `<` is text. Non-breaking spaces become spaces.
Links are the href values of `a` elements outside scripts, styles and comments, empty ones included.
NULL payloads count as empty, a NULL target URI leaves its header line out, and a response without a
record id gives no derivatives, as nothing could refer to it. Repeated rows give repeated records.
"""

from __future__ import annotations

from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partition_audit.llm.shared import bounded_batches

CRLF = "\r\n"
VERSION = "WARC/1.1"

# Blocks whose content is not text, tags that end a line, and what is left of markup.
# The angle bracket stands before the alternatives, so that they are tried only where there is one.
UNSEEN = r"(?is)<(?:script.*?</script>|style.*?</style>|!--.*?-->|!doctype[^>]*>|head.*?</head>)"
BREAKS = r"(?i)<(?:/(?:p|div|li|h[1-6]|tr|title|article|section|ul|ol|table)>|br[^>]*>)"
TAGS = r"<[^>]*>"
UNLINKED = r"(?is)<(?:script.*?</script>|style.*?</style>|!--.*?-->)"
SPACE = r"[ \t\r\n\f]"
LINK = rf"""(?i)<a{SPACE}(?:[^>]*?{SPACE})?href{SPACE}*={SPACE}*("[^"]*"|'[^']*'|[^ \t\r\n\f"'>]+)"""


@F.arrow_udf(T.ArrayType(T.StringType()))
def decoded(pieces: pa.Array) -> pa.Array:
    """Every text with its character references replaced by what they stand for."""
    rows = [[unescape(t) if "&" in t else t for t in row] for row in pieces.to_pylist()]
    return pa.array(rows, pa.list_(pa.string()))


def without_markup(html: Column) -> Column:
    text = F.regexp_replace(html, UNSEEN, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    return F.regexp_replace(text, TAGS, "")


def even_lines(text: Column) -> Column:
    # Single spaces and line ends that stay are not matched.
    text = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r" [ \t\r]+|[\t\r][ \t\r]*", " ")
    return F.btrim(F.regexp_replace(text, r" \n[ \n]*|\n[ \n]+", "\n"), F.lit(" \n"))


def one_line(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, f"{SPACE}+", " "), F.lit(" "))


def links(html: Column) -> Column:
    found = F.regexp_extract_all(F.regexp_replace(html, UNLINKED, " "), F.lit(LINK), F.lit(1))
    quoted = lambda v: F.left(v, F.lit(1)).isin('"', "'")
    return F.transform(found, lambda v: F.when(quoted(v), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))


def derived_id(*parts: Column | str) -> Column:
    """A urn:uuid made of the parts' MD5; NULL if one of them is."""
    texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    h = F.md5(F.concat(texts[0], *[x for t in texts[1:] for x in (F.lit("|"), t)]))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    dashed = [x for part in cut[1:] for x in (F.lit("-"), part)]
    return F.concat(F.lit("<urn:uuid:"), cut[0], *dashed, F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def derivatives(responses: DataFrame) -> DataFrame:
    """Records of responses (record_id, target_uri, date, content_type, payload).

    Columns: record_id, type, refers_to, target_uri, date, source_content_type, source_digest,
    content_type, block_digest, block; `as_record` makes the WARC text of a row.
    """
    payload = F.coalesce("payload", F.lit(""))
    title = F.regexp_extract("payload", r"(?is)<title>(.*?)</title>", 1)
    pieces = F.concat(F.array(without_markup(F.col("payload")), title), links(F.col("payload")))
    source = (
        bounded_batches(responses)
        .where("record_id is not null")
        .select("record_id", "target_uri", "date", F.col("content_type").alias("source_content_type"), payload.alias("payload"))
        .withColumn("pieces", decoded(pieces))
    )
    text = even_lines(F.element_at("pieces", 1))
    outlinks = F.slice("pieces", 3, F.size("pieces"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), one_line(value), F.lit(CRLF))

    lines = [
        line("title", F.element_at("pieces", 2)),
        line("language", F.regexp_extract("payload", r"(?is)<html[^>]*lang=\"([^\"]*)\"", 1)),
        line("outlinks", F.size(outlinks).cast("string")),
        F.array_join(F.transform(outlinks, lambda v: line("outlink", v)), ""),
        line("payload-length", F.octet_length("payload").cast("string")),
    ]
    made = source.select(
        "record_id",
        "target_uri",
        "date",
        "source_content_type",
        digest(F.col("payload")).alias("source_digest"),
        F.explode(
            F.array(
                F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("mime"), F.concat(*lines).alias("block")),
                F.struct(F.lit("conversion").alias("type"), F.lit("text/plain").alias("mime"), text.alias("block")),
            )
        ).alias("made"),
    )
    return made.select(
        derived_id(F.col("record_id"), F.col("made.type")).alias("record_id"),
        F.col("made.type").alias("type"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "source_content_type",
        "source_digest",
        F.col("made.mime").alias("content_type"),
        digest(F.col("made.block")).alias("block_digest"),
        F.col("made.block").alias("block"),
    )


def as_record(records: DataFrame) -> Column:
    """The record as it stands in a WARC file, without the two line ends that follow it."""
    headers = [
        ("WARC-Type", F.col("type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("date")),
        ("WARC-Source-Content-Type", F.col("source_content_type")),
        ("WARC-Source-Digest", F.col("source_digest")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")),
        ("Content-Length", F.octet_length("block").cast("string")),
    ]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in headers]  # NULL: no line
    return F.concat(F.lit(VERSION + CRLF), F.concat_ws("", *lines), F.lit(CRLF), F.col("block"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one per task."""
    rows = records.select(as_record(records).alias("value"))
    rows.write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)
