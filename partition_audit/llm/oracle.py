"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from html import unescape
from html.entities import html5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str) -> str:
    return f"""SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"""


def _uuid(text: str) -> str:
    cut = " || '-' || ".join(f"substr(md5({text}), {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"('<urn:uuid:' || {cut} || '>')"


_WARC_TEXT = "coalesce(html, '')"
for _pattern, _put in (
    ("(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<!doctype[^>]*>|<head.*?</head>", "' '"),
    ("(?i)</(p|div|li|h[1-6]|tr|title|article|section|ul|ol|table)>|<br[^>]*>", "chr(10)"),
    ("<[^>]*>", "''"),
):
    _WARC_TEXT = f"regexp_replace({_WARC_TEXT}, '{_pattern}', {_put}, 'g')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPACE = "[ \\t\\r\\n\\f]"
_NAMES = f"MAP([{', '.join(map(_text, html5))}], [{', '.join(map(_text, html5.values()))}])"
_REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)|[^&]+|&"
# References to 128-159 stand for the characters of Windows-1252.
_WINDOWS = _text("".join(unescape(f"&#{n};") or "?" for n in range(128, 160)))


def _character(digits: str) -> str:
    n = f"coalesce(TRY_CAST({digits} AS BIGINT), 1114112)"
    return f"""CASE WHEN {n} = 0 OR {n} BETWEEN 55296 AND 57343 OR {n} > 1114111 THEN chr(65533)
        WHEN {n} BETWEEN 128 AND 159 THEN substr({_WINDOWS}, CAST({n} AS INT) - 127, 1)
        WHEN {n} BETWEEN 1 AND 8 OR {n} IN (11, 127) OR {n} BETWEEN 14 AND 31 OR {n} BETWEEN 64976 AND 65007 OR {n} % 65536 >= 65534 THEN ''
        ELSE chr(CAST({n} AS INT)) END"""


def _decoded(text: str) -> str:
    """`text` with its character references decoded; `m` holds the named ones."""
    longest = "list_filter(range(len(x) - 2, 1, -1), lambda k: map_contains(m, substr(x, 2, k)))[1]"
    return f"""array_to_string(list_transform(regexp_extract_all({text}, '{_REFERENCE}'), lambda x: CASE
        WHEN x[1] <> '&' OR x = '&' THEN x
        WHEN lower(x[1:3]) = '&#x' THEN {_character("'0x' || rtrim(substr(x, 4), ';')")}
        WHEN x[1:2] = '&#' THEN {_character("rtrim(substr(x, 3), ';')")}
        WHEN map_contains(m, substr(x, 2)) THEN m[substr(x, 2)]
        ELSE coalesce(m[substr(x, 2, {longest})] || substr(x, 2 + {longest}), x) END), '')"""


_WARC_EVEN = f"regexp_replace(replace({_decoded('bare')}, chr(160), ' '), '[ \\t\\r]+', ' ', 'g')"
_WARC_EVEN = f"trim(regexp_replace({_WARC_EVEN}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
_WARC_LINKS = f"""list_transform(regexp_extract_all(
    regexp_replace(p, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'),
    '(?i)<a{_SPACE}(?:[^>]*?{_SPACE})?href{_SPACE}*={_SPACE}*("[^"]*"|''[^'']*''|[^ \\t\\r\\n\\f"''>]+)', 1),
    lambda v: regexp_replace(v, '^["'']|["'']$', '', 'g'))"""
_EOL = "chr(13) || chr(10)"


def _field(name: str, value: str) -> str:
    return f"'{name}: ' || trim(regexp_replace({value}, '{_SPACE}+', ' ', 'g'), ' ') || {_EOL}"


_WARC_FIELDS = " || ".join(
    [
        _field("title", _decoded("regexp_extract(p, '(?is)<title>(.*?)</title>', 1)")),
        _field("language", "regexp_extract(p, '(?is)<html[^>]*lang=\"([^\"]*)\"', 1)"),
        _field("outlinks", "CAST(len(links) AS VARCHAR)"),
        f"array_to_string(list_transform(links, lambda v: {_field('outlink', _decoded('v'))}), '')",
        _field("payload-length", "CAST(strlen(p) AS VARCHAR)"),
    ]
)
_WARC_HEADERS = " || ".join(
    f"coalesce('{name}: ' || {value} || {_EOL}, '')"
    for name, value in (
        ("WARC-Type", "type"),
        ("WARC-Record-ID", "record_id"),
        ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"),
        ("WARC-Source-Content-Type", "source_content_type"),
        ("WARC-Source-Digest", "source_digest"),
        ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"),
        ("Content-Length", "CAST(strlen(block) AS VARCHAR)"),
    )
)

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS ({_words("documents", "doc_id")}),
        i AS ({_words("benchmark", "item_id")}),
        g AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda a: array_to_string(w[a:a + k - 1], ' '))) AS gram
              FROM (SELECT *, least(len(w), 10) AS k FROM i WHERE len(w) > 0)),
        win AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS p,
                unnest(list_transform(range(1, len(w) - k + 2), lambda a: array_to_string(w[a:a + k - 1], ' '))) AS gram
                FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
        hit AS (SELECT doc_id, p, k, item_id FROM win JOIN g USING (k, gram)),
        n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, p + unnest(range(0, k)) AS q FROM hit) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op8_warc_derivatives": f"""
        WITH names AS MATERIALIZED (SELECT {_NAMES} AS m),
        page AS (SELECT {_uuid("'response|' || CAST(page_id AS VARCHAR)")} AS rid, url, coalesce(html, '') AS p, {_WARC_TEXT} AS bare
                 FROM pages WHERE page_id IS NOT NULL),
        r AS (SELECT rid, url, p, m, {_WARC_EVEN} AS plain, {_WARC_LINKS} AS links FROM page, names),
        made AS (SELECT rid, url, p, 'metadata' AS type, 'application/warc-fields' AS content_type, {_WARC_FIELDS} AS block FROM r
                 UNION ALL SELECT rid, url, p, 'conversion', 'text/plain', plain FROM r),
        rec AS (SELECT {_uuid("rid || '|' || type")} AS record_id, type, rid AS refers_to, url AS target_uri,
                '2024-01-01T00:00:00Z' AS date, 'text/html' AS source_content_type, 'sha256:' || sha256(p) AS source_digest,
                content_type, 'sha256:' || sha256(block) AS block_digest, block FROM made)
        SELECT *, sha256('WARC/1.1' || {_EOL} || {_WARC_HEADERS} || {_EOL} || block) AS record_sha256 FROM rec
    """,
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""",
}
