"""Columns with the operators' own names, hot texts in the language sample, and HTML's character references."""

from __future__ import annotations

import html
from collections import Counter
from html.entities import html5

import duckdb
import pytest

from partition_audit.llm import language_crf as crf
from partition_audit.llm import suffix_repeats as rep
from partition_audit.llm import warc
from partition_audit.llm.byte_bpe import decode, encode
from partition_audit.llm.decontaminate import decontaminate
from partition_audit.llm.oracle import ORACLE_SQL
from partition_audit.llm.queries import op8_warc_derivatives

CLASHES = ["hit_id", "hit_key", "hit_spans", "row_key", "text_key", "spans", "__key", "words", "__words", "ids", "decoded", "w", "h", "k"]


def crowded(spark, rows):
    """Rows (doc_id, text) with a column under each of the operators' own names."""
    schema = ", ".join(["doc_id long", "text string", *[f"{c} string" for c in CLASHES]])
    return spark.createDataFrame([(i, t, *CLASHES) for i, t in rows], schema)


def test_decontamination_with_clashing_columns(spark):
    rows = [(1, "aa bb cc dd"), (2, "zz aa bb cc zz"), (2, "clean"), (None, None)]
    data = crowded(spark, rows)
    items = spark.createDataFrame([(1, "aa bb cc", "x")], "item_id long, text string, k string")
    kept = decontaminate(data, items)
    assert kept.columns == data.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (2, "clean")]
    cut = decontaminate(data, items, "spans")
    assert cut.columns == data.columns
    found = cut.collect()
    assert all(r[c] == c for r in found for c in CLASHES)
    assert sorted((r.doc_id or 0, (r.text or "").split()) for r in found) == [(0, []), (1, ["dd"]), (2, ["clean"]), (2, ["zz", "zz"])]


def test_tokens_with_clashing_columns(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    data = crowded(spark, [(1, "some text"), (2, None)])
    coded = decode(encode(data, path, public.PATTERN), path)
    assert sorted(coded.columns) == sorted(data.columns)
    found = {r.doc_id: r for r in coded.collect()}
    assert bytes(found[1].decoded) == b"some text" and bytes(found[2].decoded) == b"" == bytes(found[2].ids)
    assert all(found[1][c] == c for c in CLASHES if c not in ("ids", "decoded"))


def test_hot_text_takes_one_place_of_the_language_sample(spark):
    rows = [("uno dos tres", "es")] * 20_000
    rows += [(f"le mot {i} de la rue", "fr") for i in range(50)] + [(f"the word {i} of the street", "en") for i in range(50)]
    rows += [(f"una palabra {i} de la calle", "es") for i in range(1_500)]
    table = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    chosen = Counter(lang for _, lang in crf.sample(table))
    assert chosen == {"fr": 50, "en": 50, "es": crf.SAMPLE_PER_LANGUAGE}
    assert len(set(crf.sample(table))) == sum(chosen.values())
    assert crf.sample(table.limit(0)) == []


def test_repeats_refuse_lengths_they_cannot_hold(spark):
    data = spark.createDataFrame([(1, "x" * 400), (2, "x" * 400)], "doc_id long, text string")
    with pytest.raises(ValueError, match="least"):
        rep.without_repeats(data, 132).collect()
    assert {r.doc_id: r.n_removed for r in rep.without_repeats(data, 131).collect()} == {1: 0, 2: 400}


ODD = ["&", "&&amp;", "&#0;", "&#13;", "&#128;&#x9F;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#11;x", "&#65", "&#X41;", "&#xfffe;",
       "&#;", "&#x;", "&ampx", "&notin;", "&notit;", "&amp;lt;", "&unknown;", "&copy 1", "a&b", "&lt;p&gt;", "&NewLine;y", "&Tab;", "&nbsp;&nbsp;z", "\u00a0q",
       "&bne;", "&thisnameistoolongtobeareferenceofhtml;", "caf&eacute; &#233; &copy;", "&#x1F600;"]


def test_references_and_links(spark, tmp_path):
    pages = [(i, f"http://a/{i}", f"<p>{t}</p>") for i, t in enumerate(ODD)]
    pages += [(100, "u", " ".join(f"&{name}" for name in html5)), (100, "u", "&lt;"), (None, "u", "no id"), (102, None, None), (103, "", ""),
              (104, "u", "long &eacute; " * 50_000)]
    links = """<title>A&ouml; \n b</title><a href="/a?x=1&amp;y=2">1</a><A class=k HREF='q&#39;s'>2</A><a href=plain>3</a><a href="">4</a>
        <abbr href="no">x</abbr><!-- <a href="hidden"> --><script>"<a href='js'>"</script><a name="n">5</a><a\nhref = "two\nlines">"""
    pages += [(200, "u", links)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    table.write.parquet(str(tmp_path / "pages.parquet"))
    found = op8_warc_derivatives(spark, str(tmp_path))
    rows = [tuple(r) for r in found.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL['op8_warc_derivatives']})").fetchall()
    assert Counter(rows) == Counter(want) and len(rows) == 2 * (len(pages) - 1)
    plain = [r.block for r in found.where("type = 'conversion'").collect()]
    for text in ODD:
        lines = html.unescape(text).replace("\u00a0", " ").replace("\t", " ").replace("\r", " ")
        assert "\n".join(" ".join(x.split(" ")).strip(" ") for x in lines.split("\n")).strip(" \n").replace("  ", " ") in plain
    block = next(r.block for r in found.where("type = 'metadata'").collect() if "outlinks: 5" in r.block)
    assert block.split("\r\n")[0] == "title: A\u00f6 b"
    assert [x for x in block.split("\r\n") if x.startswith("outlink: ")] == [f"outlink: {x}" for x in ("/a?x=1&y=2", "q's", "plain", "", "two lines")]
    empty = table.limit(0).selectExpr("'' record_id", "url target_uri", "'' date", "'' content_type", "html payload")
    assert warc.derivatives(empty).count() == 0
