"""Markup patterns look for the angle bracket first, and find what alternatives of whole tags find."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from partition_audit.llm import warc

PLAIN = {
    "UNSEEN": r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<!doctype[^>]*>|<head.*?</head>",
    "BREAKS": r"(?i)</(p|div|li|h[1-6]|tr|title|article|section|ul|ol|table)>|<br[^>]*>",
    "UNLINKED": r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->",
}
ODD = [
    "<SCRIPT>a</script >b</Script><style>x</style><!-- <p> --><!DOCTYPE html><head>t</head>text</P><br/>a<BR>b",
    "a \t\r\n \n\n b  c\td  e\r\rf \n",
    "\t\n \r",
    "\u00a0a\u00a0 \u00a0b\u00a0",
    "<a href=\"x'\"> <a href='y\"\n'> <a href=z> <a href=\"\"> <a HREF = \"'q'\">",
    "<head>never closed <script>nor this <!-- nor that",
    "",
]


def test_an_angle_bracket_stands_before_the_alternatives():
    for name in PLAIN:
        assert re.match(r"\(\?\w+\)<\(\?:", getattr(warc, name))


def test_texts_and_links_are_those_of_the_plain_patterns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    text = F.regexp_replace(F.regexp_replace("t", PLAIN["UNSEEN"], " "), PLAIN["BREAKS"], "\n")
    text = F.regexp_replace(text, warc.TAGS, "")
    lines = F.regexp_replace(F.translate("t", " ", " "), r"[ \t\r]+", " ")
    lines = F.btrim(F.regexp_replace(lines, r" ?\n[ \n]*", "\n"), F.lit(" \n"))
    found = F.regexp_extract_all(F.regexp_replace("t", PLAIN["UNLINKED"], " "), F.lit(warc.LINK), F.lit(1))
    links = F.transform(found, lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    pairs = [(text, warc.without_markup(F.col("t"))), (lines, warc.even_lines(F.col("t"))), (links, warc.links(F.col("t")))]
    for plain, made in pairs:
        for row in rows.select(plain.alias("plain"), made.alias("made")).collect():
            assert row["plain"] == row["made"]
