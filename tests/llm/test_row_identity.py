"""Near duplicates of rows without an id and of different texts under one id."""

from __future__ import annotations

from collections import Counter

from partition_audit.llm import ngram_join as ngj


def words(name, *changed, n=40):
    return " ".join(f"{name}{i}" if i not in changed else f"other{i}" for i in range(n))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_links_of_rows_without_an_id(spark):
    chain = [(None, words("a")), (None, words("a", 0)), (5, words("a", 0, 39))]
    rows = [*chain, (None, words("b")), (None, words("b")), (None, words("c"))]
    found = Counter(tuple(r) for r in ngj.near_duplicates(table(spark, rows), 1, 94).collect())
    assert found == Counter({(None, 40, 5): 2, (5, 40, 5): 1, (None, 40, None): 3})
    kept = Counter(tuple(r) for r in ngj.drop_near_duplicates(table(spark, rows), 1, 94).collect())
    assert kept == Counter([(5, words("a", 0, 39)), (None, words("b")), (None, words("c"))])


def test_one_row_of_a_class_without_ids(spark):
    rows = [(None, words("a")), (None, words("a", 0)), (None, words("a", 39)), (None, None), (None, None)]
    kept = [r.text for r in ngj.drop_near_duplicates(table(spark, rows), 1, 90).collect()]
    assert kept.count(None) == 2 and len(kept) == 3


def test_different_texts_under_one_id(spark):
    one, two = words("a"), words("b")
    rows = [(1, one), (1, two), (2, words("a", 0)), (3, words("b", 0)), (1, one)]
    found = {tuple(r) for r in ngj.near_duplicates(table(spark, rows), 1, 90).collect()}
    assert found == {(1, 40, 1), (2, 40, 1), (3, 40, 1)}
    rows += [(1, words("a", 39))]
    kept = [r.text for r in ngj.drop_near_duplicates(table(spark, rows), 1, 90).collect()]
    assert len(kept) == 2 and two in kept and set(kept) < {one, two, words("a", 39)}
