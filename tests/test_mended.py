"""Markers, drafts, years, pages and retrieval on the inputs that once went wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scholarframe.functions import text as T
from scholarframe.operators import evidence, rank
from scholarframe.sources import records


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x ]] y", [("text", "x ]] y")]),
        ("[[k]] b ]] c", [("citation", "k"), ("text", " b ]] c")]),
        ("", []),
        ("[[a]][[ b ]]", [("citation", "a"), ("citation", "b")]),
        ("[[ ]]x[[]]", [("citation", ""), ("text", "x[[]]")]),
        ("a [[b\nc]] d", [("text", "a "), ("citation", "b\nc"), ("text", " d")]),
        (None, None),
    ],
)
def test_segments_by_position(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.marker_segments(F.col("t")).alias("s")).first().s
    assert got is None if want is None else [tuple(s) for s in got] == want


def test_draft_keys_are_not_patterns(spark):
    drafts = spark.createDataFrame([(1, "One [[k(1]] and [[abc]]. Two [[ a.c ]] ]] x. Three [[+|]]. Four [[b]]."), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r for r in evidence.validate_draft(drafts, "id", "text", ["k(1", "a.c", "+|", "[", "\\"]).collect()}
    assert got[1].text == "One [[k(1]] and .\nTwo [[ a.c ]] ]] x.\nThree [[+|]]."
    assert (got[1].dropped_uncited, got[1].dropped_foreign) == (1, 2) and set(got) == {1}
    none = evidence.validate_draft(drafts, "id", "text", []).first()
    assert (none.text, none.dropped_uncited, none.dropped_foreign) == ("", 4, 5)


def test_years_and_pages_in_each_source_s_words(spark):
    one = spark.createDataFrame([(1999, None), (None, 2004), (None, None)], "a int, b int")
    words = lambda s: [r[0] for r in one.select(records.year_filter(s, F.col("a"), F.col("b"), 2026)).collect()]
    assert words("semanticscholar") == ["1999-", "-2004", None]
    assert words("europepmc") == ["PUB_YEAR:[1999 TO 2026]", "PUB_YEAR:[1000 TO 2004]", None]
    assert words("arxiv") == words("pubmed") == [None] * 3
    asked = spark.createDataFrame([(0, -5), (-3, 0), (2, 500), (None, None)], "page int, size int")
    assert [tuple(r[0]) for r in asked.select(records.page_window("openalex", F.col("page"), F.col("size"))).collect()] == [(20, 0), (20, 0), (50, 50), (20, 0)]


def test_retrieval_cuts_queries_like_passages(spark):
    passages = spark.createDataFrame([("d", 1, "On gene expression in yeast.", None), ("d", 2, "Nothing of it", None)], "doc string, place long, content string, embedding array<double>")
    got = rank.retrieve(passages, "What is the gene? (expression!)", None, "doc", "place").collect()
    assert [(r.place, r.lexical) for r in got] == [(1, True)] and got[0].score == round(2 / 3**0.5, 6)


def test_known_only_keeps_order_and_repeats(spark):
    rows = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, ["x"]), (3, []), (4, None)], "id long, c array<string>")
    known = spark.createDataFrame([("a",), ("b",), ("b",)], "concept string")
    assert {r.id: r.c for r in evidence.known_only(rows, "id", "c", known, "concept").collect()} == {1: ["b", "a", "b"], 2: [], 3: [], 4: []}
