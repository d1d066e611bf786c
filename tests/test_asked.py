"""Ranking from what a query asks of a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarframe.operators import integrate, rank
from tests.test_growth import WORKS

QUERY = "It was not them, Ünder 2nd"


def test_asked_words_rank_as_the_text_does(spark):
    texts = ["It wasn't them", "NÔT; théḿ", "was_not", "iti wast notx", "", None, "ﬁt it was", "x\tnot\nwas 2nd", "²nd únder", "them" * 3, "-them-"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    asked, whole = rank.asked_words(QUERY)(F.col("t")), F.array_intersect(F.array(*map(F.lit, rank.query_tokens(QUERY))), rank.rank_tokens(F.col("t")))
    for r in rows.select("t", asked.alias("asked"), F.array_join(whole, " ").alias("whole")).collect():
        assert r.asked == r.whole, r.t


def test_the_longest_abstract_counts_whatever_is_asked_of_it(spark):
    """The longest abstract of a work has none of the query's words, a shorter one has; no text is needed to tell."""
    rows = [(1, "arxiv", "1", "10.1/x", "t", "it was not them", [("a", None)], 2000, "v", 1, False, None), (2, "core", "2", "10.1/x", "t", "something else at length", [("a", None)], 2000, "v", 1, False, None), (3, "core", "3", None, "t", "not", [("a", None)], None, None, None, None, None)]
    works = spark.createDataFrame(rows, WORKS)
    short = works.withColumn("abstract_length", F.length("abstract")).withColumn("abstract", rank.asked_words(QUERY)(F.col("abstract")))
    told = lambda w: sorted((r.cluster, r.score) for r in rank.rank_works(integrate.reconcile(integrate.cluster_by_doi(w)), QUERY).collect())
    assert told(short) == told(works) and [c for c, _ in told(short)] == [3]
