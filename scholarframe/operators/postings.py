"""Retrieval for many queries at once: a postings table joined with a query table, and what is read from the passages found.

Passages have a group (the document that is asked), an order within it, and content.  Queries have an id and a text.  Terms are
those of `retrieval_tokens`, for both.  A passage's score is the sum over a query's distinct terms of 1 + ln(tf), over the root of the passage's
number of terms: the same as `rank.lexical_score` gives for one query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.text import retrieval_tokens, trim
from scholarframe.operators.evidence import quote_appears

#: What findings are sought by, and passages read for a finding and for a matrix cell.
FINDING_QUERIES = (
    "sample size, number of participants recruited and analysed, study duration and follow-up",
    "study design, randomisation, blinding, control condition, primary outcome measure",
    "p values, confidence intervals and effect sizes for the primary outcome",
)
FINDING_PASSAGES, CELL_PASSAGES = 3, 4


def postings(passages: DataFrame, group: str, order: str) -> DataFrame:
    """(term, group, order, tf, length): how often each term stands in each passage, and the passage's number of terms.

    A passage's terms are counted within its row, so texts are not shuffled.  Passages without terms give no rows."""
    n = F.size("terms")
    told = passages.select(group, order, F.array_sort(retrieval_tokens(F.col("content"))).alias("terms")).where(n > 0)
    # Equal terms are neighbours: a run's length is the distance of two starts.
    starts = F.filter(F.transform("terms", lambda t, i: F.when((i == 0) | (t != F.get("terms", i - 1)), i)), lambda i: i.isNotNull())
    told = told.select(group, order, "terms", n.alias("length"), starts.alias("starts"))
    runs = F.transform("starts", lambda s, i: F.struct(F.get("terms", s).alias("term"), (F.coalesce(F.get("starts", i + 1), F.col("length")) - s).cast("long").alias("tf")))
    return told.select(group, order, "length", F.explode(runs).alias("run")).select("run.term", group, order, "run.tf", "length")


#: Asked terms that are sent to every task; more of them are joined by shuffle.
FEW_TERMS = 20_000


def retrieve_many(index: DataFrame, queries: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """(query_id, group, order, score, rank): each query's k best passages of each group, ties by order.

    index is a postings table, queries has query_id and text.  Postings of terms that nobody asks for are dropped where they are, as long as
    no more than FEW_TERMS are asked; their scores are summed
    before any ranking, and the ranks of a query and group are cut to k before they are shuffled.  A query without terms finds nothing."""
    asked = queries.select("query_id", F.explode(F.array_distinct(retrieval_tokens(F.col("text")))).alias("term"))
    few = asked.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    hits = index.join(F.broadcast(asked) if few else asked, "term")
    scored = hits.groupBy("query_id", group, order).agg(F.sum(1 + F.log(F.col("tf").cast("double"))).alias("total"), F.first("length").alias("length"))
    scored = scored.select("query_id", group, order, F.round(F.col("total") / F.sqrt(F.col("length").cast("double")), 6).alias("score"))
    best = Window.partitionBy("query_id", group).orderBy(F.col("score").desc(), F.col(order))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def excerpts(found: DataFrame, passages: DataFrame, group: str, order: str) -> DataFrame:
    """(query_id, group, passages): the passages found, as structs (rank, page_start, content) by rank, for each query and group."""
    told = found.join(passages.select(group, order, "page_start", "content"), [group, order])
    ordered = F.sort_array(F.collect_list(F.struct("rank", "page_start", "content")))
    return told.groupBy("query_id", group).agg(ordered.alias("passages"))


def _read(excerpt: DataFrame, answers: DataFrame, group: str) -> DataFrame:
    """answers with the excerpt they were read from: source, its passages joined under their pages, and page, that of the first passage with the quote."""
    blocks = F.transform("passages", lambda p: F.concat(F.lit("[page "), p["page_start"].cast("string"), F.lit("]\n"), p["content"]))
    holding = F.get(F.filter("passages", lambda p: quote_appears(p["content"], F.col("quote"))), 0)["page_start"]
    joined = excerpt.withColumn("source", F.array_join(blocks, "\n\n---\n\n")).join(answers, ["query_id", group], "left")
    return joined.withColumn("page", F.coalesce(holding, F.get("passages", 0)["page_start"]))


def fill_cells(excerpt: DataFrame, answers: DataFrame, group: str) -> DataFrame:
    """(query_id, group, status, value, unit, quote, page) of each matrix cell with passages.

    answers has query_id, group, found (boolean; null: the answer could not be read), value, unit and quote.  A cell is `found` if its quote stands in
    the passages and its value in the quote; otherwise it is `not_reported`, with nulls.  A cell without an answer, or
    whose answer could not be read, is an `error`."""
    said = _read(excerpt, answers.withColumn("value", trim(F.col("value"))).withColumn("quote", trim(F.col("quote"))), group)
    holds = quote_appears(F.col("source"), F.col("quote")) & quote_appears(F.col("quote"), F.col("value"))
    status = F.when(F.col("found").isNull(), "error").when(F.coalesce(F.col("found") & holds, F.lit(False)), "found").otherwise("not_reported")
    told = said.withColumn("status", status)
    only = lambda c: F.when(F.col("status") == "found", c)
    return told.select("query_id", group, "status", only(F.col("value")).alias("value"), only(F.nullif(trim(F.col("unit")), F.lit(""))).alias("unit"), only(F.col("quote")).alias("quote"), only(F.col("page")).alias("page"))


def findings(excerpt: DataFrame, answers: DataFrame, group: str) -> DataFrame:
    """(group, field, value, unit, quote, page): what answers found that is quoted, each field and value of a group once: that of the
    first query, then of the smallest place.

    answers has query_id, group, place (within the answer), field, value, unit and quote."""
    said = _read(excerpt, answers, group)
    kept = said.where(quote_appears(F.col("source"), F.col("quote")) & quote_appears(F.col("quote"), F.col("value")) & F.col("field").isNotNull())
    first = F.min_by(F.struct("unit", "quote", "page"), F.struct("query_id", "place")).alias("first")
    return kept.groupBy(group, "field", "value").agg(first).select(group, "field", "value", "first.unit", "first.quote", "first.page")
