"""Ranking, filtering and retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.text import RANK_STOPWORDS, RETRIEVAL_STOPWORDS, _folding, cosine, fold_accents, let, page_label, rank_tokens, retrieval_tokens, trim
from scholarframe.plans.views import NOW_YEAR

MIN_SIMILARITY = 0.2


def query_tokens(query: str) -> list[str]:
    """A query's distinct tokens, folded on the driver the way `rank_tokens` folds columns."""
    one, to, several = _folding()
    text = query.lower().translate(str.maketrans(one, to))
    text = "".join(several.get(char, char) for char in text)
    words = re.sub(r"[^a-z0-9\s]", " ", re.sub("[̀-ͯ]", "", text)).split()
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w not in RANK_STOPWORDS))


def relevance(tokens: list[str], title: Column, abstract: Column, authors: Column, venue: Column) -> Column:
    """Share of query tokens found, plus the shares found in the title and, else, in the authors; 1 for an empty query."""
    if not tokens:
        return F.lit(1.0)
    asked = F.array(*map(F.lit, tokens))
    in_title = F.array_intersect(asked, rank_tokens(title))
    in_authors = F.array_except(F.array_intersect(asked, F.flatten(F.transform(authors, lambda a: rank_tokens(a["name"])))), in_title)
    other = F.array_except(F.array_except(F.array_intersect(asked, F.concat(rank_tokens(abstract), rank_tokens(venue))), in_title), in_authors)
    return (2 * F.size(in_title) + 2 * F.size(in_authors) + F.size(other)) / F.lit(float(len(tokens)))


def asked_words(query: str):  # noqa: ANN201
    """What `relevance` takes from a text: a function to the query's tokens in it, parted by blanks, whose relevance is the text's own.

    A token of `rank_tokens` is a longest run of a-z and 0-9 in the folded text, so each asked one is looked for by itself."""
    tokens = query_tokens(query)
    held = lambda t: F.concat_ws(" ", *(F.when(t.rlike(rf"(?<![a-z0-9]){w}(?![a-z0-9])"), w) for w in tokens)) if tokens else F.lit("")
    return lambda text: let(fold_accents(F.lower(F.coalesce(text, F.lit("")))), held)


def base_score(citations: Column, sources: Column, year: Column, is_oa: Column, now_year: int = NOW_YEAR) -> Column:
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - (F.lit(now_year) - year) / 25.0), F.lit(0.0))
    return 2.0 * F.log10(F.coalesce(citations, F.lit(0)) + 1.0) + F.size(sources) + 0.8 * recency + F.when(is_oa, 0.3).otherwise(0.0)


def rank_works(works: DataFrame, query: str, now_year: int = NOW_YEAR) -> DataFrame:
    """works that share a token with the query, with relevance and score."""
    scored = works.withColumn("relevance", relevance(query_tokens(query), *(F.col(c) for c in ("title", "abstract", "authors", "venue")))).where("relevance > 0")
    return scored.withColumn("score", F.round(6.0 * F.col("relevance") + base_score(*(F.col(c) for c in ("citation_count", "sources", "year", "is_oa")), now_year=now_year), 6))


def rank_by_similarity(works: DataFrame, similar: DataFrame, key: str, now_year: int = NOW_YEAR) -> DataFrame:
    """works joined with (key, similarity); a missing one is 0, and under 0.2 goes."""
    scored = works.join(similar, key, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0))).where(F.col("similarity") >= MIN_SIMILARITY)
    return scored.withColumn("score", F.round(6.0 * F.col("similarity") + base_score(*(F.col(c) for c in ("citation_count", "sources", "year", "is_oa")), now_year=now_year), 6))


def filter_works(works: DataFrame, year_from: int | None = None, year_to: int | None = None, oa_only: bool = False, min_citations: int | None = None, sources: list[str] | None = None, venue: str | None = None) -> DataFrame:
    """A null year fails a year bound, null citations count as 0, any source of the list will do."""
    if year_from is not None:
        works = works.where(F.col("year") >= year_from)
    if year_to is not None:
        works = works.where(F.col("year") <= year_to)
    if oa_only:
        works = works.where("is_oa")
    if min_citations is not None:
        works = works.where(F.coalesce("citation_count", F.lit(0)) >= min_citations)
    if sources:
        works = works.where(F.arrays_overlap(F.col("sources.source_id"), F.array(*map(F.lit, sources))))
    if venue is not None:
        works = works.where(F.col("venue") == venue)
    return works


def page(works: DataFrame, number: int = 1, size: int = 20, order: str = "score", tie: str = "cluster") -> DataFrame:
    """A page of the ranking, by top-k: number from 1, size from 1 to 100."""
    number, size = max(1, number), min(100, max(1, size))
    return works.orderBy(F.col(order).desc(), F.col(tie)).offset((number - 1) * size).limit(size)


def similar_vectors(vectors: DataFrame, seed: int, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of a seed by exact cosine: the one seed row is broadcast, the top k is taken per task first."""
    one = vectors.where(F.col(key) == seed).select(F.col(vector).alias("seed")).limit(1)
    near = vectors.where(F.col(key) != seed).join(F.broadcast(one)).select(key, F.round(cosine(F.col(vector), F.col("seed")), 6).alias("similarity"))
    return near.orderBy(F.col("similarity").desc(), key).limit(min(25, k))


def lexical_tokens(query: str) -> list[str]:
    """A query's distinct tokens, cut on the driver the way `retrieval_tokens` cuts columns."""
    words = re.split("[^a-z0-9]+", query.lower())
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in RETRIEVAL_STOPWORDS))


def lexical_score(tokens: list[str], content: Column) -> Column:
    """Sum over distinct query tokens of 1 + ln(tf), over the root of the passage's token count."""

    asked = list(dict.fromkeys(tokens))

    def of(own: Column) -> Column:
        hits = [F.size(own) - F.size(F.array_remove(own, a)) for a in asked]
        total = sum((F.when(h > 0, 1 + F.log(h.cast("double"))).otherwise(0.0) for h in hits), F.lit(0.0))
        return F.when(F.size(own) > 0, total / F.sqrt(F.size(own).cast("double"))).otherwise(0.0)

    return let(retrieval_tokens(content), of)


def document_context(passages: DataFrame, group: str) -> DataFrame:
    """(group, context): each group's passages in the order of `rank`, under headings that name their pages."""
    block = F.concat(F.lit("["), page_label(F.col("page_start"), F.col("page_end")), F.lit("]\n"), trim(F.col("content")))
    ordered = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return passages.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def retrieve(passages: DataFrame, query: str, vector: list[float] | None, group: str, order: str, k: int = 8) -> DataFrame:
    """Each group's k best passages: by cosine to the query's vector among those that have an embedding, and by terms
    where a group has none, or there is no vector; `lexical` tells which, since their scores don't compare."""
    lexical = top_passages(passages, lexical_tokens(query), group, order, k).withColumn("lexical", F.lit(True))
    if vector is None:
        return lexical
    embedded = passages.where("embedding is not null")
    asked = F.array(*map(F.lit, vector))
    near = embedded.withColumn("score", F.round(cosine(F.col("embedding"), asked), 6))
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("score").desc(), F.col(order)))).where(F.col("rank") <= k)
    best = best.withColumn("lexical", F.lit(False))
    return best.unionByName(lexical.join(embedded.select(group).distinct(), group, "left_anti"))


def top_passages(passages: DataFrame, tokens: list[str], group: str, order: str, k: int = 8) -> DataFrame:
    """Each group's k best passages with a positive score."""
    scored = passages.withColumn("score", F.round(lexical_score(tokens, F.col("content")), 6)).where("score > 0")
    best = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col(order))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
