"""Queries on integrated works: clustering, reconciliation, ranking, facets, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.functions import text as T
from scholarframe.operators import integrate, rank
from scholarframe.plans.tables import settle, table
from scholarframe.plans.views import RAW_WORK_SQL, raw_work

QUERY = "It was not them"
PASSAGE_QUERY = "tion ation that have been only"


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.reconcile(integrate.cluster_by_doi(raw_work(spark, sf_dir)))


def ranked_works(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Works ranked for a query, as `rank_works` ranks canonical ones; `abstract` is only the query's words in it, so texts are read once and not shuffled."""
    works = settle(raw_work(spark, sf_dir, rank.asked_words(query)), "works")
    return rank.rank_works(integrate.reconcile(integrate.cluster_by_doi(works)), query)


def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank.filter_works(ranked_works(spark, sf_dir, QUERY), year_from=1995, min_citations=5)
    return rank.page(ranked, 1, 20).select("cluster", "score", F.round("relevance", 6).alias("relevance"), "year", "citation_count", F.size("sources").alias("n_sources"))


def cluster_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrate.cluster_by_doi(raw_work(spark, sf_dir)).select("ord", "cluster")


def cluster_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = raw_work(spark, sf_dir)
    edges = integrate.doi_edges(works).union(integrate.fuzzy_edges(works))
    return integrate.cluster(works, edges).select("ord", "cluster")


def reconcile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark, sf_dir).select("cluster", "title", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "doi", F.get("authors", 0)["name"].alias("author"), "year", "venue", "citation_count", "is_oa", "pdf_url", F.size("sources").alias("n_sources"), F.array_join(F.col("sources.source_id"), ",").alias("source_ids"), "work_key")


def normalize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = raw_work(spark, sf_dir)
    messy = F.concat(F.lit("  HTTPS://dx.doi.org/"), F.upper("doi"))
    return works.select("ord", T.normalize_title(F.col("abstract")).alias("title"), T.normalize_doi(messy).alias("doi"), T.surname(F.col("authors")).alias("surname"))


def work_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = raw_work(spark, sf_dir)
    return works.select("ord", T.work_key(F.col("doi"), F.col("title"), F.col("year"), T.surname(F.col("authors")), F.col("venue")).alias("work_key"))


def filter_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rank.filter_works(canonical(spark, sf_dir), year_from=2000, year_to=2020, oa_only=True, min_citations=50, sources=["crossref", "pubmed", "arxiv"])
    return kept.select("cluster", "year", "citation_count")


def venue_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 commonest venues, ties by first sight."""
    named = canonical(spark, sf_dir).where("venue is not null")
    counted = named.groupBy(F.col("venue").alias("name")).agg(F.count("*").alias("n"), F.min("cluster").alias("first"))
    return counted.orderBy(F.col("n").desc(), "first").limit(15).select("name", "n")


def similar_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.similar_vectors(table(spark, sf_dir, "embeddings"), seed=0, k=10)


def semantic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose vector is like the query's, the first vector; base score breaks ties."""
    vectors = table(spark, sf_dir, "embeddings")
    seed = vectors.where("vec_id = 0").select(F.col("embedding").alias("seed"))
    near = vectors.join(F.broadcast(seed)).select(F.col("vec_id").alias("cluster"), F.round(T.cosine(F.col("embedding"), F.col("seed")), 6).alias("similarity"))
    return rank.rank_by_similarity(canonical(spark, sf_dir), near, "cluster").select("cluster", "similarity", "score")


def retrieve_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three vectors of each label nearest to the first one."""
    from pyspark.sql import Window

    vectors = table(spark, sf_dir, "embeddings")
    seed = vectors.where("vec_id = 0").select(F.col("embedding").alias("seed"))
    scored = vectors.join(F.broadcast(seed)).select("label", "vec_id", F.round(T.cosine(F.col("embedding"), F.col("seed")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id"))).where("rank <= 3")


def retrieve_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's eight best documents for a query, by term overlap."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("content"))
    asked = ["tion", "ation", "only", "this", "they", "have", "which", "pour", "avec", "nicht"]
    return rank.top_passages(docs, asked, "source", "doc_id").select("source", "doc_id", "score", "rank")


def synthesis_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top eight works as numbered blocks of one text."""
    top = rank.page(ranked_works(spark, sf_dir, QUERY), 1, 8).select("cluster", "score", "title", "year")
    block = F.format_string("[%d] %s (%s)", F.col("n"), F.col("title"), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")))
    ordered = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "cluster", "title", "year"))).alias("w"))
    numbered = ordered.select(F.posexplode("w").alias("i", "w")).select((F.col("i") + 1).alias("n"), "w.title", "w.year")
    return numbered.agg(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))).alias("b")).select(F.array_join(F.col("b.b"), "\n\n").alias("context"))


def jaccard_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether consecutive documents look like the same work; some have no text, or no word in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 17 != 3, F.when(F.col("doc_id") % 17 < 2, " .").otherwise(F.col("text"))).alias("a"))
    pairs = docs.join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return pairs.select("doc_id", F.round(integrate.word_overlap(F.col("a"), F.col("b")), 6).alias("jaccard"), integrate.same_work(F.col("a"), F.col("b")).alias("same_work"))


QUERIES = {f.__name__: f for f in (search_keyword, cluster_doi, cluster_fuzzy, reconcile_fields, normalize_fields, work_keys, filter_works, venue_facets, similar_works, semantic_rank, retrieve_vector, retrieve_lexical, synthesis_context, jaccard_guard)}

_NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TITLE, _VENUE, _AUTHOR = (_NORM.format(f"coalesce({c}, '')") for c in ("title", "venue", "string_split_regex(trim(author), '\\s+')[-1]"))
_STOP = "['a','an','the','of','in','on','for','and','or','to','is','are','with','by','at','from','as','this','that','using']"
_TOKENS = f"list_filter(string_split({{}}, ' '), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"

CANONICAL_SQL = f"""
WITH {RAW_WORK_SQL},
clustered AS (SELECT *, CASE WHEN doi IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY doi) END AS cluster,
  coalesce(list_position(['crossref','openalex','europepmc','pubmed','doaj'], source_id), 6) AS prio FROM raw_work),
years AS (SELECT cluster, year, count(*) AS n, min(ord) AS f, arg_min(prio, ord) AS fp FROM clustered WHERE year IS NOT NULL GROUP BY ALL),
canonical AS (
  SELECT cluster,
    coalesce(arg_min(title, {{'a': prio, 'b': ord}}) FILTER (title <> '' AND title <> 'Untitled'), arg_max(title, {{'a': length(title), 'b': -ord}}) FILTER (title <> ''), 'Untitled') AS title,
    arg_max(abstract, {{'a': length(abstract), 'b': -ord}}) FILTER (abstract <> '') AS abstract,
    arg_min(doi, {{'a': (source_id <> 'crossref')::INT, 'b': ord}}) FILTER (doi IS NOT NULL) AS doi,
    arg_max(author, {{'a': orcids, 'b': -ord}}) AS author,
    arg_min(venue, {{'a': prio, 'b': ord}}) FILTER (venue <> '') AS venue,
    max(citation_count) AS citation_count, coalesce(bool_or(is_oa), false) AS is_oa,
    arg_min(pdf_url, {{'a': CASE WHEN source_id = 'unpaywall' THEN 0 WHEN coalesce(is_oa, false) THEN 1 ELSE 2 END, 'b': ord}}) FILTER (pdf_url <> '') AS pdf_url,
    count(*) AS n_sources, string_agg(source_id, ',' ORDER BY ord) AS source_ids, list(source_id) AS sources,
    (SELECT arg_max(y.year, {{'n': y.n, 'p': -y.fp, 'f': -y.f}}) FROM years y WHERE y.cluster = c.cluster) AS year
  FROM clustered c GROUP BY cluster),
keyed AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || sha256('doi:' || doi) ELSE 'hash:' || sha256('hash:' || {_TITLE} || '|' || coalesce(year::VARCHAR, '') || '|' || {_AUTHOR} || '|' || {_VENUE}) END AS work_key FROM canonical)
"""
_BASE = "2.0::DOUBLE * log10(coalesce(citation_count, 0) + 1) + n_sources + 0.8::DOUBLE * coalesce(greatest(0, 1 - (2026 - year) / 25.0::DOUBLE), 0) + CASE WHEN is_oa THEN 0.3::DOUBLE ELSE 0 END"
RANKED_SQL = f"""{CANONICAL_SQL},
tokens AS (SELECT *, {_TOKENS.format(_TITLE)} AS tt, {_TOKENS.format(_AUTHOR)} AS ta, list_concat({_TOKENS.format(_NORM.format("coalesce(abstract, '')"))}, {_TOKENS.format(_VENUE)}) AS t_other FROM keyed),
ranked AS (
  SELECT *, list_sum(list_transform(['it','was','not','them'], lambda q: CASE WHEN list_contains(tt, q) OR list_contains(ta, q) THEN 2 WHEN list_contains(t_other, q) THEN 1 ELSE 0 END)) / 4.0::DOUBLE AS rel FROM tokens),
scored AS (SELECT *, round(6.0::DOUBLE * rel + {_BASE}, 6) AS score FROM ranked WHERE rel > 0)
"""
_COS = "round(list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[]), 6)"

ORACLE_SQL = {
    "search_keyword": RANKED_SQL + "SELECT cluster, score, round(rel, 6) AS relevance, year, citation_count, n_sources FROM scored WHERE year >= 1995 AND coalesce(citation_count, 0) >= 5 ORDER BY score DESC, cluster LIMIT 20",
    "cluster_doi": f"WITH {RAW_WORK_SQL} SELECT ord, CASE WHEN doi IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY doi) END AS cluster FROM raw_work",
    "reconcile_fields": CANONICAL_SQL + "SELECT cluster, title, md5(abstract) AS abstract_md5, doi, author, year, venue, citation_count, is_oa, pdf_url, n_sources, source_ids, work_key FROM keyed",
    "normalize_fields": f"WITH {RAW_WORK_SQL} SELECT ord, {_NORM.format('abstract')} AS title, lower(doi) AS doi, nullif({_AUTHOR}, '') AS surname FROM raw_work",
    "work_keys": f"WITH {RAW_WORK_SQL} SELECT ord, CASE WHEN doi IS NOT NULL THEN 'doi:' || sha256('doi:' || doi) ELSE 'hash:' || sha256('hash:' || {_TITLE} || '|' || coalesce(year::VARCHAR, '') || '|' || {_AUTHOR} || '|' || {_VENUE}) END AS work_key FROM raw_work",
    "filter_works": CANONICAL_SQL + "SELECT cluster, year, citation_count FROM keyed WHERE year BETWEEN 2000 AND 2020 AND is_oa AND coalesce(citation_count, 0) >= 50 AND list_has_any(sources, ['crossref','pubmed','arxiv'])",
    "venue_facets": CANONICAL_SQL + "SELECT venue AS name, count(*) AS n FROM keyed WHERE venue IS NOT NULL GROUP BY venue ORDER BY n DESC, min(cluster) LIMIT 15",
    "similar_works": f"SELECT vec_id, {_COS.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS similarity FROM embeddings WHERE vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 10",
    "semantic_rank": CANONICAL_SQL + f", near AS (SELECT vec_id, {_COS.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS similarity FROM embeddings) SELECT cluster, similarity, round(6.0::DOUBLE * similarity + {_BASE}, 6) AS score FROM keyed JOIN near ON vec_id = cluster WHERE similarity >= 0.2",
    "retrieve_vector": f"SELECT label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT label, vec_id, {_COS.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS score FROM embeddings)) WHERE rank <= 3",
    "retrieve_lexical": """
WITH t AS (SELECT source, doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains(['the','a','an','and','or','but','of','to','in','on','for','with','is','are','was','were','be','been','it','this','that','as','by','at','from','what','how','why','does','do','did','which','who'], t)) AS w FROM documents),
s AS (SELECT source, doc_id, round(list_sum(list_transform(['tion','ation','only','this','they','have','which','pour','avec','nicht'], lambda q: CASE WHEN list_contains(w, q) THEN 1 + ln(len(list_filter(w, lambda x: x = q))) ELSE 0 END)) / sqrt(len(w)), 6) AS score FROM t WHERE len(w) > 0)
SELECT source, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 8""",
    "synthesis_context": RANKED_SQL + ", top AS (SELECT *, row_number() OVER (ORDER BY score DESC, cluster) AS n FROM scored ORDER BY score DESC, cluster LIMIT 8) SELECT string_agg('[' || n || '] ' || title || ' (' || coalesce(year::VARCHAR, 'n.d.') || ')', chr(10) || chr(10) ORDER BY n) AS context FROM top",
    "jaccard_guard": f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 17 < 2 THEN ' .' WHEN doc_id % 17 <> 3 THEN text ELSE '' END AS text FROM documents),
w AS (SELECT doc_id, list_distinct(list_filter(string_split({_NORM.format('left(text, 1000)')}, ' '), lambda t: t <> '')) AS w FROM t),
p AS (SELECT a.doc_id, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS s, len(a.w) > 0 AND len(b.w) > 0 AS told FROM w a JOIN w b ON a.doc_id = b.doc_id + 1)
SELECT doc_id, CASE WHEN told THEN round(i / (s - i)::DOUBLE, 6) END AS jaccard, NOT told OR i / (s - i)::DOUBLE >= 0.3 AS same_work FROM p""",
}
