"""Queries on retrieval for many questions, cells and findings, vectors by cells, and read-through caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.operators import graph, ledger, library, postings, readthrough, vectors
from scholarframe.plans import versions
from scholarframe.plans.tables import settle, shared_dir, table
from scholarframe.queries.works import _BASE, CANONICAL_SQL, canonical


def line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of each document as a passage, five lines to a page."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.withColumn("page_start", F.floor(F.col("line") / 5) + 1)


def retrieve_many(spark, sf_dir):
    """For every benchmark item, each source's four best documents."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("content"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return postings.retrieve_many(postings.postings(docs, "source", "doc_id"), asked, "source", "doc_id", 4)


def _columns(spark: SparkSession) -> DataFrame:
    """Two columns of a matrix and the words they are asked by."""
    return spark.createDataFrame([(1, "only what they have been"), (2, "nicht oder pour avec")], "query_id int, text string")


def _excerpts(spark, sf_dir, queries, k):
    lines = line_passages(spark, sf_dir)
    found = postings.retrieve_many(postings.postings(lines, "doc_id", "line"), queries, "doc_id", "line", k)
    return postings.excerpts(found, lines, "doc_id", "line")


def cell_fill(spark, sf_dir):
    """Two columns' cells of every document: answers quote the second passage found, some of them wrongly or not at all."""
    excerpt = settle(_excerpts(spark, sf_dir, _columns(spark), postings.CELL_PASSAGES), "excerpts")
    last = F.element_at("passages", -1)["content"]
    quote = F.when(F.col("doc_id") % 5 == 0, F.concat(last, F.lit(" altered"))).when(F.col("doc_id") % 5 == 1, F.lit(" ")).otherwise(F.replace(last, F.lit(" "), F.lit("  ")))
    value = F.when(F.col("doc_id") % 7 == 0, F.lit("elsewhere")).otherwise(F.concat(F.lit(" "), F.substring(trimmed(last), 1, 4)))
    answers = excerpt.where("doc_id % 11 <> 3").select("query_id", "doc_id", F.when(F.col("doc_id") % 13 != 5, F.col("doc_id") % 17 != 6).alias("found"), value.alias("value"), F.lit(" mg ").alias("unit"), quote.alias("quote"))
    cells = postings.fill_cells(excerpt, answers, "doc_id")
    return cells.select("query_id", "doc_id", "status", "value", "unit", F.md5(F.col("quote").cast("binary")).alias("quote_md5"), "page")


def trimmed(c):
    return F.regexp_replace(c, r"^[ \t\r]+|[ \t\r]+$", "")


def findings_queries(spark, sf_dir):
    """Findings of every document by three fixed questions and three of its own words each: answers name the first passage's first words."""
    asked = spark.createDataFrame([(k, f"{q} {w}") for k, (q, w) in enumerate(zip(postings.FINDING_QUERIES, ("only they have", "nicht oder aber", "pour avec dans"), strict=True))], "query_id int, text string")
    excerpt = settle(_excerpts(spark, sf_dir, asked, postings.FINDING_PASSAGES), "excerpts")
    words = F.split(F.get("passages", 0)["content"], " ")
    answers = excerpt.select("query_id", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place"), words.alias("w"))
    answers = answers.select("query_id", "doc_id", "place", F.concat(F.lit("f"), F.col("place") % 2).alias("field"), F.when(F.col("place") == 1, F.lit("absent")).otherwise(F.col("w")[0]).alias("value"), F.lit(None).cast("string").alias("unit"), F.get("w", 0).alias("quote"))
    found = postings.findings(excerpt, answers, "doc_id")
    return found.select("doc_id", "field", "value", "quote", "page")


def _vectors(spark, sf_dir):
    """Vectors of two models, by label."""
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("model"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


def similar_batch(spark, sf_dir):
    """The ten nearest vectors of its own model for every hundredth vector, exactly."""
    held = _vectors(spark, sf_dir)
    seeds = held.where("key % 100 = 0").select("model", F.col("key").alias("seed"))
    return vectors.nearest(vectors.build(held), seeds, 10).select("seed", "key", "similarity", "rank")


def similar_titles(spark, sf_dir):
    """The five nearest works of every hundredth vector, with their titles; half of the vectors are of no work."""
    held = _vectors(spark, sf_dir)
    seeds = held.where("key % 100 = 0").select("model", F.col("key").alias("seed"))
    works = table(spark, sf_dir, "documents").where("doc_id % 2 = 1").select(F.col("doc_id").alias("key"), F.get(F.split("text", "\n"), 0).alias("title"))
    found = vectors.nearest(vectors.build(held), seeds, 5, among=works)
    return found.join(works, "key").select("seed", "key", "similarity", "rank", "title")


#: What the stand-in for an embedding model counts in a text.
LETTERS = "aeinost "


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: how often each of some letters stands in a text, and one."""
    return [[1.0, *(float(t.count(c)) for c in LETTERS)] for t in texts]


def _embedding_cache(spark, sf_dir, key):
    """Cached vectors of some documents, all ones; of others those of another model only."""
    ones = F.array(*(F.lit(1.0) for _ in range(len(LETTERS) + 1)))
    return table(spark, sf_dir, "documents").where("doc_id % 3 < 2").select(key.alias("key"), F.when(F.col("doc_id") % 3 == 0, "letters").otherwise("other").alias("model"), ones.alias("value"))


def embedding_read_through(spark, sf_dir):
    """Embeddings of all documents by their text, from the cache or computed, and whether the cache has each afterwards, once."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    cache = _embedding_cache(spark, sf_dir, key)
    read = readthrough.read_through(table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), "text"), cache, "letters", letter_counts)
    kept = readthrough.keep_new(cache.distinct(), read.added.union(read.added)).where("model = 'letters'").groupBy("key").agg(F.count("*").alias("rows_kept"))
    return read.rows.join(kept, "key").select("doc_id", "cached", F.array_join("value", ",").alias("vector"), "rows_kept")


def rank_by_meaning(spark, sf_dir):
    """Works by the likeness of their embeddings to a query's, cached or computed."""
    works = canonical(spark, sf_dir)
    cache = works.where("cluster % 5 = 0").select(F.col("cluster").alias("key"), F.lit("letters").alias("model"), F.array(*(F.lit(float(k)) for k in range(9))).alias("value"))
    ranked, _ = readthrough.rank_by_meaning(works, "cluster", "a net to test it on", cache, "letters", letter_counts)
    return ranked.select("cluster", "similarity", "score")


def pair_reasons(spark, sf_dir):
    """A reason for every supplier and part that orders bring together, each pair computed once however many orders name it; some are cached."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('s', l_suppkey, '>p', l_partkey) AS key")
    cache = lines.where("l_orderkey % 2 = 0").select("key", F.lit("m").alias("model"), F.concat(F.lit("kept "), "key").alias("value"))
    read = readthrough.read_through(lines.withColumn("text", F.col("key")), cache, "m", lambda texts: [f"because {t.upper()}" for t in texts])
    return read.rows.select("l_orderkey", "l_linenumber", F.col("value").alias("reason"))


def grants_in_batches(spark, sf_dir):
    """What each supplier's lines earn as publications and reviews, granted in two batches, the second on top of the first."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS user_id", "if(l_returnflag = 'R', 'peer_review', 'publication') AS kind", "concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id", "l_orderkey * 10L + l_linenumber AS ord").distinct()
    lines = settle(lines, "lines")  # both batches and the middle read it
    middle = lines.agg(F.floor(F.max("ord") / 2).alias("middle"))
    dealt = lines.join(F.broadcast(middle))
    none = spark.createDataFrame([], "user_id long, key string")
    first = settle(ledger.contribution_grants(dealt.where("ord <= middle"), none, 5, 40, 10), "grants")
    second = ledger.contribution_grants(dealt.where("ord > middle"), first.select("user_id", "key"), 5, 40, 10)
    return first.union(second)


def works_upserted(spark, sf_dir):
    """Stored works after a second look at them: some with a DOI's key, some with other abstracts, some new."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "doi:").otherwise("hash:"), F.col("doc_id")).alias("work_key"), F.col("text").alias("abstract"))
    old = docs.where("doc_id % 5 < 4").select("work_key", "abstract", F.lit("old").alias("seen"))
    changed = F.when(F.col("doc_id") % 3 == 0, F.lit("quite another abstract of other words")).otherwise(F.col("abstract"))
    new = docs.where("doc_id % 7 < 5").select("work_key", changed.alias("abstract"), F.lit("new").alias("seen"), F.lit(1).alias("ord"))
    works, refused = library.upsert_works(old, new.union(new.withColumn("seen", F.lit("older")).withColumn("ord", F.lit(0))), "ord")
    said = works.join(refused.select("work_key", F.lit(True).alias("refused")), "work_key", "left")
    return said.select("work_key", "seen", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), F.coalesce("refused", F.lit(False)).alias("refused"))


def graph_seeds(spark, sf_dir):
    """Works that start graphs: single works, orders as collections, customers' libraries and each source's documents as searches."""
    works = table(spark, sf_dir, "part").where("p_size <> 7").select(F.concat(F.lit("w"), F.col("p_partkey")).alias("work_key"), F.col("p_name").alias("title"))
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_suppkey", "concat('w', l_partkey) AS work_key", "l_orderkey * 10L + l_linenumber AS ord")
    single = table(spark, sf_dir, "part").selectExpr("'work' AS entry", "p_partkey AS owner", "concat('w', p_partkey) AS work_key", "0L AS ord")
    collection, kept = lines.selectExpr("'collection'", "l_orderkey", "work_key", "ord"), lines.selectExpr("'library'", "l_suppkey", "work_key", "-ord")
    search = lines.selectExpr("'search'", "l_suppkey % 3", "work_key", "ord % 1000")
    return graph.seeds(single.union(collection).union(kept).union(search), works, {"work": 1, "collection": None, "search": graph.SEEDS, "library": graph.SEEDS})


def documents_saved(spark, sf_dir):
    """Documents and their passages after a second save of some with other lines, both tables read from the newest version."""
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    docs, lines = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("save")), line_passages(spark, sf_dir).select("doc_id", "line", "content")
    versions.write(spark, folder, {"parents": docs, "children": lines})
    now = versions.read(spark, folder)
    again = docs.where("doc_id % 3 = 0").withColumn("save", F.lit(2))
    versions.write(spark, folder, versions.replace_children(now["parents"], now["children"], again, lines.where("line % 2 = 0"), "doc_id"))
    now = versions.read(spark, folder)
    held = now["children"].groupBy("doc_id").agg(F.count("*").alias("passages"), F.sum(F.char_length("content")).alias("chars"))
    return now["parents"].join(held, "doc_id", "left").select("doc_id", "save", F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("chars", F.lit(0)).alias("chars"))


QUERIES = {f.__name__: f for f in (documents_saved, grants_in_batches, works_upserted, graph_seeds, retrieve_many, cell_fill, findings_queries, similar_batch, similar_titles, embedding_read_through, rank_by_meaning, pair_reasons)}

_STOP = "['the','a','an','and','or','but','of','to','in','on','for','with','is','are','was','were','be','been','it','this','that','as','by','at','from','what','how','why','does','do','did','which','who']"
_TERMS = f"list_filter(string_split_regex(lower({{}}), '[^a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t))"


def _ranked(passages: str, queries: str, group: str, order: str, k: int) -> str:
    return f"""passage AS ({passages}),
terms AS (SELECT {group}, {order}, {_TERMS.format("content")} AS w FROM passage),
post AS (SELECT {group}, {order}, term, count(*) AS tf, any_value(n) AS n FROM (SELECT {group}, {order}, unnest(w) AS term, len(w) AS n FROM terms) GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, unnest({_TERMS.format("text")}) AS term FROM ({queries})),
scored AS (SELECT query_id, {group}, {order}, round(sum(1 + ln(tf)) / sqrt(any_value(n)), 6) AS score FROM post JOIN asked USING (term) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, {group} ORDER BY score DESC, {order}) AS rank FROM scored QUALIFY rank <= {k})"""


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents"
_SQUEEZE = r"lower(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')))"


def _appears(source: str, quote: str) -> str:
    return f"({_SQUEEZE.format(quote)} <> '' AND contains({_SQUEEZE.format(source)}, {_SQUEEZE.format(quote)}))"


_NEAR = """SELECT s.vec_id AS seed, v.vec_id AS key, round(list_cosine_similarity(v.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings s JOIN embeddings v ON s.label % 2 = v.label % 2 AND s.vec_id <> v.vec_id WHERE s.vec_id % 100 = 0"""

_COUNTS = "[1.0::DOUBLE, " + ", ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', '')))::DOUBLE" for c in "aeinost ") + "]"

ORACLE_SQL = {
    "documents_saved": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
h AS (SELECT doc_id, count(*) AS passages, sum(length(content))::BIGINT AS chars FROM l WHERE doc_id % 3 <> 0 OR line % 2 = 0 GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::INT AS save, coalesce(passages, 0) AS passages, coalesce(chars, 0) AS chars FROM documents LEFT JOIN h USING (doc_id)""",
    "grants_in_batches": """
WITH l AS (SELECT DISTINCT l_suppkey AS user_id, CASE WHEN l_returnflag = 'R' THEN 'peer_review' ELSE 'publication' END AS kind, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ord, id) - 5 AS i FROM l)
SELECT user_id, CASE kind WHEN 'publication' THEN 'work:' ELSE 'review:' END || id AS key, kind, CASE WHEN kind = 'peer_review' THEN 10 WHEN i <= 0 THEN 40 ELSE greatest(1, floor(40 / power(2, least(i, 6)) + 0.5)) END::BIGINT AS credit FROM p""",
    "works_upserted": r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'doi:' ELSE 'hash:' END || doc_id AS work_key, text FROM documents),
w AS (SELECT *, doc_id % 5 < 4 AS had, doc_id % 7 < 5 AS asked, doc_id % 3 = 0 AS changed, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(left(text, 1000))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: t <> '')) AS t FROM d),
j AS (SELECT *, len(list_intersect(t, ['quite', 'another', 'abstract', 'of', 'other', 'words'])) AS c FROM w),
r AS (SELECT *, had AND asked AND doc_id % 2 = 1 AND changed AND len(t) > 0 AND c / (len(t) + 6 - c)::DOUBLE < 0.3 AS refused FROM j WHERE had OR asked)
SELECT work_key, CASE WHEN asked AND NOT refused THEN 'new' ELSE 'old' END AS seen, md5(CASE WHEN asked AND NOT refused AND changed THEN 'quite another abstract of other words' ELSE text END) AS abstract_md5, refused FROM r""",
    "graph_seeds": """
WITH l AS (SELECT l_orderkey, l_suppkey, 'w' || l_partkey AS work_key, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
e AS (SELECT 'work' AS entry, p_partkey AS owner, 'w' || p_partkey AS work_key, 0 AS ord FROM part UNION ALL SELECT 'collection', l_orderkey, work_key, ord FROM l
  UNION ALL SELECT 'library', l_suppkey, work_key, -ord FROM l UNION ALL SELECT 'search', l_suppkey % 3, work_key, ord % 1000 FROM l),
f AS (SELECT entry, owner, work_key, min(ord) AS ord FROM e GROUP BY ALL),
p AS (SELECT f.*, p_name AS title, (row_number() OVER (PARTITION BY entry, owner ORDER BY ord, work_key) - 1)::INT AS position FROM f JOIN part ON work_key = 'w' || p_partkey AND p_size <> 7)
SELECT entry, owner, position, work_key, title FROM p WHERE entry = 'collection' OR position < CASE entry WHEN 'work' THEN 1 ELSE 20 END""",
    "embedding_read_through": f"""
WITH k AS (SELECT doc_id, sha256(coalesce(text, '')) AS key, coalesce(text, '') AS text FROM documents),
c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
SELECT doc_id, c.key IS NOT NULL AS cached, array_to_string(CASE WHEN c.key IS NOT NULL THEN list_transform(range(9), lambda i: 1.0::DOUBLE) ELSE {_COUNTS.format("text")} END, ',') AS vector, 1::BIGINT AS rows_kept FROM k LEFT JOIN c USING (key)""",
    "rank_by_meaning": CANONICAL_SQL + f""", texts AS (SELECT *, title || coalesce(chr(10) || abstract, '') AS said FROM keyed),
near AS (SELECT cluster, round(list_cosine_similarity(CASE WHEN cluster % 5 = 0 THEN [0.0::DOUBLE, 1, 2, 3, 4, 5, 6, 7, 8] ELSE {_COUNTS.format("said")} END, {_COUNTS.format("'a net to test it on'")}), 6) AS similarity FROM texts)
SELECT cluster, similarity, round(6.0::DOUBLE * similarity + {_BASE}, 6) AS score FROM keyed JOIN near USING (cluster) WHERE similarity >= 0.2""",
    "pair_reasons": """
WITH l AS (SELECT l_orderkey, l_linenumber, 's' || l_suppkey || '>p' || l_partkey AS key FROM lineitem), c AS (SELECT DISTINCT key FROM l WHERE l_orderkey % 2 = 0)
SELECT l_orderkey, l_linenumber, CASE WHEN c.key IS NOT NULL THEN 'kept ' || key ELSE 'because ' || upper(key) END AS reason FROM l LEFT JOIN c USING (key)""",
    "similar_batch": f"SELECT *, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, key) AS rank FROM ({_NEAR}) QUALIFY rank <= 10",
    "similar_titles": f"SELECT *, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, key) AS rank FROM (SELECT n.*, string_split(text, chr(10))[1] AS title FROM ({_NEAR}) n JOIN documents ON doc_id = key AND doc_id % 2 = 1) QUALIFY rank <= 5",
    "retrieve_many": "WITH " + _ranked("SELECT source, doc_id, text AS content FROM documents", "SELECT item_id AS query_id, text FROM benchmark", "source", "doc_id", 4) + " SELECT query_id, source, doc_id, score, rank FROM best",
    "cell_fill": "WITH " + _ranked(_LINES, "SELECT * FROM (VALUES (1, 'only what they have been'), (2, 'nicht oder pour avec')) t(query_id, text)", "doc_id", "line", 4) + rf""",
told AS (
  SELECT query_id, doc_id, list({{'page': line // 5 + 1, 'content': content}} ORDER BY rank) AS p,
    string_agg('[page ' || (line // 5 + 1) || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS source
  FROM best JOIN passage USING (doc_id, line) GROUP BY ALL),
said AS (
  SELECT *, p[-1].content AS l, trim(CASE WHEN doc_id % 5 = 0 THEN l || ' altered' WHEN doc_id % 5 = 1 THEN ' ' ELSE replace(l, ' ', '  ') END, ' ' || chr(9) || chr(13)) AS quote,
    CASE WHEN doc_id % 7 = 0 THEN 'elsewhere' ELSE trim(substr(trim(l, ' ' || chr(9) || chr(13)), 1, 4)) END AS value FROM told),
judged AS (
  SELECT *, CASE WHEN doc_id % 11 = 3 OR doc_id % 13 = 5 THEN 'error' WHEN doc_id % 17 <> 6 AND {_appears("source", "quote")} AND {_appears("quote", "value")} THEN 'found' ELSE 'not_reported' END AS status,
    coalesce(list_filter(p, lambda x: {_appears("x.content", "quote")})[1].page, p[1].page) AS on_page FROM said)
SELECT query_id, doc_id, status, CASE WHEN status = 'found' THEN value END AS value, CASE WHEN status = 'found' THEN 'mg' END AS unit, CASE WHEN status = 'found' THEN md5(quote) END AS quote_md5, CASE WHEN status = 'found' THEN on_page END AS page FROM judged""",
    "findings_queries": "WITH " + _ranked(_LINES, "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{q} {w}')" for k, (q, w) in enumerate(zip(postings.FINDING_QUERIES, ("only they have", "nicht oder aber", "pour avec dans"), strict=True))) + ") t(query_id, text)", "doc_id", "line", 3) + f""",
told AS (
  SELECT query_id, doc_id, list({{'page': line // 5 + 1, 'content': content}} ORDER BY rank) AS p, string_split(arg_min(content, rank), ' ')[1] AS w FROM best JOIN passage USING (doc_id, line) GROUP BY ALL),
one AS (SELECT doc_id, query_id, w, coalesce(list_filter(p, lambda x: {_appears("x.content", "w")})[1].page, p[1].page) AS page FROM told WHERE {_SQUEEZE.format("w")} <> '')
SELECT doc_id, 'f0' AS field, w AS value, w AS quote, arg_min(page, query_id) AS page FROM one GROUP BY doc_id, w""",
}
