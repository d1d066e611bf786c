"""Queries on written state: graphs from references, caches, library, matrices, manuscripts, decks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.functions import text as T
from scholarframe.operators import cite, evidence, graph, library, rank
from scholarframe.plans.tables import settle, shared_dir, table
from scholarframe.sources import records

NOW = "TIMESTAMP '2024-03-01 00:00:00'"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as references of their order: some by DOI, some by title and year, some by neither."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.selectExpr("l_orderkey * 10L + l_linenumber AS ord", "concat('root', l_orderkey % 50) AS root", "if(l_linenumber % 2 = 0, 'cited', 'citing') AS kind", "case when l_partkey % 3 <> 0 then concat(' DOI:10.1/P', l_partkey) end AS doi", "case when l_partkey % 5 <> 0 then concat('Part ', l_partkey, ' ') end AS title", "case when l_partkey % 4 <> 0 then cast(1990 + l_partkey % 30 AS int) end AS year")


def graph_from_refs(spark, sf_dir):
    """Every node that references make, with how many edges they give and take."""
    refs = _refs(spark, sf_dir)
    citing = F.col("kind") == "citing"
    # Equal references are counted by hash first, so that keys are made once for each and few rows are sorted.
    each = settle(refs.groupBy("doi", "title", "year").agg(F.min("ord").alias("ord"), F.count_if(citing).alias("gives"), F.count_if(~citing).alias("takes")), "references")
    nodes, _ = graph.refs_to_graph(each.select("ord", "doi", "title", "year", F.lit(None).cast("string").alias("root"), F.lit("citing").alias("kind")))
    roots = refs.groupBy(F.col("root").alias("id")).agg(F.count_if(~citing).alias("gives"), F.count_if(citing).alias("takes"))
    ends = each.select(graph.reference_key(F.col("doi"), F.col("title"), F.col("year")).alias("id"), "gives", "takes").union(roots)
    counted = ends.groupBy("id").agg(F.sum("gives").alias("gives"), F.sum("takes").alias("takes"))
    told = nodes.groupBy("id").agg(F.min_by(F.struct("label", "doi", "year", "resolved"), "ord").alias("n"))
    return told.select("id", "n.*").join(counted, "id")


def graph_merge(spark, sf_dir):
    """Roots, then references until the graph is full: its nodes, and the edges that found both ends."""
    nodes, edges = graph.refs_to_graph(_refs(spark, sf_dir))
    roots = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey AS bigint) AS ord", "concat('root', r_regionkey) AS id", "r_name AS label", "cast(null AS string) AS doi", "cast(null AS int) AS year", "true AS is_root", "true AS resolved", "false AS expandable", "true AS expanded")
    grown, linked = graph.merge_graph(roots, edges.limit(0), nodes, edges)
    grown = graph.mark_expanded(grown, "doi:10.1/p1")
    full = graph.at_capacity(grown)
    degree = linked.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_links"))
    return grown.join(degree, "id", "left").join(F.broadcast(full)).select("id", "label", "is_root", "expanded", F.coalesce("in_links", F.lit(0)).alias("in_links"), "full")


def source_windows(spark, sf_dir):
    """Pages and years asked of sources, each in its own words; one takes no years."""
    asked = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case when l_linenumber <> 3 then l_linenumber end AS page", "case when l_suppkey % 7 <> 0 then l_suppkey % 130 + 1 end AS per_page", "case when l_partkey % 2 = 0 then 1990 + l_partkey % 20 end AS y1", "case when l_partkey % 3 = 0 then 2000 + l_partkey % 20 end AS y2")
    out = asked
    for source in ("openalex", "crossref", "doaj", "core", "semanticscholar", "europepmc", "arxiv"):
        out = out.withColumn(f"{source}_window", records.page_window(source, F.col("page"), F.col("per_page")))
        out = out.withColumn(f"{source}_years", records.year_filter(source, F.col("y1"), F.col("y2"), 2026))
    windows = [F.col(f"{s}_window.{c}").alias(f"{s}_{c}") for s in ("openalex", "core", "semanticscholar") for c in ("limit", "offset")]
    return out.select("l_orderkey", "l_linenumber", *windows, *(f"{s}_years" for s in ("openalex", "crossref", "doaj", "semanticscholar", "europepmc", "arxiv")))


def _written(rows: DataFrame, name: str, entry, group: str, field: str | None) -> str:
    """Rows as JSON payloads, one for each group: an array, or an object whose `field` is one; a line each, so that files don't grow with the groups."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}.jsonl"
    paged = rows.groupBy(group).agg(F.collect_list(entry).alias("all"))
    body = F.to_json("all") if field is None else F.to_json(F.struct(F.col("all").alias(field)))
    paged.select(body.alias("value")).write.text(path)
    return path


def citation_lists(spark, sf_dir):
    """Works that cite suppliers, by two sources' lists written and read back; the second has titles and entries without a paper."""
    lines = table(spark, sf_dir, "orders").selectExpr("floor(o_orderkey / 100) AS page", "o_orderkey", "concat('10.1/', o_orderkey) AS doi", "concat('Order ', o_orderkey) AS title", "year(o_orderdate) AS year")
    coci = _written(lines, "coci", F.struct(F.col("doi").alias("citing"), F.lit("10.1/s").alias("cited")), "page", None)
    paper = F.when(F.col("o_orderkey") % 3 != 0, F.struct("title", "year", F.struct(F.col("doi").alias("DOI")).alias("externalIds")))
    edges = _written(lines, "edges", F.struct(paper.alias("citingPaper")), "page", "data")
    first = records.opencitations(spark, coci, "citing").withColumn("ord", F.lit(1))
    second = records.semanticscholar_edges(spark, edges, "citing").withColumn("ord", F.lit(0))
    return graph.merge_refs(first.union(second)).select("doi", "title", "year")


def contribution_lists(spark, sf_dir):
    """Publications and peer reviews, written as their sources nest them and read back."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("floor(l_orderkey / 100) AS page", "l_orderkey", "l_suppkey", "l_linenumber", "year(l_shipdate) AS year")
    work = F.struct(F.when(F.col("l_linenumber") != 2, F.concat(F.lit("https://openalex.org/W"), F.col("l_orderkey"), F.lit("x"), F.col("l_linenumber"))).alias("id"), F.when(F.col("l_linenumber") != 4, F.concat(F.lit("Line "), F.col("l_orderkey"))).alias("display_name"), F.col("year").alias("publication_year"))
    works = _written(lines.where("l_suppkey % 2 = 0"), "works", work, "page", "results")
    summary = F.struct(F.when(F.col("l_linenumber") != 5, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("put-code"), F.struct(F.struct(F.col("year").cast("string").alias("value")).alias("year")).alias("completion-date"))
    inner = lines.where("l_suppkey % 2 = 1").groupBy("page", "l_orderkey").agg(F.collect_list(summary).alias("s"))
    groups = inner.withColumn("g", F.array(F.struct(F.col("s").alias("peer-review-summary"))))
    reviews = _written(groups, "reviews", F.struct(F.col("g").alias("peer-review-group")), "page", "group")
    return records.publications(spark, works).unionByName(records.peer_reviews(spark, reviews))


def cache_put(spark, sf_dir):
    """A cache of searches after the newer half of the events was put in, and whether each row is fresh."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 700 AS query_hash", "event_type AS payload", f"{NOW} AS now")
    old = evidence.latest(events.where("event_id % 3 = 0").selectExpr("query_hash", "payload", "event_id AS asked"), ["query_hash"], ["asked"]).drop("asked")
    old = old.withColumn("expires_at", F.expr(f"{NOW} - make_dt_interval(0, cast(query_hash % 3 AS int))"))
    new = events.where("event_id % 3 = 1 and query_hash % 5 <> 0").selectExpr("query_hash", "payload", "event_id AS asked")
    after = library.put_cached(old, new, ["query_hash"], F.expr(NOW), F.expr("make_dt_interval(0, 1)"))
    live = library.fresh(after, F.expr(NOW)).select("query_hash", F.lit(True).alias("fresh"))
    return after.join(live, "query_hash", "left").select("query_hash", "payload", F.date_format("expires_at", "yyyy-MM-dd HH").alias("expires"), F.coalesce("fresh", F.lit(False)).alias("fresh"))


def unsave(spark, sf_dir):
    """Saved orders that customers ask to unsave, some of them others', and whether each went."""
    saved = table(spark, sf_dir, "orders").selectExpr("o_custkey AS user_id", "o_orderkey AS item_id")
    asked = table(spark, sf_dir, "orders").selectExpr("o_custkey + if(o_orderkey % 3 = 0, 1, 0) AS user_id", "o_orderkey AS item_id").where("item_id % 4 <> 1")
    left, told = library.delete_owned(saved, asked, ["item_id"])
    return told.select("item_id", "deleted").join(left.select("item_id", F.lit(True).alias("kept")), "item_id", "left").select("item_id", "deleted", F.coalesce("kept", F.lit(False)).alias("kept"))


def create_collection(spark, sf_dir):
    """Collections asked for by name, of which each user gets a name once."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderstatus = 'P'").selectExpr("o_custkey AS user_id", "o_orderpriority AS name")
    asked = orders.where("o_orderstatus <> 'P'").selectExpr("o_custkey AS user_id", "o_orderpriority AS name", "o_orderkey AS asked")
    return library.create_collections(old, asked)


def matrix_fill(spark, sf_dir):
    """Pairs that a forced fill of one column takes, of every matrix, and those of an ordinary one."""
    from scholarframe.queries.evidence import _matrix

    rows, columns, cells = _matrix(spark, sf_dir)
    forced = library.fill_pairs(rows, columns, cells, force=True, column_id=2).withColumn("forced", F.lit(1))
    usual = library.fill_pairs(rows, columns, cells, column_id=2).withColumn("forced", F.lit(0))
    return forced.union(usual.select(*forced.columns)).groupBy("matrix_id", "column_id").agg(F.sum("forced").alias("forced"), F.count_if(F.col("forced") == 0).alias("missing"))


def matrix_edit(spark, sf_dir):
    """Tallies of matrices after failed cells were filled anew and one column was removed."""
    from scholarframe.queries.evidence import _matrix

    _, columns, cells = _matrix(spark, sf_dir)
    new = cells.where("status = 'error'").select("matrix_id", "row_id", "column_id", F.lit(None).cast("double").alias("value"), F.when(F.col("row_id") % 2 == 0, "found").otherwise("not_reported").alias("status"), "page", F.lit(1).alias("asked"))
    saved = library.save_cells(cells, new)
    _, left = library.remove_from_matrix(columns, saved, columns.where("column_id = 4"), "column_id")
    return library.fill_tallies(left)


def extraction_marks(spark, sf_dir):
    """The last status of each document's extractions."""
    marks = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS document_id", "if(l_linenumber % 2 = 0, 'tables', 'findings') AS kind", "case l_returnflag when 'R' then 'failed' when 'A' then 'pending' else 'ready' end AS status", "case when l_returnflag = 'R' then l_linestatus end AS error", "l_orderkey * 10L + l_linenumber AS asked")
    return library.extraction_status(marks.groupBy("document_id", "kind", "asked").agg(F.max_by("status", F.struct("status", "error")).alias("status"), F.max_by("error", F.struct("status", "error")).alias("error")))


def manuscript_save(spark, sf_dir):
    """Manuscripts after their owners' last patches, of which some leave the title and some are by others."""
    own = table(spark, sf_dir, "customer").selectExpr("c_custkey AS public_id", "c_nationkey AS user_id", "c_name AS title", "c_mktsegment AS doc")
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey AS public_id", "o_orderkey AS asked", "case when o_orderkey % 2 = 0 then concat('t', o_orderkey) end AS title", "o_orderstatus AS doc")
    patches = orders.join(own.select("public_id", "user_id"), "public_id").withColumn("user_id", F.when(F.col("asked") % 5 == 0, -1).otherwise(F.col("user_id")))
    return library.save_manuscripts(own, patches).select("public_id", "title", "doc", "saved_at")


def revision_snapshots(spark, sf_dir):
    """Saves of manuscripts that leave a revision, twenty at most."""
    saves = table(spark, sf_dir, "events").selectExpr("user_id % 7 AS manuscript_id", "event_id AS save_id", "unix_timestamp(cast(ts AS timestamp)) AS at")
    return library.revisions(saves, seconds=3600, keep=20).select("manuscript_id", "save_id")


def usage_monthly(spark, sf_dir):
    """Capacity sources after the events of their providers."""
    sources = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "case s_suppkey % 5 when 0 then 'disabled' when 1 then 'exhausted' else 'active' end AS status", "case when s_suppkey % 3 <> 0 then s_suppkey % 90 * 10 end AS monthly_token_cap", "s_suppkey % 50 * 10 AS tokens_used_period", f"if(s_suppkey % 2 = 0, {NOW}, {NOW} - make_dt_interval(3)) AS period_starts_at", f"if(s_suppkey % 4 = 0, {NOW}, null) AS dormant_until")
    usage = table(spark, sf_dir, "events").selectExpr("user_id % 80 AS id", "cast(value AS bigint) - 5 AS tokens")
    after = library.record_usage(sources, usage, F.expr(NOW))
    return after.select("id", "status", F.col("tokens_used_period").cast("long").alias("used"), F.date_format("period_starts_at", "yyyy-MM-dd").alias("since"), F.col("dormant_until").isNotNull().alias("dormant"))


def sources_down(spark, sf_dir):
    """Users none of whose events went well."""
    return library.all_down(table(spark, sf_dir, "events").selectExpr("event_id % 4000 AS search", "if(event_type = 'error', 'error', 'ok') AS status"), "search")


def preflight_anonymous(spark, sf_dir):
    """Whether customers, some without an account, may run a feature of eight credits."""
    c = table(spark, sf_dir, "customer")
    allowed = library.may_run(F.lit(8), F.expr("case when c_custkey % 3 <> 0 then cast(floor(c_acctbal / 100) AS bigint) end"), F.lit(20), F.expr("c_custkey % 25"), F.expr(f"if(c_custkey % 2 = 0, {NOW}, {NOW} - make_dt_interval(5))"), F.expr(NOW))
    return c.select("c_custkey", allowed.alias("allowed"))


def deck_references(spark, sf_dir):
    """Numbered references of each order's deck, after its tags were replaced by keys; some tags are unknown."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS deck", "l_linenumber AS slide", "l_suppkey AS bullet", "concat('See [[ t1 ]] and [[t2]], not [[t3]].') AS text", "map('t1', concat('w', l_partkey), 't2', concat('w', l_suppkey * 3)) AS tags")
    works = table(spark, sf_dir, "part").where("p_size <> 7").selectExpr("concat('w', p_partkey) AS work_key", "p_name AS title")
    return cite.deck_references(lines.withColumn("text", T.remap_markers(F.col("text"), F.col("tags"))), works)


def marker_segments(spark, sf_dir):
    """Turns with markers, cut into texts and citations and told apart again."""
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, "[[k1]]").otherwise(""), F.col("text"), F.lit(" [[ k2 ]][[k3]] end")).alias("t"))
    cut = made.select("conv_id", "turn", T.marker_segments(F.col("t")).alias("s"))
    of = lambda kind: F.array_join(F.transform(F.filter("s", lambda x: x["kind"] == kind), lambda x: x["value"]), "|")
    return cut.select("conv_id", "turn", F.size("s").alias("segments"), of("citation").alias("keys"), F.md5(of("text").cast("binary")).alias("text_md5"))


def odd_markers(spark, sf_dir):
    """Turns with brackets that make no marker, and keys of characters that patterns would read: segments, and what a draft may keep."""
    pieces = ("[[a.c]] x ]] y", "z [[k(1]] and [[ a.c ]]", " [[abc]] [[ ]] [[", "]][[k|+]]]] end [[]].")
    text = F.concat(F.col("text"), F.element_at(F.array(*map(F.lit, pieces)), (F.col("turn") % 4 + 1).cast("int")))
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t")).withColumn("s", T.marker_segments(F.col("t")))
    told = F.array_join(F.transform("s", lambda x: F.concat(F.substring(x["kind"], 1, 1), x["value"])), "|")
    kept = T.keep_markers(F.col("t"), F.array(*map(F.lit, ("a.c", "k(1", "k|+"))))
    return made.select("conv_id", "turn", F.size("s").alias("segments"), F.md5(told.cast("binary")).alias("segments_md5"), F.md5(kept.cast("binary")).alias("kept_md5"))


def document_context(spark, sf_dir):
    """The three best passages of each source, under headings that name their pages."""
    docs = table(spark, sf_dir, "documents").selectExpr("source", "doc_id", "text AS content", "cast(doc_id % 9 AS int) AS page_start", "cast(doc_id % 9 + doc_id % 2 AS int) AS page_end")
    best = rank.top_passages(docs, ["tion", "only", "which", "pour", "nicht"], "source", "doc_id", k=3)
    return rank.document_context(best, "source").select("source", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def retrieve_fallback(spark, sf_dir):
    """Best passages by vector where a source has vectors, by terms where it has none."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS doc_id", "embedding")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("content")).join(vectors, "doc_id", "left")
    docs = docs.withColumn("embedding", F.when(F.col("source") < "m", F.col("embedding")))
    asked = [1.0 if k % 2 else -0.5 for k in range(64)]
    return rank.retrieve(docs, "tion only which pour nicht", asked, "source", "doc_id", k=4).select("source", "doc_id", "score", "rank")


def findings_once(spark, sf_dir):
    """Findings of parts with their quotes: those that hold, each field and value once."""
    made = table(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_orderkey * 10L + l_linenumber AS ord", "l_returnflag AS field", "cast(cast(l_quantity AS int) AS string) AS value", "concat('Got  ', cast(l_quantity AS int), ' PIECES') AS quote", "concat('we got ', cast(l_quantity AS int), if(l_linenumber = 2, ' boxes', ' pieces'), ' sent') AS source")
    return evidence.findings_once(made, "l_partkey", "ord").groupBy("l_partkey").agg(F.count("*").alias("findings"), F.min("ord").alias("first"))


QUERIES = {f.__name__: f for f in (graph_from_refs, graph_merge, source_windows, citation_lists, contribution_lists, cache_put, unsave, create_collection, matrix_fill, matrix_edit, extraction_marks, manuscript_save, revision_snapshots, usage_monthly, sources_down, preflight_anonymous, deck_references, marker_segments, odd_markers, document_context, retrieve_fallback, findings_once)}

from scholarframe.queries.evidence import _MATRIX  # noqa: E402
from scholarframe.queries.works import ORACLE_SQL as _WORKS  # noqa: E402

_NOW = "TIMESTAMP '2024-03-01 00:00:00'"
_REFS = """refs AS (
  SELECT l_orderkey * 10 + l_linenumber AS ord, 'root' || (l_orderkey % 50) AS root, l_linenumber % 2 = 1 AS citing,
    CASE WHEN l_partkey % 3 <> 0 THEN '10.1/p' || l_partkey END AS doi, CASE WHEN l_partkey % 5 <> 0 THEN 'Part ' || l_partkey || ' ' END AS title,
    CASE WHEN l_partkey % 4 <> 0 THEN (1990 + l_partkey % 30)::INT END AS year FROM lineitem),
n AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi ELSE 'unresolved:' || substr(sha256(lower(trim(coalesce(title, ''))) || '|' || coalesce(year::VARCHAR, '')), 1, 24) END AS id FROM refs),
e AS (SELECT ord, CASE WHEN citing THEN id ELSE root END AS source, CASE WHEN citing THEN root ELSE id END AS target FROM n)"""
_LEXICAL = _WORKS["retrieve_lexical"].split("SELECT source, doc_id, score, rank")[0]


def _lexical(words: str) -> str:
    """The ranked passages of the lexical oracle, asked for other words."""
    return _LEXICAL.replace("['tion','ation','only','this','they','have','which','pour','avec','nicht']", words)


ORACLE_SQL = {
    "graph_from_refs": f"WITH {_REFS}, ends AS (SELECT source AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) SELECT id, f.label, f.doi, f.year, f.doi IS NOT NULL AS resolved, gives, takes FROM (SELECT id, arg_min({{'label': coalesce(title, doi, 'Untitled'), 'doi': doi, 'year': year}}, ord) AS f FROM n GROUP BY id) JOIN (SELECT id, sum(o)::BIGINT AS gives, sum(i)::BIGINT AS takes FROM ends GROUP BY id) USING (id)",
    "graph_merge": f"""WITH {_REFS}, firsts AS (SELECT id, min(ord) AS ord, arg_min(coalesce(title, doi, 'Untitled'), ord) AS label FROM n GROUP BY id),
nodes AS (SELECT 'root' || r_regionkey AS id, r_name AS label, true AS is_root FROM region
  UNION ALL (SELECT id, label, false FROM firsts WHERE id NOT IN (SELECT 'root' || r_regionkey FROM region) ORDER BY ord, id LIMIT 150 - (SELECT count(*) FROM region))),
links AS (SELECT DISTINCT source, target FROM e WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))
SELECT id, label, is_root, is_root OR id = 'doi:10.1/p1' AS expanded, (SELECT count(*) FROM links WHERE target = id) AS in_links, (SELECT count(*) FROM nodes) >= 150 AS full FROM nodes""",
    "source_windows": """WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_linenumber ELSE 1 END AS page, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey % 130 + 1 ELSE 20 END AS n,
  CASE WHEN l_partkey % 2 = 0 THEN 1990 + l_partkey % 20 END AS a, CASE WHEN l_partkey % 3 = 0 THEN 2000 + l_partkey % 20 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, least(n, 50) AS openalex_limit, (page - 1) * least(n, 50) AS openalex_offset, least(n, 100) AS core_limit, (page - 1) * least(n, 100) AS core_offset,
  CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'publication_year:' || coalesce(a, 1000) || '-' || coalesce(b, 2026) END AS openalex_years,
  CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN concat_ws(',', 'from-pub-date:' || a || '-01-01', 'until-pub-date:' || b || '-12-31') END AS crossref_years,
  CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'bibjson.year:[' || coalesce(a, 1000) || ' TO ' || coalesce(b, 2026) || ']' END AS doaj_years,
  least(n, 100) AS semanticscholar_limit, (page - 1) * least(n, 100) AS semanticscholar_offset,
  CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a::VARCHAR, '') || '-' || coalesce(b::VARCHAR, '') END AS semanticscholar_years,
  CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'PUB_YEAR:[' || coalesce(a, 1000) || ' TO ' || coalesce(b, 2026) || ']' END AS europepmc_years, NULL::VARCHAR AS arxiv_years FROM a""",
    "citation_lists": "SELECT '10.1/' || o_orderkey AS doi, CASE WHEN o_orderkey % 3 <> 0 THEN 'Order ' || o_orderkey END AS title, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate)::INT END AS year FROM orders",
    "contribution_lists": "SELECT 'W' || l_orderkey || 'x' || l_linenumber AS id, 'publication' AS kind, CASE WHEN l_linenumber <> 4 THEN 'Line ' || l_orderkey ELSE 'Untitled work' END AS title, year(l_shipdate)::INT AS year FROM lineitem WHERE l_suppkey % 2 = 0 AND l_linenumber <> 2 UNION ALL SELECT (l_orderkey * 10 + l_linenumber)::VARCHAR, 'peer_review', 'Peer review', year(l_shipdate)::INT FROM lineitem WHERE l_suppkey % 2 = 1 AND l_linenumber <> 5",
    "cache_put": f"""WITH ev AS (SELECT event_id, event_id % 700 AS k, event_type AS p FROM events),
o AS (SELECT k, arg_max(p, event_id) AS p, {_NOW} - INTERVAL 1 HOUR * (k % 3) AS x FROM ev WHERE event_id % 3 = 0 GROUP BY k),
n AS (SELECT k, arg_max(p, event_id) AS p, {_NOW} + INTERVAL 1 HOUR AS x FROM ev WHERE event_id % 3 = 1 AND k % 5 <> 0 GROUP BY k)
SELECT coalesce(n.k, o.k) AS query_hash, coalesce(n.p, o.p) AS payload, strftime(coalesce(n.x, o.x), '%Y-%m-%d %H') AS expires, coalesce(n.x, o.x) >= {_NOW} AS fresh FROM o FULL JOIN n ON o.k = n.k""",
    "unsave": "SELECT o_orderkey AS item_id, o_orderkey % 3 <> 0 AS deleted, o_orderkey % 3 = 0 AS kept FROM orders WHERE o_orderkey % 4 <> 1",
    "create_collection": "SELECT o_custkey AS user_id, o_orderpriority AS name, o_orderkey AS asked, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'P' AND p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority) AS created FROM orders o WHERE o_orderstatus <> 'P'",
    "matrix_fill": f"WITH {_MATRIX} SELECT matrix_id, 2::BIGINT AS column_id, count(*) AS forced, count(*) FILTER (NOT EXISTS (SELECT 1 FROM cells WHERE cells.row_id = r.row_id AND column_id = 2 AND status <> 'error')) AS missing FROM r GROUP BY matrix_id",
    "matrix_edit": f"WITH {_MATRIX}, f AS (SELECT matrix_id, CASE WHEN status = 'found' THEN 'found' WHEN row_id % 2 = 0 THEN 'found' ELSE 'not_reported' END AS s FROM cells WHERE column_id <> 4) SELECT matrix_id, count(*) AS ran, count(*) FILTER (s = 'found') AS filled, count(*) FILTER (s = 'not_reported') AS not_reported, 0::BIGINT AS errors FROM f GROUP BY 1",
    "extraction_marks": "WITH m AS (SELECT l_partkey AS document_id, CASE WHEN l_linenumber % 2 = 0 THEN 'tables' ELSE 'findings' END AS kind, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'pending' ELSE 'ready' END AS status, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS error, l_orderkey * 10 + l_linenumber AS asked FROM lineitem) SELECT document_id, kind, status, error FROM m QUALIFY row_number() OVER (PARTITION BY document_id, kind ORDER BY asked DESC, status DESC, error DESC NULLS LAST) = 1",
    "manuscript_save": "WITH p AS (SELECT o_custkey AS k, o_orderkey AS a, CASE WHEN o_orderkey % 2 = 0 THEN 't' || o_orderkey END AS t, o_orderstatus AS d FROM orders WHERE o_orderkey % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT c_custkey AS public_id, coalesce(t, c_name) AS title, coalesce(d, c_mktsegment) AS doc, a AS saved_at FROM customer LEFT JOIN p ON k = c_custkey",
    "revision_snapshots": """WITH RECURSIVE s AS (SELECT user_id % 7 AS m, event_id AS i, epoch(date_trunc('second', ts))::BIGINT AS t FROM events), o AS (SELECT m, i, t, row_number() OVER (PARTITION BY m ORDER BY t, i) AS k FROM s),
kept AS (SELECT m, i, t FROM o WHERE k = 1 UNION ALL SELECT n.m, n.f.i, n.f.t FROM (SELECT kept.m, (SELECT min({'t': o.t, 'i': o.i}) FROM o WHERE o.m = kept.m AND o.t >= kept.t + 3600) AS f FROM kept) n WHERE n.f IS NOT NULL)
SELECT m AS manuscript_id, i AS save_id FROM kept QUALIFY row_number() OVER (PARTITION BY m ORDER BY t DESC, i DESC) <= 20""",
    "usage_monthly": f"""WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'disabled' WHEN 1 THEN 'exhausted' ELSE 'active' END AS st, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 90 * 10 END AS cap, s_suppkey % 50 * 10 AS used, s_suppkey % 2 = 1 AS rolled, s_suppkey % 4 = 0 AS dorm FROM supplier),
u AS (SELECT user_id % 80 AS id, sum(trunc(value)::BIGINT - 5)::BIGINT AS n FROM events WHERE trunc(value)::BIGINT - 5 > 0 GROUP BY 1),
j AS (SELECT s.*, n, CASE WHEN rolled THEN n ELSE used + n END AS total FROM s LEFT JOIN u ON u.id = s.id)
SELECT id, CASE WHEN n IS NULL OR st = 'disabled' THEN st WHEN total >= cap THEN 'exhausted' ELSE 'active' END AS status, coalesce(total, used) AS used, CASE WHEN NOT rolled OR n IS NOT NULL THEN '2024-03-01' ELSE '2024-02-27' END AS since, dorm AND n IS NULL AS dormant FROM j""",
    "sources_down": "SELECT event_id % 4000 AS search, bool_and(event_type = 'error') AS down FROM events GROUP BY 1",
    "preflight_anonymous": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN floor(c_acctbal / 100) >= 8 ELSE greatest(0, 20 - CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 25 ELSE 0 END) >= 8 END AS allowed FROM customer",
    "deck_references": """
WITH l AS (SELECT l_orderkey AS deck, l_linenumber AS s, l_suppkey AS b, unnest([{'i': 0, 'k': l_partkey}, {'i': 1, 'k': l_suppkey * 3}]) AS m FROM lineitem),
f AS (SELECT deck, m.k AS k, min({'s': s, 'b': b, 'i': m.i}) AS p FROM l GROUP BY ALL)
SELECT deck, row_number() OVER (PARTITION BY deck ORDER BY p, 'w' || k)::INT AS number, 'w' || k AS work_key, p_name AS title FROM f JOIN part ON p_partkey = k AND p_size <> 7""",
    "odd_markers": r"""
WITH t AS (
  SELECT conv_id, turn, text || ['[[a.c]] x ]] y', 'z [[k(1]] and [[ a.c ]]', ' [[abc]] [[ ]] [[', ']][[k|+]]]] end [[]].'][(turn % 4 + 1)::INT] AS t FROM conversations),
p AS (SELECT conv_id, turn, string_split_regex(t, '\[\[[^\]]+\]\]') AS x, regexp_extract_all(t, '\[\[[^\]]+\]\]') AS m, regexp_extract_all(t, '\[\[([^\]]+)\]\]', 1) AS k FROM t),
r AS (SELECT conv_id, turn, unnest(x) AS x, unnest(m) AS m, trim(unnest(k)) AS k, unnest(range(len(x))) AS i FROM p),
s AS (
  SELECT conv_id, turn, 2 * i AS i, 't' || x AS v FROM r WHERE x <> '' UNION ALL SELECT conv_id, turn, 2 * i + 1, 'c' || k FROM r WHERE m IS NOT NULL)
SELECT conv_id, turn, n AS segments, segments_md5, kept_md5
FROM (SELECT conv_id, turn, count(*) AS n, md5(string_agg(v, '|' ORDER BY i)) AS segments_md5 FROM s GROUP BY ALL)
JOIN (SELECT conv_id, turn, md5(string_agg(x || CASE WHEN k IN ('a.c', 'k(1', 'k|+') THEN m ELSE '' END, '' ORDER BY i)) AS kept_md5 FROM r GROUP BY ALL) USING (conv_id, turn)""",
    "marker_segments": "SELECT conv_id, turn, 4 + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS segments, CASE WHEN turn % 2 = 0 THEN 'k1|' ELSE '' END || 'k2|k3' AS keys, md5(text || ' ' || '|' || ' end') AS text_md5 FROM conversations",
    "document_context": _lexical("['tion','only','which','pour','nicht']") + ", best AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0 QUALIFY k <= 3) SELECT source, md5(string_agg('[' || CASE WHEN doc_id % 2 = 0 THEN 'page ' || (doc_id % 9) ELSE 'pages ' || (doc_id % 9) || '-' || (doc_id % 9 + 1) END || ']' || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(10) ORDER BY k)) AS context_md5 FROM best JOIN documents USING (source, doc_id) GROUP BY source",
    "retrieve_fallback": _lexical("['tion','only','which','pour','nicht']") + ", v AS (SELECT source, doc_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -0.5 END)::DOUBLE[]), 6) AS score FROM documents JOIN embeddings ON vec_id = doc_id WHERE source < 'm'), b AS (SELECT * FROM v UNION ALL SELECT source, doc_id, score FROM s WHERE score > 0 AND source NOT IN (SELECT source FROM v)) SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 4",
    "findings_once": "WITH f AS (SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem WHERE l_linenumber <> 2 GROUP BY l_partkey, l_returnflag, l_quantity::INT) SELECT l_partkey, count(*) AS findings, min(o) AS first FROM f GROUP BY 1",
}
