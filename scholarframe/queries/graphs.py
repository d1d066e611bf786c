"""Queries on the citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.operators import graph
from scholarframe.plans.tables import table
from scholarframe.plans.views import GRAPH_SQL, graph_edges, graph_nodes


def graph_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))


def graph_year_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.year_layers(graph_nodes(spark, sf_dir))


def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(graph_edges(spark, sf_dir), "c24", "r1")


def graph_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from every root, against the direction of citing."""
    edges = graph_edges(spark, sf_dir).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return graph.reach(edges, graph_nodes(spark, sf_dir).where("is_root").select("id")).select("id", "hops")


def graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = graph.filter_graph(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), year_from=1996, year_to=2012, hide_unresolved=True, min_in_degree=1)
    return kept.select("id", "year", "in_degree")


def graph_filter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the subgraph that the filter induces."""
    edges = graph_edges(spark, sf_dir)
    kept = graph.filter_graph(graph_nodes(spark, sf_dir), edges, year_from=1996, year_to=2012, hide_unresolved=True, min_in_degree=1)
    return graph.induced(edges, kept).groupBy("source", "target").agg(F.count("*").alias("n"))


def graph_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.collapse(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), "n3").select("id")


def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(graph_edges(spark, sf_dir), "s2")


def graph_seed_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 customers when nations take turns."""
    refs = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS seed", "c_custkey AS ord", "concat('x', c_custkey % 400) AS node")
    return graph.round_robin(refs, 150)


def merge_citation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS ord", "case when o_orderkey % 5 <> 0 then concat('10.1/', o_custkey) end AS doi", "case when o_orderkey % 3 <> 0 then concat('T', o_orderkey) end AS title", "year(o_orderdate) AS year")
    return graph.merge_refs(refs)


QUERIES = {f.__name__: f for f in (graph_in_degree, graph_components, graph_summary, graph_year_layers, graph_shortest_path, graph_hops, graph_filter, graph_filter_edges, graph_collapse, graph_neighbourhood, graph_seed_round_robin, merge_citation_refs)}

_REACH = "both_ways AS (SELECT source AS a, target AS b FROM edge UNION ALL SELECT target, source FROM edge), reach AS (SELECT id, id AS r FROM node UNION SELECT reach.id, b FROM reach JOIN both_ways ON a = r)"
_COMP = f"WITH RECURSIVE {GRAPH_SQL}, both_ways AS (SELECT source AS a, target AS b FROM edge UNION ALL SELECT target, source FROM edge), seeds AS (SELECT 1), lab AS (SELECT 0 AS k, id, id AS c FROM node UNION ALL SELECT k + 1, id, c FROM (SELECT l.k, l.id, least(l.c, coalesce(min(m.c), l.c)) AS c FROM lab l LEFT JOIN both_ways ON b = l.id LEFT JOIN lab m ON m.id = a AND m.k = l.k WHERE l.k < 12 GROUP BY l.k, l.id, l.c)), comp AS (SELECT id, c AS component FROM lab WHERE k = 12)"
_DEG = "deg AS (SELECT id, year, is_root, resolved, (SELECT count(*) FROM edge WHERE target = id) AS in_degree FROM node)"
_FILTERED = f"WITH {GRAPH_SQL}, {_DEG}, kept AS (SELECT * FROM deg WHERE is_root OR (resolved AND (year IS NULL OR year BETWEEN 1996 AND 2012) AND in_degree >= 1))"

ORACLE_SQL = {
    "graph_in_degree": f"WITH {GRAPH_SQL}, {_DEG} SELECT id, in_degree FROM deg",
    "graph_components": f"{_COMP} SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM comp",
    "graph_summary": f"{_COMP}, {_DEG} SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM edge) AS links, count(DISTINCT component) AS components, (SELECT max(n) FROM (SELECT count(*) AS n FROM comp GROUP BY component)) AS largest, (SELECT count(*) FROM node WHERE NOT resolved) AS unresolved, (SELECT arg_min(id, {{'d': -in_degree, 'i': id}}) FROM deg WHERE in_degree > 0) AS most_cited, (SELECT max(in_degree) FROM deg WHERE in_degree > 0) AS most_cited_degree FROM comp",
    "graph_year_layers": f"WITH {GRAPH_SQL} SELECT id, coalesce(year - (SELECT min(year) FROM node), -1) AS layer FROM node",
    "graph_shortest_path": f"WITH RECURSIVE {GRAPH_SQL}, p AS (SELECT 'c24' AS id, 0 AS hops, ['c24'] AS way UNION ALL SELECT target, hops + 1, list_append(way, target) FROM p JOIN edge ON source = p.id WHERE NOT list_contains(way, target)), best AS (SELECT way FROM p WHERE id = 'r1' ORDER BY hops, list_reverse(way) LIMIT 1) SELECT unnest(range(len(way))) AS position, unnest(way) AS id FROM best",
    "graph_hops": f"WITH RECURSIVE {GRAPH_SQL}, p AS (SELECT id, 0 AS hops FROM node WHERE is_root UNION SELECT source, hops + 1 FROM p JOIN edge ON target = p.id) SELECT id, min(hops) AS hops FROM p GROUP BY id",
    "graph_filter": f"{_FILTERED} SELECT id, year, in_degree FROM kept",
    "graph_filter_edges": f"{_FILTERED} SELECT source, target, count(*) AS n FROM edge WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept) GROUP BY ALL",
    "graph_collapse": f"WITH RECURSIVE {GRAPH_SQL}, both_ways AS (SELECT source AS a, target AS b FROM edge UNION SELECT target, source FROM edge), p AS (SELECT id FROM node WHERE is_root UNION SELECT 'n3' UNION SELECT b FROM p JOIN both_ways ON a = p.id WHERE p.id <> 'n3') SELECT id FROM node WHERE id IN (SELECT id FROM p)",
    "graph_neighbourhood": f"WITH {GRAPH_SQL} SELECT target AS id FROM edge WHERE source = 's2' UNION SELECT source FROM edge WHERE target = 's2'",
    "graph_seed_round_robin": "WITH t AS (SELECT c_nationkey AS seed, 'x' || (c_custkey % 400) AS node, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS turn FROM customer), f AS (SELECT node, min({'t': turn, 's': seed}) AS f FROM t GROUP BY node) SELECT node, f.t AS turn, f.s AS seed FROM f ORDER BY f, node LIMIT 150",
    "merge_citation_refs": "WITH r AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 5 <> 0 THEN '10.1/' || o_custkey END AS doi, CASE WHEN o_orderkey % 3 <> 0 THEN 'T' || o_orderkey END AS title, year(o_orderdate)::INT AS year FROM orders) SELECT min(ord) AS ord, doi, arg_min({'v': title}, {'a': (title IS NULL)::INT, 'b': ord}).v AS title, arg_min(year, {'a': (title IS NULL)::INT, 'b': ord}) AS year FROM r WHERE doi IS NOT NULL GROUP BY doi UNION ALL SELECT * FROM r WHERE doi IS NULL",
}
