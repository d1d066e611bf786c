"""Citation graphs as two DataFrames: nodes(id, ...) and edges(source, target), where source cites target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.text import normalize_doi, trim
from scholarframe.operators.components import connected_components
from scholarframe.plans.tables import settle


#: Fixed value: nodes that a graph holds.
MAX_NODES = 150


def reference_key(doi: Column, title: Column, year: Column) -> Column:
    """A reference's node: by its DOI, else by a fingerprint of title and year, marked as unresolved."""
    plain = normalize_doi(doi)
    print_ = F.substring(F.sha2(F.concat(F.lower(trim(F.coalesce(title, F.lit("")))), F.lit("|"), F.coalesce(year.cast("string"), F.lit(""))), 256), 1, 24)
    return F.when(plain.isNotNull(), F.concat(F.lit("doi:"), plain)).otherwise(F.concat(F.lit("unresolved:"), print_))


def refs_to_graph(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of references: refs has root, kind (citing or cited), doi, title, year and ord.

    A citing reference points at its root, a root at what it cites.  Repeats stay; `merge_graph` takes each once."""
    own = refs.withColumn("id", reference_key(F.col("doi"), F.col("title"), F.col("year")))
    doi = normalize_doi(F.col("doi"))
    nodes = own.select("ord", "id", F.coalesce("title", doi, F.lit("Untitled")).alias("label"), doi.alias("doi"), "year", F.lit(False).alias("is_root"), doi.isNotNull().alias("resolved"), doi.isNotNull().alias("expandable"), F.lit(False).alias("expanded"))
    citing = F.col("kind") == "citing"
    return nodes, own.select("ord", F.when(citing, F.col("id")).otherwise(F.col("root")).alias("source"), F.when(citing, F.col("root")).otherwise(F.col("id")).alias("target"), "kind")


def merge_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, capacity: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with new ones, each once, in the order of `ord`, up to `capacity` nodes; an edge to a node that found no room goes too.

    Each table has ord; the limit is the graph's own, so the top nodes are few and known to be."""
    room = max(0, capacity - nodes.count())
    columns = nodes.columns
    first = new_nodes.groupBy("id").agg(F.min_by(F.struct(*columns), "ord").alias("n")).select("n.*").join(nodes.select("id"), "id", "left_anti").select(*columns)
    grown = nodes.unionByName(first.orderBy("ord", "id").limit(room))
    known = edges.select("source", "target").distinct()
    fresh = new_edges.groupBy("source", "target").agg(F.min_by(F.struct(*edges.columns), "ord").alias("e")).select("e.*").join(known, ["source", "target"], "left_anti")
    return grown, edges.unionByName(induced(fresh, grown).select(*edges.columns))


#: Fixed value: works that a search or a library seeds a graph with.
SEEDS = 20


def seeds(entries: DataFrame, works: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """(entry, owner, position, work_key, title): the works that start the graph of each entry, positions from 0.

    entries has entry (its kind: a work, a collection, a search, a library), owner, work_key and ord; limits has the kinds and how many works each starts with, None
    for all.  Keys of no work are left out before the count; a key that an owner has twice counts once, at its first place; ties go by key."""
    first = entries.where(F.col("entry").isin(*limits)).groupBy("entry", "owner", "work_key").agg(F.min("ord").alias("ord"))
    known = first.join(works.select("work_key", "title"), "work_key")
    placed = known.withColumn("position", F.row_number().over(Window.partitionBy("entry", "owner").orderBy("ord", "work_key")) - 1)
    within = F.lit(False)
    for entry, most in limits.items():
        within = within | ((F.col("entry") == entry) & (F.lit(most is None) | (F.col("position") < (most or 0))))
    return placed.where(within).select("entry", "owner", "position", "work_key", "title")


def mark_expanded(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.withColumn("expanded", F.col("expanded") | (F.col("id") == node))


def at_capacity(nodes: DataFrame, capacity: int = MAX_NODES) -> DataFrame:
    return nodes.agg((F.count("*") >= capacity).alias("full"))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes' ids with the number of edges that point at them; the edge's source need not be a node."""
    counts = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size): component is the smallest id of the undirected component."""
    inner = induced(edges, nodes)
    found = nodes.select("id").join(connected_components(inner, "source", "target"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select("id", "component", "size")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parts = components(nodes, edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    counts = nodes.agg(F.count("*").alias("nodes"), F.count_if(~F.col("resolved")).alias("unresolved"))
    # Of equally cited ones the smallest id; none where nothing is cited.
    cited = in_degree(nodes, edges).where("in_degree > 0").agg(F.min_by(F.struct("id", "in_degree"), F.struct(-F.col("in_degree"), "id")).alias("m")).select("m.id", F.col("m.in_degree").alias("most"))
    links = edges.agg(F.count("*").alias("links"))
    return counts.join(links).join(parts).join(cited).select("nodes", "links", "components", "largest", "unresolved", F.col("id").alias("most_cited"), F.col("most").alias("most_cited_degree"))


def year_layers(nodes: DataFrame) -> DataFrame:
    """Years since the earliest node; -1 without a year."""
    first = nodes.agg(F.coalesce(F.min("year"), F.lit(0)).alias("first"))
    return nodes.join(F.broadcast(first)).select("id", F.coalesce(F.col("year") - F.col("first"), F.lit(-1)).alias("layer"))


def reach(edges: DataFrame, starts: DataFrame, blocked: str | None = None, directed: bool = True) -> DataFrame:
    """(id, hops, before) of all nodes reachable from `starts`(id): breadth first, one join a level.

    before is the smallest predecessor on a shortest path.  With `blocked`, paths don't lead on from that node."""
    steps = edges.select("source", "target")
    steps = steps if directed else steps.union(steps.select("target", "source")).distinct()
    steps = settle(steps.where(F.col("source") != blocked) if blocked else steps, "steps")
    seen = settle(starts.select("id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("before")).distinct(), "seen")
    front, hops = seen, 0
    while True:
        hops += 1
        new = front.join(steps, front.id == steps.source).groupBy("target").agg(F.min("source").alias("before"))
        front = settle(new.join(seen.select(F.col("id").alias("known")), F.col("target") == F.col("known"), "left_anti").select(F.col("target").alias("id"), F.lit(hops).alias("hops"), "before"), "front")
        if front.isEmpty():
            return seen
        seen = settle(seen.union(front), "seen")


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(position, id) of a shortest directed path, of those the one of the smallest predecessors; none if there is no way."""
    spark = edges.sparkSession
    seen = reach(edges, spark.createDataFrame([(start,)], "id string"))
    at = seen.where(F.col("id") == end).select("id", "hops", "before")
    path = at
    for _ in range(1_000_000):
        at = settle(seen.join(at.select(F.col("before").alias("next")), F.col("id") == F.col("next")).select("id", "hops", "before"), "path")
        if at.isEmpty():
            return path.select(F.col("hops").alias("position"), "id")
        path = path.union(at)
    return path


def filter_graph(nodes: DataFrame, edges: DataFrame, year_from: int | None = None, year_to: int | None = None, hide_unresolved: bool = False, min_in_degree: int = 0) -> DataFrame:
    """Roots stay; others by year (null passes), resolution and in-degree in the whole graph."""
    keep = F.lit(True)
    if hide_unresolved:
        keep = keep & F.col("resolved")
    if year_from is not None:
        keep = keep & (F.col("year").isNull() | (F.col("year") >= year_from))
    if year_to is not None:
        keep = keep & (F.col("year").isNull() | (F.col("year") <= year_to))
    return nodes.join(in_degree(nodes, edges), "id").where(F.col("is_root") | (keep & (F.col("in_degree") >= min_in_degree)))


def collapse(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Nodes that the roots, or `node` itself, reach undirected without going on from `node`."""
    spark = nodes.sparkSession
    starts = nodes.where("is_root").select("id").union(spark.createDataFrame([(node,)], "id string"))
    return nodes.join(reach(edges, starts, blocked=node, directed=False).select("id"), "id", "left_semi")


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source") == node).select(F.col("target").alias("id")).union(edges.where(F.col("target") == node).select(F.col("source").alias("id"))).distinct()


def round_robin(refs: DataFrame, budget: int = 150) -> DataFrame:
    """First `budget` distinct nodes when seeds take turns; refs has seed, turn order `ord` and node.

    A node counts at its first turn.  Only each node's first place is ranked, which top-k bounds."""
    turn = refs.withColumn("turn", F.row_number().over(Window.partitionBy("seed").orderBy("ord", "node")))
    first = turn.groupBy("node").agg(F.min(F.struct("turn", "seed")).alias("f"))
    return first.orderBy("f", "node").limit(budget).select("node", F.col("f.turn").alias("turn"), F.col("f.seed").alias("seed"))


def merge_refs(refs: DataFrame) -> DataFrame:
    """One reference per DOI: the first that has a title, else the first; in order of first sight; DOI-less ones all stay."""
    by_doi = refs.where("doi is not null").groupBy("doi").agg(F.min_by(F.struct("title", "year"), F.struct(F.col("title").isNull(), "ord")).alias("r"), F.min("ord").alias("ord"))
    return by_doi.select("ord", "doi", "r.title", "r.year").union(refs.where("doi is null").select("ord", "doi", "title", "year"))
