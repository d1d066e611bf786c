"""The input tables in the roles that the operators work on; every expression is deterministic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.plans.tables import table

#: Sources in the order that decides between records of equal standing elsewhere.
SOURCES = ("crossref", "openalex", "europepmc", "pubmed", "doaj", "arxiv", "semanticscholar", "core", "unpaywall")
NOW_YEAR = 2026


def raw_work(spark: SparkSession, sf_dir: str, abstract: Callable[[Column], Column] | None = None) -> DataFrame:
    """One record per document: ord, source_id, doi, title, abstract, authors, year, venue, citation_count, is_oa, pdf_url, topics.

    With `abstract`, that of the text stands for the abstract, whose length is a column abstract_length. All comes from the text before labels are joined, so that no more of it is shuffled than is asked for."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("doc_id") % 9 + 1).cast("int")).alias("source_id"),
        F.col("doc_id").cast("string").alias("source_record_id"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("10.5555/"), F.substring(F.md5(text.cast("binary")), 1, 12))).alias("doi"),
        F.substring_index(text, "\n", 1).alias("title"),
        (abstract(text) if abstract else text).alias("abstract"),
        F.array(F.struct(F.substring_index(text, " ", 1).alias("name"), F.when(F.col("doc_id") % 5 == 0, F.lit("0000-0001")).alias("orcid"))).alias("authors"),
        F.when(F.col("doc_id") % 13 != 0, (F.col("n_chars") % 36 + 1990).cast("int")).alias("year"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("Venue "), (F.col("n_chars") % 7).cast("string"))).alias("venue"),
        F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") % 500).alias("citation_count"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://pdf.example/"), F.col("doc_id").cast("string"))).alias("pdf_url"),
        *([F.length(text).alias("abstract_length")] if abstract else []),
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), (F.col("quality") == 1).alias("is_oa"))
    names = docs.columns
    at = names.index("pdf_url")
    return docs.join(labels, "ord", "left").select(*names[:at], "is_oa", *names[at:])


#: The same records for the oracle.
RAW_WORK_SQL = """
raw_work AS (
  SELECT d.doc_id AS ord,
    list_extract(['crossref','openalex','europepmc','pubmed','doaj','arxiv','semanticscholar','core','unpaywall'], (d.doc_id % 9 + 1)::INT) AS source_id,
    d.doc_id::VARCHAR AS source_record_id,
    CASE WHEN d.doc_id % 3 <> 0 THEN '10.5555/' || substr(md5(text), 1, 12) END AS doi,
    string_split(text, chr(10))[1] AS title, text AS abstract, string_split(text, ' ')[1] AS author,
    CASE WHEN d.doc_id % 13 <> 0 THEN (n_chars % 36 + 1990)::INT END AS year,
    CASE WHEN d.doc_id % 4 <> 0 THEN 'Venue ' || (n_chars % 7)::VARCHAR END AS venue,
    CASE WHEN d.doc_id % 11 <> 0 THEN n_chars % 500 END AS citation_count,
    quality = 1 AS is_oa,
    CASE WHEN d.doc_id % 4 = 0 THEN 'https://pdf.example/' || d.doc_id::VARCHAR END AS pdf_url,
    CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS orcids
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts as works of a citation graph: id, label, year, is_root, resolved."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, tag, key, label, year, root="false", resolved="true": df.selectExpr(f"concat('{tag}', {key}) AS id", f"{label} AS label", f"cast({year} AS int) AS year", f"{root} AS is_root", f"{resolved} AS resolved")
    return (
        node(t("region"), "r", "r_regionkey", "r_name", "1990 + r_regionkey", "r_regionkey < 2")
        .union(node(t("nation"), "n", "n_nationkey", "n_name", "1995 + n_nationkey % 10"))
        .union(node(t("supplier"), "s", "s_suppkey", "s_name", "case when s_suppkey % 4 = 0 then null else 2000 + s_suppkey % 20 end", resolved="s_suppkey % 5 <> 0"))
        .union(node(t("customer"), "c", "c_custkey", "c_name", "2005 + c_custkey % 18", resolved="c_custkey % 7 <> 0"))
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges, source cites target, one of each nation to its region, supplier to its nation, customer to its nation or, each eighth one, to a supplier."""
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda df, source, target: df.selectExpr(f"{source} AS source", f"{target} AS target")
    return (
        edge(t("nation"), "concat('n', n_nationkey)", "concat('r', n_regionkey)")
        .union(edge(t("supplier"), "concat('s', s_suppkey)", "concat('n', s_nationkey)"))
        .union(edge(t("customer"), "concat('c', c_custkey)", "case when c_custkey % 8 = 0 then concat('s', c_custkey % 10 + 1) else concat('n', c_nationkey) end"))
    )


GRAPH_SQL = """
node AS (
  SELECT 'r' || r_regionkey AS id, r_name AS label, (1990 + r_regionkey)::INT AS year, r_regionkey < 2 AS is_root, true AS resolved FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, (1995 + n_nationkey % 10)::INT, false, true FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (2000 + s_suppkey % 20)::INT END, false, s_suppkey % 5 <> 0 FROM supplier
  UNION ALL SELECT 'c' || c_custkey, c_name, (2005 + c_custkey % 18)::INT, false, c_custkey % 7 <> 0 FROM customer),
edge AS (
  SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 8 = 0 THEN 's' || (c_custkey % 10 + 1) ELSE 'n' || c_nationkey END FROM customer)
"""
