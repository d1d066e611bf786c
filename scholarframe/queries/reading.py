"""Queries on passages, tables, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.operators import passages
from scholarframe.plans.tables import settle, shared_dir, table
from scholarframe.queries.accounts import snapshots
from scholarframe.sources import pages, records
from scholarframe.streaming import breaker, health


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines in blocks of five as pages, cut into passages."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    pages = lines.groupBy("doc_id", F.floor(F.col("i") / 5).alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return passages.chunk_pages(pages, "doc_id", "page", "text").withColumn("content", F.md5(F.col("content").cast("binary")))


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as positioned text: number, part and quantity in three columns, a caption above."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n", "array(cast(l_partkey AS string), l_returnflag, cast(l_quantity AS string)) AS cells")
    cells = lines.select("l_orderkey", "n", F.posexplode("cells").alias("c", "text")).selectExpr("l_orderkey", "n * 10L + c AS ord", "text", "c * 100.0D AS x", "700.0D - n * 15 AS y", "length(text) * 5.0D AS width", "10.0D AS height")
    caption = lines.select("l_orderkey").distinct().selectExpr("l_orderkey", "0L AS ord", "concat('Table ', l_orderkey, ' lines') AS text", "0.0D AS x", "700.0D AS y", "90.0D AS width", "10.0D AS height")
    return cells.union(caption)


def tables_detect(spark, sf_dir):
    found = passages.detect_tables(positioned(spark, sf_dir), "l_orderkey")
    return found.select("l_orderkey", "caption", F.size("grid").alias("rows"), F.size(F.get("grid", 0)).alias("columns"), "confidence")


def abstract_from_index(spark, sf_dir):
    """Each document's text, through an inverted index and back."""
    index = records.inverted_index(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("words")), "doc_id")
    return index.select("doc_id", records.abstract_from_index(F.col("index")).alias("abstract"))


def payload_pages(docs: DataFrame, path: str) -> None:
    """Documents as search payloads of a hundred ids each, one file a payload, since a reader takes a file as one object."""
    item = F.struct(F.col("doc_id").cast("string").alias("paperId"), F.get(F.split("text", "\n"), 0).alias("title"), F.lit("").alias("venue"), F.col("n_chars").alias("citationCount"), (F.col("doc_id") % 30 + 1990).cast("int").alias("year"))
    pages = docs.groupBy(F.floor(F.col("doc_id") / 100).alias("page")).agg(F.sort_array(F.collect_list(item)).alias("data"))
    pages.select("data").write.option("maxRecordsPerFile", 1).json(path)


def source_json(spark, sf_dir):
    """Documents written as search payloads and read back by their reader."""
    path = f"{shared_dir(spark)}/payload-{uuid.uuid4().hex}"
    payload_pages(table(spark, sf_dir, "documents"), path)
    return records.semanticscholar(spark, path).select("source_record_id", "title", "venue", "citation_count", "year", "is_oa")


def _entry(source: str):
    """A document as an entry of the source's payloads; a ninth have no year."""
    key, title, year = F.col("doc_id").cast("string"), F.get(F.split("text", "\n"), 0), F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") % 30 + 1990).cast("int"))
    entry = {
        "openalex": F.struct(key.alias("id"), title.alias("title"), year.alias("publication_year")),
        "crossref": F.struct(key.alias("DOI"), F.array(title).alias("title"), F.when(year.isNotNull(), F.struct(F.array(F.array(year)).alias("date-parts"))).alias("published")),
        "europepmc": F.struct(key.alias("id"), title.alias("title"), year.cast("string").alias("pubYear")),
        "doaj": F.struct(key.alias("id"), F.struct(title.alias("title"), year.cast("string").alias("year")).alias("bibjson")),
        "semanticscholar": F.struct(key.alias("paperId"), title.alias("title"), year.alias("year")),
    }
    return F.to_json(entry[source]), year


def recorded_documents(docs: DataFrame, folder: str) -> None:
    """Documents as recorded pages of five sources, dealt by id: the entries of a year out of three hundred make a page."""
    sources = records.YEAR_SOURCES
    parts = []
    for k, source in enumerate(sources):
        payload, year = _entry(source)
        own = docs.where(F.col("doc_id") % len(sources) == k)
        # A page's years are near each other, as a source's are that is asked for a range at a time.
        at = F.floor(F.col("doc_id") / 1500) * 31 + F.coalesce(year - 1989, F.lit(0))
        parts.append(own.select(F.lit(source).alias("source"), at.cast("long").alias("page"), F.col("doc_id").cast("int").alias("position"), year.alias("year"), payload.alias("payload")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    pages.record(whole, folder)


def source_pages(spark, sf_dir):
    """Works of twelve years from the recorded pages of five sources; the range reaches each source's reader."""
    folder = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    recorded_documents(table(spark, sf_dir, "documents"), folder)
    found = None
    for source in records.YEAR_SOURCES:
        entries = pages.load(spark, folder, source).where("year >= 1998 and year < 2010")
        own = records.READERS[source](spark, entries).select("source_id", "source_record_id", "title", "year")
        found = own if found is None else found.unionByName(own)
    return found


def fan_out_totals(spark, sf_dir):
    """Sources, raw records and merged works of a search over all recorded pages, one source of which is not recorded."""
    folder = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    recorded_documents(table(spark, sf_dir, "documents"), folder)
    found, status = pages.fan_out(spark, folder, [*records.YEAR_SOURCES, "core"])
    titles = found.select(F.coalesce("title", F.lit("")).alias("title"), "year").distinct()
    return pages.totals(status, titles).select("succeeded", "raw", "merged", "degraded")


def page_links(spark, sf_dir):
    """Links of pages, as edges."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))
    return table(spark, sf_dir, "pages").select("page_id", hrefs.alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def stream_health_hourly(spark, sf_dir):
    """Hourly health of a stream over the events' files; equal to the batch query, since every bucket is complete in the end."""
    source = settle(snapshots(spark, sf_dir).withColumn("recorded_at", F.col("recorded_at").cast("timestamp")), "snapshots")
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rpartition("/")[0])
    out, name = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", uuid.uuid4().hex
    buckets = health.hourly_health(stream)
    sink = lambda df, _: df.write.mode("overwrite").parquet(out)
    buckets.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-{name}").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.parquet(out).select("provider_id", F.date_format("bucket_start", "yyyy-MM-dd HH").alias("bucket_start"), "snapshot_count", "up_count", "down_count", F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


def stream_breaker(spark, sf_dir):
    """Every call's answer and every cooldown's end, from a stream over the events' files, written batch by batch."""
    calls = snapshots(spark, sf_dir).select("provider_id", "event_id", F.col("recorded_at").cast("timestamp").alias("at"), "ok")
    source = settle(calls, "calls")
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rpartition("/")[0])
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    breaker.write_batches(breaker.breaker_events(stream), out, f"{out}-checkpoint").start().awaitTermination()
    return spark.read.parquet(out).select("provider_id", "kind", "event_id", "at_ms", "state", "allowed")


QUERIES = {f.__name__: f for f in (chunk_pages, tables_detect, abstract_from_index, source_json, source_pages, fan_out_totals, page_links, stream_health_hourly, stream_breaker)}

ORACLE_SQL = {
    "tables_detect": "WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, 'Table ' || l_orderkey || ' lines' AS caption, n::INT AS rows, 3 AS columns, 1.0::DOUBLE AS confidence FROM l WHERE n >= 3",
    "abstract_from_index": "SELECT doc_id, nullif(text, '') AS abstract FROM documents WHERE text IS NOT NULL",
    "source_json": "SELECT doc_id::VARCHAR AS source_record_id, string_split(text, chr(10))[1] AS title, NULL::VARCHAR AS venue, n_chars AS citation_count, (doc_id % 30 + 1990)::INT AS year, false AS is_oa FROM documents",
    "source_pages": """
WITH d AS (SELECT doc_id, ['openalex','crossref','europepmc','doaj','semanticscholar'][(doc_id % 5 + 1)::INT] AS source_id, string_split(text, chr(10))[1] AS title, (doc_id % 30 + 1990)::INT AS year FROM documents WHERE doc_id % 9 <> 0)
SELECT source_id, doc_id::VARCHAR AS source_record_id, title, year FROM d WHERE year BETWEEN 1998 AND 2009""",
    "fan_out_totals": """
WITH d AS (SELECT coalesce(string_split(text, chr(10))[1], '') AS title, CASE WHEN doc_id % 9 <> 0 THEN (doc_id % 30 + 1990)::INT END AS year FROM documents)
SELECT 5::BIGINT AS succeeded, (SELECT count(*) FROM d)::BIGINT AS raw, (SELECT count(*) FROM (SELECT DISTINCT * FROM d))::BIGINT AS merged, true AS degraded""",
    "page_links": """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""",
    "stream_health_hourly": "SELECT user_id % 9 AS provider_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket_start, count(*) AS snapshot_count, count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS up_count, count(*) FILTER (event_type = 'error') AS down_count, round(avg(value), 6) AS avg_latency_ms FROM events GROUP BY ALL",
}
