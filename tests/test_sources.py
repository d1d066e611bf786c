"""Source readers on payloads of our own, malformed records among them; streams against batch."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from scholarframe.operators import ledger
from scholarframe.sources import records
from scholarframe.streaming import health


def write(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return f"file://{path}"


def test_json_sources(spark, tmp_path):
    path = write(tmp_path, "a.json", {"results": [{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/x", "title": "T", "publication_year": 2020, "cited_by_count": 3, "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "authorships": [{"author": {"display_name": "A B", "orcid": "https://orcid.org/0-1"}}], "open_access": {"is_oa": True}}, {"id": "https://openalex.org/W2", "title": None, "display_name": "D"}]})
    a, b = records.openalex(spark, path).orderBy("source_record_id").collect()
    assert (a.source_record_id, a.doi, a.abstract, a.authors[0].orcid, a.is_oa) == ("W1", "10.1/x", "hello world hello", "0-1", True)
    assert (b.title, b.abstract, b.authors, b.doi) == ("D", None, None, None)
    path = write(tmp_path, "c.json", {"message": {"items": [{"DOI": "10.1/Y", "title": ["T"], "author": [{"given": "Ann", "family": "Lee"}], "published": {"date-parts": [[2019]]}, "container-title": [], "abstract": "<jats:p>Text <b>x</b></jats:p>", "link": [{"URL": "u", "content-type": "application/pdf"}]}]}})
    (c,) = records.crossref(spark, path).collect()
    assert (c.doi, c.authors[0].name, c.year, c.venue, c.abstract, c.pdf_url) == ("10.1/y", "Ann Lee", 2019, None, "Text x", "u")
    path = write(tmp_path, "e.json", {"resultList": {"result": [{"id": "1", "authorString": "Lee A, Diaz B.", "pubYear": "20x", "isOpenAccess": "Y"}]}})
    (e,) = records.europepmc(spark, path).collect()
    assert ([x.name for x in e.authors], e.year, e.is_oa) == (["Lee A", "Diaz B"], None, True)


def test_xml_sources(spark, tmp_path):
    path = write(tmp_path, "x.xml", '<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><published>2021-01-02T00:00:00Z</published><title>One\n two</title><summary>s</summary><author><name>A</name></author><author><name>B</name></author><link href="p" title="pdf" rel="related"/></entry></feed>')
    (x,) = records.arxiv(spark, path).collect()
    assert (x.source_record_id, x.title, x.year, [a.name for a in x.authors], x.pdf_url) == ("2101.00001", "One two", 2021, ["A", "B"], "p")
    summaries = write(tmp_path, "s.json", {"result": {"uids": ["7"], "7": {"uid": "7", "title": "T", "pubdate": "2018 Mar", "source": "J", "articleids": [{"idtype": "doi", "value": "10.1/Z"}]}}})
    texts = write(tmp_path, "t.xml", "<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></S>")
    (p,) = records.pubmed(spark, summaries, texts).collect()
    assert (p.doi, p.abstract, p.year, p.venue) == ("10.1/z", "a b", 2018, "J")


def test_fan_out_keeps_going(spark, tmp_path):
    good = write(tmp_path, "g.json", {"data": [{"paperId": "1", "title": "T"}]})
    found, status = records.fan_out(spark, {"semanticscholar": good, "core": f"file://{tmp_path}/missing.json"})
    assert found.count() == 1
    assert {r.source_id: r.status for r in status.collect()} == {"semanticscholar": "ok", "core": "error"}


def test_streamed_breaker_equals_batch(spark, tmp_path):
    rows = [(i % 3, i, i * 7000, i % 5 == 0) for i in range(90)]
    calls = spark.createDataFrame(rows, "provider_id long, event_id long, at_ms long, ok boolean")
    calls.coalesce(1).write.parquet(f"file://{tmp_path}/calls")
    stream = spark.readStream.schema(calls.schema).parquet(f"file://{tmp_path}/calls")
    query = health.breaker_states(stream).writeStream.format("memory").queryName("breaker").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {tuple(r) for r in ledger.breaker_states(calls).collect()}
    assert {tuple(r) for r in spark.table("breaker").collect()} == batch and any(s == "open" for _, _, s, _ in batch)


def test_watermarked_hours(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 2).alias("provider_id"), F.timestamp_seconds(F.col("id") * 600).alias("recorded_at"), F.lit("up").alias("health"), F.col("id").cast("double").alias("latency_ms"))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/rows")
    query = health.hourly_health(stream, "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hours").count() == ledger.hourly_health(rows).count()
