"""Whole tables where a cut once stood."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from scholarframe.queries import citing, integration, reading
from scholarframe.sources import records


def test_payload_pages_hold_every_document(spark, tmp_path):
    docs = spark.range(1050).selectExpr("id AS doc_id", "concat('title ', id, '\\nrest') AS text", "id + 5 AS n_chars").repartition(3)
    reading.payload_pages(docs, f"file://{tmp_path}/payload")
    assert len(list(Path(f"{tmp_path}/payload").glob("part-*"))) == 11
    got = {r.source_record_id: (r.title, r.citation_count, r.year) for r in records.semanticscholar(spark, f"file://{tmp_path}/payload").collect()}
    assert got == {str(i): (f"title {i}", i + 5, i % 30 + 1990) for i in range(1050)}


def test_search_cache_keys_take_whole_texts(spark, tmp_path, monkeypatch):
    text = "a query that goes on beyond twenty characters"
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = iter((lambda q: F.char_length(F.trim(q)), lambda q: F.lit(len(text))))
    monkeypatch.setattr(integration.T, "search_key", lambda q, _: next(seen)(q))
    assert integration.search_cache_keys(spark, str(tmp_path)).first().same


def test_bibliography_cites_all_works(spark, tmp_path):
    spark.range(250).selectExpr("id AS doc_id", "concat('Title ', id) AS text", "'en' AS lang", "'s' AS source", "id + 7 AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(120).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'x' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    label = {f"w{r.doc_id}": r.apa for r in citing.inline_labels(spark, str(tmp_path)).collect()}
    got = {}
    for r in citing.bibliography(spark, str(tmp_path)).collect():
        got.setdefault(r.conv_id, set()).add((r.work_key, r.text))
    assert got == {i: {(k, label.get(k, f"[missing: {k}]")) for k in (f"w{3 * i}", "wnone", f"w{i}")} for i in range(120)}


def test_source_admin_numbers_ranges_apart(spark, tmp_path):
    spark.range(1, 2001).selectExpr("id AS s_suppkey", "concat('S', id * 7919 % 2003) AS s_name").repartition(5).write.parquet(f"{tmp_path}/supplier.parquet")
    out = integration.source_admin(spark, str(tmp_path))
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    name = lambda k: f"S{k * 7919 % 2003}"
    order = sorted(range(1, 2001), key=lambda k: (k % 3 != 0, name(k) if k % 3 == 0 else "", k))
    assert {r.s_suppkey: r.place for r in out.collect()} == {k: i for i, k in enumerate(order, 1)}
    none = spark.createDataFrame([], "s_suppkey long, s_name string")
    none.write.parquet(f"{tmp_path}/none/supplier.parquet")
    assert integration.source_admin(spark, f"{tmp_path}/none").count() == 0
