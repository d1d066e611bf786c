"""Steps that once grew faster than their input."""

from __future__ import annotations

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from scholarframe.operators import dispatch, integrate, postings
from scholarframe.sources import pages, records
from scholarframe.streaming import breaker

WORKS = "ord long, source_id string, source_record_id string, doi string, title string, abstract string, authors array<struct<name:string,orcid:string>>, year int, venue string, citation_count long, is_oa boolean, pdf_url string"


def test_titles_are_compared_in_linear_time(spark):
    """Titles of one surname, some of 20,000 characters; each near copy finds its title, whatever lies between."""
    rng = random.Random(3)
    titles = ["".join(rng.choice("etaoin shrdlu") for _ in range(20_000 if i % 3 == 0 else 30 + i)) for i in range(24)]
    rows = [(i, "arxiv", str(i), None, t if i < 24 else t[:-2], None, [("the", None)], None if i % 5 == 0 else 2000 + i % 24, None, None, None, None) for i, t in enumerate(titles * 2)]
    began = time.time()
    edges = {tuple(sorted(r)) for r in integrate.fuzzy_edges(spark.createDataFrame(rows, WORKS)).collect()}
    assert {(i, i + 24) for i in range(24)} <= edges and time.time() - began < 60


def test_similar_is_jaro_winkler():
    rng = random.Random(1)
    pairs = []
    for _ in range(3_000):
        a = "".join(rng.choice("abcde é𝄞"[: rng.choice([2, 4, 8])]) for _ in range(rng.randint(0, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcde")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        if rng.random() < 0.2:
            rng.shuffle(b)
        pairs.append((a, "".join(b)))
    for least in (0.8, 0.92, 1.0):
        assert integrate.similar([a for a, _ in pairs], [b for _, b in pairs], least).tolist() == [integrate.jaro_winkler(a, b) >= least for a, b in pairs]


def test_dispatch_takes_many_ranks_a_round(spark, monkeypatch):
    """400 sources, each used up by a few calls, are decided in a few rounds."""
    from tests.test_dispatch import fold, told

    rng = random.Random(8)
    calls = [(i, rng.choice(["a", "a", "b"]), rng.randint(0, 900), rng.choice([0, 3, 5, 30]), "x") for i in range(3_000)]
    sources = [(p, 1000 * k + j, j, None if j % 97 == 0 else rng.randint(0, 40)) for k, p in enumerate("ab") for j in range(1, 401)]
    tables = []
    settle = dispatch.settle
    monkeypatch.setattr(dispatch, "settle", lambda df, name="table": tables.append(name) or settle(df, name))
    assert told(spark, calls, sources) == fold(calls, sources) and len(tables) < 40


def test_dispatch_over_many_stretches(spark, monkeypatch):
    from tests.test_dispatch import fold, told

    for name, value in (("RANKS", 3), ("STEP", 8), ("CHUNK", 20)):
        monkeypatch.setattr(dispatch, name, value)
    rng = random.Random(9)
    calls = [(i, rng.choice(["a", "b", "none", None]), rng.randint(0, 50), rng.choice([None, 0, 3, 9]), "x") for i in range(160)]
    sources = [("a", j, j, cap) for j, cap in enumerate([30, 5, None, 12, 0, 60, None], 1)] + [("b", 10 + j, j, cap) for j, cap in enumerate([20, 15, 90], 1)]
    assert told(spark, calls, sources) == fold(calls, sources)


def test_many_pages_are_few_partitions(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/recorded"
    rows = spark.range(30).selectExpr("'openalex' AS source", "id AS page", "0 AS position", "2000 AS year", "concat('{\"id\":\"', id, '\",\"publication_year\":2000}') AS payload")
    pages.record(rows, folder)
    monkeypatch.setattr(pages, "PARTITIONS", 7)
    reader = pages.PageReader({"path": folder, "source": "openalex"})
    parts = reader.partitions()
    assert len(parts) <= 7 and sorted(row[1] for p in parts for row in reader.read(p)) == list(range(30))


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_an_index_of_words_is_made_in_its_row(spark):
    texts = ["a b a", "", "x  y x x", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.split("text", " ").alias("words"))
    index = records.inverted_index(rows, "doc_id")
    assert exchanges(index) == 0
    got = {r.doc_id: r.t for r in index.select("doc_id", records.abstract_from_index(F.col("index")).alias("t")).collect()}
    assert got == {0: "a b a", 1: None, 2: "x  y x x", 3: None}


def test_payloads_of_many_groups_are_few_files(spark):
    from scholarframe.queries import library as queries

    rows = spark.range(3_000).selectExpr("id AS k", "id div 3 AS page")
    lists = queries._written(rows, "lists", F.struct(F.col("k").cast("string").alias("citing"), F.lit("s").alias("cited")), "page", None)
    assert len(spark.read.text(lists).inputFiles()) < 50
    assert sorted(int(r.doi) for r in records.opencitations(spark, lists, "citing").collect()) == list(range(3_000))


def test_postings_are_counted_and_dropped_in_their_row(spark, monkeypatch):
    docs = spark.createDataFrame([("s", i, f"word{i % 5} word{i % 5} other{i} thing {'word0' if i % 3 else ''}") for i in range(40)] + [("s", 99, None), ("s", 98, "of a")], "source string, doc_id long, content string")
    index = postings.postings(docs, "source", "doc_id")
    assert exchanges(index) == 0
    assert {(r.term, r.tf, r.length) for r in index.where("doc_id = 1").collect()} == {("word1", 2, 5), ("other1", 1, 5), ("thing", 1, 5), ("word0", 1, 5)}
    asked = spark.createDataFrame([(1, "word0 thing"), (2, "word3")], "query_id int, text string")
    found = lambda: sorted(tuple(r) for r in postings.retrieve_many(index, asked, "source", "doc_id", 3).collect())
    by_broadcast = found()
    monkeypatch.setattr(postings, "FEW_TERMS", 1)
    assert by_broadcast == found() and len(by_broadcast) == 6


def test_a_batch_of_calls_is_returned_in_slices(monkeypatch):
    """A provider's batch is never one table of objects; slices add up to what one table gave."""

    class Held:
        value, timers = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        registerTimer = deleteTimer = lambda self, at: None

    def run(size):
        monkeypatch.setattr(breaker, "SLICE", size)
        one = breaker.Breaker()
        one.handle, one.state = Handle(), Held()
        rng = random.Random(2)
        frames = [pd.DataFrame({"event_id": [k * 300 + i for i in range(300)], "at_ms": [rng.randint(0, 9_000_000) for _ in range(300)], "ok": [rng.random() < 0.4 for _ in range(300)]}) for k in range(4)]
        out = list(one.handleInputRows((1,), iter(frames), None))
        return len(out), pd.concat(out).values.tolist(), one.state.value

    few, rows, state = run(10_000)
    many, sliced, again = run(50)
    assert few == 1 and many > 20 and str(rows) == str(sliced) and state == again
