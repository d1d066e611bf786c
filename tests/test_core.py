"""Behaviour of the reference's own operators on small inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from scholarframe.functions import text as T
from scholarframe.operators import cite, evidence, graph, integrate, ledger, passages, rank
from scholarframe.operators.components import connected_components


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_normalisation(spark):
    assert one(spark, "  https://dx.doi.org/10.1/ABC ", T.normalize_doi) == "10.1/abc"
    assert one(spark, "doi:10.1/x", T.normalize_doi) == "10.1/x"
    assert one(spark, "https://doi.org/", T.normalize_doi) is None
    assert one(spark, "Éléments — of Ｆｉｎｅ ﬁts (2)", T.normalize_title) == "elements of fine fits 2"
    assert one(spark, None, T.count_words) == 0
    assert one(spark, "a\r\nexperi-\nment b\nc\n\n\n\nd", T.normalize_page) == "a experiment b c\n\nd"
    assert one(spark, "x [p. 3] y [pp. 10–12] [p. 12345]", T.page_citations) == [3, 10]
    assert one(spark, 'so ```json\n{"a": {"b": 1}}\n``` {', lambda c: T.extract_json(c).isNotNull())
    assert one(spark, "none", lambda c: T.extract_json(c).isNotNull()) is False


def test_jaro_winkler():
    assert integrate.jaro_winkler("martha", "marhta") == 0.9611111111111111
    assert integrate.jaro_winkler("", "a") == 0.0
    assert integrate.jaro_winkler("same", "same") == 1.0


def _works(spark, rows):
    return spark.createDataFrame(
        [(o, s, str(o), d, t, None, [(a, None)] if a else [], y, None, c, None, None) for o, s, d, t, a, y, c in rows],
        "ord long, source_id string, source_record_id string, doi string, title string, abstract string, authors array<struct<name:string,orcid:string>>, year int, venue string, citation_count long, is_oa boolean, pdf_url string",
    )


def test_fuzzy_clusters_join_preprint_and_article(spark):
    works = _works(spark, [
        (0, "crossref", "10.1/a", "Deep learning for protein folding", "Ann Lee", 2020, 5),
        (1, "arxiv", None, "Deep Learning for Protein Folding", "A. Lee", 2019, 1),
        (2, "arxiv", None, "Deep Learning for Protein Folding.", "B Lee", 2016, 1),
        (3, "core", None, "Something else entirely here", "Ann Lee", 2020, 0),
        (4, "core", "10.1/A", "Deep learning for protein folding", "Ann Lee", 2020, 9),
    ])
    edges = integrate.doi_edges(works).union(integrate.fuzzy_edges(works))
    found = {r.ord: r.cluster for r in integrate.cluster(works, edges).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0}


def test_reconcile_survivorship(spark):
    works = _works(spark, [
        (0, "arxiv", "10.1/a", "Short", "X Y", 2019, None),
        (1, "openalex", "10.1/a", "From openalex", "X Y", 2020, 7),
        (2, "core", "10.1/a", "Untitled", "X Y", 2020, 3),
        (3, "core", "10.1/a", "", "X Y", 2019, 3),
    ]).withColumn("cluster", F.lit(0))
    row = integrate.reconcile(works).first()
    assert (row.title, row.year, row.citation_count, row.is_oa, len(row.sources)) == ("From openalex", 2020, 7, False, 4)


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40) if i not in (9, 23)] + [(50, 60), (60, 50)]
    for _ in range(2):
        rng.shuffle(edges)
        found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert found == {i: 0 if i < 10 else 10 if i < 24 else 24 for i in range(41)} | {50: 50, 60: 50}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_rank_and_filter(spark):
    assert rank.query_tokens("The Économie of A using deep-learning 2") == ["economie", "deep", "learning"]
    works = spark.createDataFrame([(1, 2000, None), (2, None, 5), (3, 2010, 9)], "cluster int, year int, citation_count int")
    assert [r.cluster for r in rank.filter_works(works, year_from=1999, min_citations=1).collect()] == [3]


def test_graph_paths_and_collapse(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    assert [(r.position, r.id) for r in graph.shortest_path(edges, "a", "c").orderBy("position").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert [r.id for r in graph.shortest_path(edges, "a", "a").collect()] == ["a"]
    assert graph.shortest_path(edges, "a", "x").count() == 0
    nodes = spark.createDataFrame([("r", True), ("n", False), ("m", False)], "id string, is_root boolean")
    line = spark.createDataFrame([("r", "n"), ("n", "m")], "source string, target string")
    assert {r.id for r in graph.collapse(nodes, line, "n").collect()} == {"r", "n"}


def test_running_balance_against_a_fold(spark):
    rng = random.Random(5)
    rows = [(u, i, rng.randint(-9, 6)) for u in range(4) for i in range(60)]
    events = spark.createDataFrame([(u, i, i, d) for u, i, d in rows], "user_id int, ts int, event_id int, delta int")
    found = {(r.user_id, r.ts): (r.balance, r.applied) for r in ledger.running_balance(events).collect()}
    for u in range(4):
        balance = 0
        for i in range(60):
            new = max(0, balance + rows[u * 60 + i][2])
            assert found[u, i] == (new, new - balance)
            balance = new


def test_breaker_opens_and_recovers():
    state, names = ledger.fresh_breaker(), []
    for at, ok in [(0, False)] * 5 + [(1000, True), (30_000, False), (60_000, True), (90_000, True), (91_000, True)]:
        state, name, allowed = ledger.breaker_step(state, at, ok)
        names.append((name, allowed))
    assert names[3:] == [("closed", True), ("open", True), ("open", False), ("open", True), ("open", False), ("closed", True), ("closed", True)]


def test_guards(spark):
    drafts = spark.createDataFrame([(1, "Kept [[a]] and [[ z ]]. No mark. Other [[z]]! Last [[b]]?")], "id int, text string")
    row = evidence.validate_draft(drafts, "id", "text", ["a", "b"]).first()
    assert (row.text, row.dropped_uncited, row.dropped_foreign) == ("Kept [[a]] and .\nLast [[b]]?", 2, 2)
    deck = spark.createDataFrame([(1, "- stray [[a]]\n# T\n- x [[a]] [[q]]\n- none\n## U\n* y")], "id int, text string")
    row = evidence.validate_outline(deck, "id", "text", ["a"]).first()
    assert (row.slides, row.bullets, row.dropped_uncited, row.dropped_foreign, row.dropped_slides) == (1, 1, 2, 1, 1)
    assert one(spark, "The  Quick\nfox", lambda c: evidence.quote_appears(c, F.lit("quick FOX")))
    assert not one(spark, "x", lambda c: evidence.quote_appears(c, F.lit(" ")))


def test_csv_and_names(spark):
    assert one(spark, '=1+"x"', T.csv_field) == '"\t=1+""x"""'
    rows = {"Ann B. Lee": "Lee, A. B.", "Lee, Ann": "Lee, A.", "Plato": "Plato", "Institute of Things": "Institute of Things", " ": "Unknown"}
    for name, want in rows.items():
        assert one(spark, name, lambda c: cite.inverted_initials(cite.csl_name(c))) == want


def test_chunks_cover_the_text():
    text = "One sentence here. " * 300
    found = list(passages.chunk_text([(1, text[:3000].strip()), (2, ""), (3, text[3000:].strip())]))
    assert [c[0] for c in found] == list(range(len(found)))
    assert found[0][1] == 1 and found[-1][2] == 3 and all(len(c[3]) <= passages.TARGET for c in found)
    assert list(passages.chunk_text([])) == []


def test_tables_from_positions():
    items = [("Table 2 results", 0.0, 100.0, 75.0, 10.0)] + [(t, x, 90.0 - 12 * r, 5.0 * len(t), 10.0) for r in range(3) for x, t in ((0.0, f"r{r}"), (80.0, "" if r == 1 else "12.5"), (150.0, "ok"))]
    ((caption, grid, sure),) = passages.tables_of(items)
    assert caption == "Table 2 results" and grid[1] == ["r1", "", "ok"] and sure == 0.59
    prose = [("some words of a paragraph", 0.0, 90.0 - 12 * r, 125.0, 10.0) for r in range(5)]
    assert list(passages.tables_of(prose)) == []


def test_entry_without_optional_operators(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "search_keyword" in names
