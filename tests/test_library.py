"""Written state, graphs from references, readers of lists, and queries without an oracle, on small inputs."""

from __future__ import annotations

import json
import random
import re
import subprocess
import sys
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scholarframe.functions import text as T
from scholarframe.operators import cite, evidence, graph, integrate, ledger, library, rank
from scholarframe.sources import records


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def plain_title(text):
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", text)).strip()


def test_titles_fold_every_code_point(spark):
    """Whole planes, one character a title between letters, against NFKD itself."""
    chars = [chr(c) for c in [*range(0x80, 0x3000), *range(0xF900, 0xFB10), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]]
    chars = [c for c in chars if unicodedata.category(c) not in ("Cn", "Co", "Cs") and not c.isspace() and len(c.lower()) == 1]
    rows = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(chars)], "i int, t string").select("i", T.normalize_title(F.col("t")).alias("n"))
    wrong = [(hex(ord(chars[r.i])), r.n) for r in rows.collect() if r.n != plain_title(f"a{chars[r.i]}b")]
    assert wrong == []
    assert one(spark, "½ № ㎏ 𝐚 𝟐 ﬁ", T.normalize_title) == "1 2 o kg a 2 fi"
    assert rank.query_tokens("㎏ 𝐚𝐛 ﬁne") == ["kg", "ab", "fine"]


def test_same_work_guard(spark):
    rows = [("one two three", "One two four", 0.5, True), ("a b c d e", "v w x y z", 0.0, False), ("", "", None, True), (None, "x", None, True), (" .", "x", None, True)]
    got = spark.createDataFrame([r[:2] for r in rows], "a string, b string").select(integrate.word_overlap(F.col("a"), F.col("b")), integrate.same_work(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]


def test_reconcile_keeps_blocks_whole_and_topics_once(spark):
    kinds = "ord long, source_id string, source_record_id string, doi string, title string, abstract string, authors array<struct<name:string,orcid:string>>, year int, venue string, citation_count long, is_oa boolean, pdf_url string, cluster int, biblio struct<volume:string,issue:string>, topics array<struct<name:string,score:double>>"
    base = (None, "t", None, [], None, None, None, None, None, 0)
    rows = [(0, "core", "0", *base, ("9", "1"), [("x", 0.2), ("y", 0.9)]), (1, "crossref", "1", *base, (None, None), None), (2, "openalex", "2", *base, ("4", None), [("x", 0.9), ("z", 0.1)])]
    row = integrate.reconcile(spark.createDataFrame(rows, kinds)).first()
    assert tuple(row.biblio) == ("4", None) and [tuple(t) for t in row.topics] == [("x", 0.9), ("y", 0.9), ("z", 0.1)]


def test_graph_grows_to_its_capacity(spark):
    refs = [("r", "cited", f"10.1/{k}", f"T{k}", 2000, k) for k in range(6)] + [("r", "citing", None, " Same ", None, 7), ("r", "cited", None, "same", None, 8), ("r", "cited", "https://doi.org/10.1/0", "again", None, 9)]
    nodes, edges = graph.refs_to_graph(spark.createDataFrame(refs, "root string, kind string, doi string, title string, year int, ord long"))
    roots = spark.createDataFrame([(-1, "r", "R", None, None, True, True, False, True)], nodes.schema)
    grown, linked = graph.merge_graph(roots, edges.limit(0), nodes, edges, capacity=5)
    assert {r.id for r in grown.collect()} == {"r", *(f"doi:10.1/{k}" for k in range(4))} and linked.count() == 4
    assert graph.at_capacity(grown, 5).first().full and not graph.at_capacity(grown, 6).first().full
    every, linked = graph.merge_graph(roots, edges.limit(0), nodes, edges)
    unresolved = every.where("not resolved").collect()
    assert len(unresolved) == 1 and unresolved[0].id.startswith("unresolved:") and len(unresolved[0].id) == 35
    assert linked.count() == 8  # six cited, and one title both citing and cited
    again, same = graph.merge_graph(every, linked, nodes, edges)
    assert again.count() == every.count() and same.count() == linked.count()
    assert graph.summary(spark.createDataFrame([("a", True)], "id string, resolved boolean"), linked.limit(0)).count() == 1


def test_revisions_against_a_loop(spark):
    rng = random.Random(4)
    saves = sorted({(m, rng.randint(0, 9000)) for m in range(3) for _ in range(120)})
    rows = [(m, i, at) for i, (m, at) in enumerate(saves)] + [(None, 999, 5), (1, 998, None)]
    got = {(r.manuscript_id, r.save_id) for r in library.revisions(spark.createDataFrame(rows, "manuscript_id long, save_id long, at long").repartition(4)).collect()}
    want = set()
    for m in range(3):
        last, own = None, []
        for i, (k, at) in enumerate(saves):
            if k == m and (last is None or at - last >= 300):
                own.append((m, i))
                last = at
        want |= set(own[-20:])
    assert got == want


def test_library_writes(spark):
    saved = spark.createDataFrame([("u", 1), ("v", 2)], "user_id string, item string")
    left, told = library.delete_owned(saved, spark.createDataFrame([("v", 1), ("v", 2)], "user_id string, item string"), ["item"])
    assert [tuple(r) for r in left.collect()] == [("u", "1")] and {(r.item, r.deleted) for r in told.collect()} == {("1", False), ("2", True)}
    made = library.create_collections(spark.createDataFrame([("u", "a")], "user_id string, name string"), spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("u", "b", 3), ("v", "a", 4)], "user_id string, name string, asked int"))
    assert {r.asked for r in made.where("created").collect()} == {2, 4}
    sources = spark.createDataFrame([(1, "active", None, 5), (2, "active", 10, 9), (3, "disabled", 10, 9)], "id int, status string, monthly_token_cap long, tokens_used_period long").withColumns({"period_starts_at": F.lit("2024-03-01").cast("timestamp"), "dormant_until": F.lit("2024-03-02").cast("timestamp")})
    after = {r.id: r for r in library.record_usage(sources, spark.createDataFrame([(1, 4), (2, 1), (3, 9), (1, -5)], "id int, tokens long"), F.lit("2024-03-09").cast("timestamp")).collect()}
    assert [(after[i].status, after[i].tokens_used_period, after[i].dormant_until) for i in (1, 2, 3)] == [("active", 9, None), ("exhausted", 10, None), ("disabled", 18, None)]


def test_markers_and_context(spark):
    cut = one(spark, "a [[ k ]]b[[]] c [[x]]", T.marker_segments)
    assert [tuple(x) for x in cut] == [("text", "a "), ("citation", "k"), ("text", "b[[]] c "), ("citation", "x")]
    assert one(spark, "a [[ k ]] [[q]]", lambda c: T.remap_markers(c, F.create_map(F.lit("k"), F.lit("w1")))) == "a [[w1]] [[q]]"
    rows = spark.createDataFrame([("s", 2, 3, 4, " b "), ("s", 1, 2, 2, "a")], "g string, rank int, page_start int, page_end int, content string")
    assert rank.document_context(rows, "g").first().context == "[page 2]\na\n\n[pages 3-4]\nb"
    found = spark.createDataFrame([(1, 1, "n", "5", "is 5", "it Is  5."), (1, 2, "n", "5", "is 5", "is 5"), (1, 3, "n", "6", "is 5", "is 5"), (1, 4, "n", "7", "is 7", "is 5")], "doc int, ord int, field string, value string, quote string, source string")
    assert [r.ord for r in evidence.findings_once(found, "doc", "ord").collect()] == [1]
    deck = spark.createDataFrame([(1, 1, 1, "[[b]] [[a]]"), (1, 0, 1, "[[z]] [[b]]")], "deck int, slide int, bullet int, text string")
    works = spark.createDataFrame([("a", "A"), ("b", "B")], "work_key string, title string")
    assert {(r.number, r.title) for r in cite.deck_references(deck, works).collect()} == {(1, "B"), (2, "A")}


def test_list_readers(spark, tmp_path):
    write = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and f"file://{tmp_path}/{name}"
    coci = write("coci.json", [{"citing": "10.1/a", "cited": "10.1/b"}, {"citing": None, "cited": "10.1/b"}])
    assert [tuple(r) for r in records.opencitations(spark, coci, "citing").collect()] == [("10.1/a", None, None)]
    edges = write("s2.json", {"data": [{"citedPaper": {"title": "T", "year": 2001, "externalIds": {"DOI": "10.1/c"}}}, {"citedPaper": None}, {"citedPaper": {"title": "U"}}]})
    assert {tuple(r) for r in records.semanticscholar_edges(spark, edges, "cited").collect()} == {("10.1/c", "T", 2001), (None, "U", None)}
    works = write("works.json", {"results": [{"id": "https://openalex.org/W1", "publication_year": 1999}, {"display_name": "no id"}]})
    assert [tuple(r) for r in records.publications(spark, works).collect()] == [("W1", "publication", "Untitled work", 1999)]
    reviews = write("reviews.json", {"group": [{"peer-review-group": [{"peer-review-summary": [{"put-code": 7, "completion-date": {"year": {"value": "2020"}}}, {}]}]}, {}]})
    assert [tuple(r) for r in records.peer_reviews(spark, reviews).collect()] == [("7", "peer_review", "Peer review", 2020)]
    found, status = records.fan_out(spark, {"openalex": works, "core": f"file://{tmp_path}/nowhere.json", "unheard": works})
    assert {r.source_id: r.status for r in status.collect()} == {"openalex": "ok", "core": "error", "unheard": "error"} and found.count() == 2


def test_fuzzy_clusters_against_all_pairs(spark):
    """`cluster_fuzzy`'s operator, by every pair of records."""
    rng = random.Random(6)
    titles = ["graph learning for proteins", "graph learning of proteins", "Graph-learning for protein", "an unrelated title here", "notes"]
    rows = [(i, "arxiv", str(i), f"10.1/{i}" if rng.random() < 0.4 else None, rng.choice(titles), None, [(rng.choice(["A Lee", "B. Lee", "C Kim"]), None)], rng.choice([None, 2000, 2001, 2004]), None, None, None, None) for i in range(60)]
    works = spark.createDataFrame(rows, "ord long, source_id string, source_record_id string, doi string, title string, abstract string, authors array<struct<name:string,orcid:string>>, year int, venue string, citation_count long, is_oa boolean, pdf_url string")
    got = {r.ord: r.cluster for r in integrate.cluster(works, integrate.doi_edges(works).union(integrate.fuzzy_edges(works))).collect()}
    at = list(range(60))
    find = lambda i: i if at[i] == i else find(at[i])
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            near = a[7] is None or b[7] is None or abs(a[7] - b[7]) <= 1
            alike = integrate.jaro_winkler(plain_title(a[4]), plain_title(b[4])) >= 0.92
            if (a[3] is None or b[3] is None) and a[6][0][0][-3:] == b[6][0][0][-3:] and near and alike:
                x, y = sorted((find(i), find(j)))
                at[y] = x
    assert got == {i: find(i) for i in range(60)}


def test_breaker_against_a_loop(spark):
    """`breaker_fsm`'s operator over many batches, by the rules written out again."""
    rng = random.Random(9)
    calls = [(p, i, i * 9_000 + rng.randint(0, 8_000), rng.random() < (0.2 if i % 40 < 15 else 0.9)) for p in range(3) for i in range(200)]
    got = {(r.provider_id, r.event_id): (r.state, r.allowed) for r in ledger.breaker_states(spark.createDataFrame(calls, "provider_id long, event_id long, at_ms long, ok boolean").repartition(5)).collect()}
    for p in range(3):
        is_open, fails, last, wait, since = False, 0, [], 30_000, 0
        for _, i, at, ok in sorted((c for c in calls if c[0] == p), key=lambda c: (c[2], c[1])):
            if is_open and at - since < wait:
                want = ("open", False)
            elif is_open and ok:
                is_open, fails, last, wait, want = False, 0, [], 30_000, ("closed", True)
            elif is_open:
                since, wait, want = at, min(2 * wait, 300_000), ("open", True)
            else:
                fails, last = 0 if ok else fails + 1, [*last, ok][-10:]
                if not ok and (fails >= 5 or len(last) == 10 and last.count(False) >= 8):
                    is_open, since = True, at
                want = ("open" if is_open else "closed", True)
            assert got[p, i] == want


@pytest.mark.parametrize("seed", [1, 2])
def test_page_text_against_regular_expressions(spark, seed):
    """`page_normalize`'s expression, by the same steps in Python."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "b-\n", "-\nc", "\n", "\r\n", "\r", " ", "\t", "\n\n\n", "é", "."]) for _ in range(rng.randint(0, 60))) for _ in range(200)]

    def plain(text):
        for pattern, to in ((r"\r\n?", "\n"), (r"(?a)(\w)-\n(\w)", r"\1\2"), (r"([^\n])\n(?!\n)", r"\1 "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
            text = re.sub(pattern, to, text)
        return text.strip()

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.normalize_page(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_entry_stands_without_the_optional_operators():
    """With their subpackage out of reach the entry has the other queries; a broken operator is no missing one."""
    root = Path(__file__).resolve().parents[1]
    block = "import sys; sys.modules['scholarframe.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'search_keyword' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", block], cwd=root, capture_output=True, text=True, check=True).stdout) > 100
