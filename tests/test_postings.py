"""Retrieval for many queries against one query at a time, and what cells and findings keep."""

from __future__ import annotations

import math
import random
import re

from scholarframe.functions.text import RETRIEVAL_STOPWORDS
from scholarframe.operators import postings


def terms(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if len(w) > 2 and w not in RETRIEVAL_STOPWORDS]


def test_many_queries_equal_one_at_a_time(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["gene", "Yeast", "cell,", "the", "of", "x1y", "aa", "dose", "é"])
    rows = [(rng.randint(0, 4), i, " ".join(word() for _ in range(rng.randint(0, 25)))) for i in range(150)] + [(1, 900, None), (2, 901, "")]
    asked = [(1, "Gene? yeast (cell)!"), (2, "the of"), (3, "dose dose x1y"), (4, ""), (5, None), (6, "nowhere")]
    passages = spark.createDataFrame(rows, "doc int, place int, content string").repartition(3)
    got = postings.retrieve_many(postings.postings(passages, "doc", "place"), spark.createDataFrame(asked, "query_id int, text string"), "doc", "place", 3).collect()
    want = []
    for query, text in asked:
        for doc in range(5):
            scored = []
            for d, place, content in rows:
                own = terms(content)
                hits = [own.count(t) for t in set(terms(text))]
                if d == doc and any(hits):
                    scored.append((-round(sum(1 + math.log(h) for h in hits if h) / math.sqrt(len(own)), 6), place))
            want += [(query, doc, place, -score, k + 1) for k, (score, place) in enumerate(sorted(scored)[:3])]
    assert sorted((r.query_id, r.doc, r.place, r.score, r["rank"]) for r in got) == sorted(want)


def _excerpt(spark):
    passages = spark.createDataFrame([("d", 0, 1, "We recruited  40 patients."), ("d", 1, 7, "Dose was 5 mg daily."), ("e", 0, 2, "Patients only.")], "doc string, place int, page_start long, content string")
    asked = spark.createDataFrame([(1, "patients dose")], "query_id int, text string")
    return postings.excerpts(postings.retrieve_many(postings.postings(passages, "doc", "place"), asked, "doc", "place", 4), passages, "doc", "place")


def test_cells_are_found_only_where_quoted(spark):
    schema = "query_id int, doc string, found boolean, value string, unit string, quote string"
    cell = lambda *answer: postings.fill_cells(_excerpt(spark), spark.createDataFrame([(1, "d", *answer)], schema), "doc").where("doc = 'd'").first()[2:]
    none = (None,) * 4
    assert cell(True, " 5 MG", " mg ", "dose   was 5 mg ") == ("found", "5 MG", "mg", "dose   was 5 mg", 7)
    assert cell(True, "6", "mg", "dose was 5 mg") == ("not_reported", *none)
    assert cell(True, "5", "mg", "dose was 6 mg") == ("not_reported", *none)
    assert cell(True, "", "mg", "dose") == cell(True, "5", None, None) == cell(False, "5", "mg", "5 mg") == ("not_reported", *none)
    assert cell(None, "5", "mg", "5 mg") == ("error", *none)
    told = postings.fill_cells(_excerpt(spark), spark.createDataFrame([(1, "d", True, "40", "", "recruited 40 patients")], schema), "doc")
    assert sorted((r.doc, r.status, r.unit, r.page) for r in told.collect()) == [("d", "found", None, 1), ("e", "error", None, None)]


def test_findings_once_on_the_page_of_their_quote(spark):
    answers = [(1, "d", 0, "n", "40", None, "recruited 40 patients"), (1, "d", 1, "n", "40", "p", "40 patients"), (1, "d", 2, "dose", "5", "mg", "was 5 mg"), (1, "d", 3, "dose", "9", "mg", "was 5 mg"), (1, "d", 4, None, "5", None, "5 mg"), (1, "e", 0, "n", "40", None, "40 patients")]
    got = postings.findings(_excerpt(spark), spark.createDataFrame(answers, "query_id int, doc string, place int, field string, value string, unit string, quote string"), "doc")
    assert sorted(tuple(r) for r in got.collect()) == [("d", "dose", "5", "mg", "was 5 mg", 7), ("d", "n", "40", None, "recruited 40 patients", 1)]
