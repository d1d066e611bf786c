"""Titles compared in tiles against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from scholarframe.functions.text import fold_accents
from scholarframe.operators import integrate
from tests.test_growth import WORKS


def test_tiles_of_a_surname_find_all_pairs(spark, monkeypatch):
    """A surname far larger than a tile, small ones beside it; titles with several years, with none, and with and without a DOI."""
    monkeypatch.setattr(integrate, "TILE", 8)
    monkeypatch.setattr(integrate, "TILE_CHARS", 400)
    rng = random.Random(5)
    roots = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([12, 20, 60]))) for _ in range(12)]
    rows = []
    for i in range(260):
        t = list("lee " + rng.choice(roots))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(4, len(t))] = rng.choice("abcdefgh")
        name = "lee" if i % 4 else f"kim{i % 12}"
        rows.append((i, "arxiv", str(i), f"10.1/{i}" if rng.random() < 0.5 else None, "".join(t), None, [(name, None)], rng.choice([None, 2000, 2001, 2002, 2004, 2007]), None, None, None, None))
    works = spark.createDataFrame(rows, WORKS)
    plain = {i: " ".join(r[4].split()) for i, r in enumerate(rows)}
    at = list(range(len(rows)))
    find = lambda i: i if at[i] == i else find(at[i])
    links = 0
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            near = a[7] is None or b[7] is None or abs(a[7] - b[7]) <= 1
            if (a[3] is None or b[3] is None) and a[6] == b[6] and near and integrate.jaro_winkler(plain[i], plain[j]) >= 0.92:
                x, y = sorted((find(i), find(j)))
                at[y], links = x, links + 1
    got = {r.ord: r.cluster for r in integrate.cluster(works, integrate.fuzzy_edges(works)).collect()}
    assert got == {i: find(i) for i in range(len(rows))} and links > 100


def test_a_large_surname_is_many_groups(spark, monkeypatch):
    """No group holds more than two tiles, and titles of years that can't link don't meet."""
    monkeypatch.setattr(integrate, "TILE", 50)
    texts = spark.range(3000).selectExpr("'the' AS block", "id AS text_id", "concat('the ', id) AS t", "8 AS n", "true AS bare", "id % 13 = 0 AS open", "cast(1990 + id % 36 AS int) AS lo", "cast(1990 + id % 36 AS int) AS hi")
    groups = integrate._tiled(texts).groupBy("block", "x", "y").agg(F.count("*").alias("many"), (F.max("hi") - F.min("lo")).alias("years"), F.bool_or("open").alias("open")).collect()
    assert len(groups) > 200 and max(g.many for g in groups) < 200
    assert max(g.years for g in groups if not g.open) == 1


def test_ascii_texts_are_not_folded(spark):
    texts = spark.createDataFrame([("plain text",), ("café ﬁne ½",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(fold_accents(F.col("t"))).collect()] == ["plain text", "cafe fine 1 2", None, ""]


def test_copies_with_a_doi_are_linked_once(spark):
    """30 records without a DOI, no two titles the same, and 40 copies with one: links add up, and don't multiply."""
    title = "graph learning for proteins and other large molecules"
    rows = [(i, "arxiv", str(i), None if i < 30 else f"10.1/{i}", title + (f" {i}" if i < 30 else ""), None, [("Lee", None)], 2000, None, None, None, None) for i in range(70)]
    works = spark.createDataFrame(rows, WORKS)
    edges = integrate.fuzzy_edges(works)
    assert edges.count() <= 30 * 29 / 2 + 30 + 40
    assert {r.cluster for r in integrate.cluster(works, edges).collect()} == {0}
