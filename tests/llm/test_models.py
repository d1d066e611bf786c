"""Toxicity and URL filter by held-out accuracy, and the pipeline's stages by what they must keep and drop."""

from __future__ import annotations

import math
import random
import zlib

from pyspark.sql import functions as F

from scholarframe.llm import toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=600):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "zzkrat", "zzkrem"]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (9_000, None, None, None, None), (9_001, "", "en", "s", 0), (None, "x", "en", "s", 1)], DOCS)
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) >= 0.95
    assert got[9_000].predicted == got[9_001].predicted == 0


def test_toxicity_without_labels(spark):
    rows, labels = corpus(n=20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(spark.createDataFrame(rows, DOCS), none).collect()} == {0.0}
    assert toxicity.score(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_toxicity_odd_rows(spark):
    """Repeated rows are scored alike, a very long text is scored whole, and no column of the documents meets one of the
    model's; equal texts with different labels make the same model in any order."""
    rows, labels = corpus(seed=2)
    long = "word " * 40_000
    odd = [(5_000, long + "you idiot moron zzkrat idiot", "en", "s", 1), (5_001, long, "en", "s", 1), rows[3], rows[3]]
    twice = [(6_000 + k, t, *rest) for k, (_, t, *rest) in enumerate(rows[:40])]
    marks = [*labels, *((6_000 + k, 1, 1 - x) for k, (_, _, x) in enumerate(labels[:40]))]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in [*rows, *odd, *twice]], DOCS + ", level int, raw int, marks int, x int, features int, row int")
    kinds = "doc_id long, quality int, toxic int"
    one = toxicity.fit(docs, spark.createDataFrame(marks, kinds))
    other = toxicity.fit(docs.repartition(7), spark.createDataFrame(marks[::-1], kinds).repartition(3))
    assert (one.learned, one.starts) == (other.learned, other.starts)
    scored = one.score(docs)
    assert scored.columns == [*docs.columns, "score"] and one.score(scored).columns == scored.columns
    got = scored.where("doc_id >= 5000 or doc_id = 3").select("doc_id", "score", "level", "raw", "features").collect()
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and sum(r.doc_id == 3 for r in got) == 3
    assert all((r.level, r.raw, r.features) == (1, 2, 5) for r in got)


def test_second_person_window_is_even(spark):
    """A hit is near a second person three words before or after it, at a text's ends as within."""
    texts = {"idiot a b you": 1, "idiot a b c you": 0, "x y z p q idiot a b you": 1, "x y z p q idiot a b c you": 0, "you a b idiot": 1, "you a b c idiot": 0, "p q you a b idiot": 1, "p q you a b c idiot": 0}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.row.text: r.near_you for r in toxicity.features(docs, set(), set()).collect()} == texts


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_url_rules(spark):
    cases = {
        "http://A.Example.com/en/71?x#y": ("a.example.com", "/en/71", "example.com/en/7"), "https://example.com/en/8": ("example.com", "/en/8", "com/en/"),
        "x://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/"), "x://example.net/de/8/9": ("example.net", "/de/8/9", "example.net/de/8"),
        "http://org/es/": ("org", "/es/", "org/es/"), "http://a.org?/es/": ("a.org", "", None), "a.com/en/": ("", "", None), "": ("", "", None), None: ("", "", None),
        "h://x://y.com/en/": ("x:", "//y.com/en/", None), "http://b.COM#/en/": ("b.com", "", None), "http://b.com\n/en/z": ("b.com\n", "/en/z", None), "://q.com/en/é": ("q.com", "/en/é", "com/en/"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    out = df.select("url", urls.host(F.col("url")).alias("h"), urls.path(F.col("url")).alias("p")).withColumn("f", urls.longest_rule(F.col("h"), F.col("p"), RULES))
    verdicts = {r: v for v, r in RULES}
    for r in out.collect():
        assert (r.h, r.p, r.f and r.f.rule) == cases[r.url]
        assert r.f is None or r.f.verdict == verdicts[r.f.rule]


def test_url_features_and_held_out(spark):
    row = urls.lexical(spark.createDataFrame([("http://aab.example.com/x/y.html?p=1&q=2#f", 0)], "url string, blocked int")).first()
    text = row.url
    entropy = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))
    assert abs(row.entropy - entropy) < 1e-9 and (row.depth, row.parameters, row.labels, row.extension, row.suffix) == (2, 2, 2, 1, "example.com")
    rng = random.Random(3)
    rows = [(i, f"http://{'win-bets' if bad else 'news'}{rng.randint(0, 9)}.h{i % 7}.{'xyz' if bad else 'com'}/{'9' * 9 if bad else 'a'}/{i}", int(bad)) for i in range(600) for bad in [rng.random() < 0.4]]
    pages = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    got = {r.page_id: r.verdict for r in urls.judge(pages, pages.where("page_id % 3 <> 0"), RULES[4:]).collect()}
    assert len(got) == 600 and sum((got[i] == "block") == bool(b) for i, _, b in rows if i % 3 == 0) >= 195
    none = urls.judge(spark.createDataFrame([(1, None)], "page_id long, url string"), spark.createDataFrame([], "url string, blocked int"), RULES).first()
    assert (none.host, none.path, none.rule, none.verdict) == ("", "", None, "allow")


def test_url_suffix_shares_are_cross_fitted(spark):
    """A labelled row's suffix share leaves out its own fold, so the only row of a suffix learns nothing from itself."""
    labelled = spark.createDataFrame([(i, f"http://a.s{i}.com/{i}", i % 2) for i in range(40)] + [(100 + i, f"http://b.same.com/{i}", 1) for i in range(50)], "page_id long, url string, blocked int")
    known = urls.block_counts(labelled, ("suffix",))
    rows = urls.lexical(labelled.select("page_id", "url")).withColumn("fold", urls.fold_of(labelled))
    got = urls.with_share(rows, known, ("suffix",), "fold").collect()
    assert all(r.suffix_block_rate == 0.5 for r in got if r.page_id < 100)
    own = {k: sum(r.fold == k for r in got if r.page_id >= 100) for k in range(urls.FOLDS)}
    assert all(abs(r.suffix_block_rate - (51 - own[r.fold]) / (52 - own[r.fold])) < 1e-12 for r in got if r.page_id >= 100)


def planted_urls(spark, n, seed, hidden):
    """Blocked: section en of .com and es of .org, or any long run of digits; the share `hidden` of all labels is taken off."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        suffix, part, digits = rng.choice(["com", "net", "org"]), rng.choice(["en", "de", "es"]), rng.random() < 0.15
        bad = (suffix, part) in (("com", "en"), ("org", "es")) or digits
        rows.append((i, f"http://h{rng.randint(0, 30)}.site.{suffix}/{part}/{rng.randint(10**11, 10**12) if digits else rng.choice(['a', 'about', 'news'])}", int(bad), None if rng.random() < hidden else int(bad)))
    return spark.createDataFrame(rows, "page_id long, url string, truth int, blocked int")


def test_url_labels_that_no_suffix_tells(spark):
    """Each suffix has blocked and other URLs, and half of the labels are missing; verdicts don't turn with the size."""
    for n in (600, 2_400):
        pages = planted_urls(spark, n, seed=n, hidden=0.5)
        got = {r.page_id: r.verdict == "block" for r in urls.judge(pages, pages.select("page_id", "url", "blocked"), []).collect()}
        rows = [r for r in pages.collect() if r.blocked is None]
        hit = sum(got[r.page_id] and r.truth for r in rows)
        assert hit >= 0.9 * sum(r.truth for r in rows) and hit >= 0.9 * sum(got[r.page_id] for r in rows)


def test_url_held_out_by_suffix(spark):
    """The report counts one fold's labelled rows, by suffix, as the verdicts of trees that never saw them."""
    labelled = planted_urls(spark, 1_500, seed=9, hidden=0.3).select("page_id", "url", "blocked")
    got = {r.kind: r for r in urls.held_out(labelled, F.substring_index("host", ".", -1)).collect()}
    told = labelled.where((urls.fold_of(labelled) == 1) & F.col("blocked").isNotNull())
    assert sum(r.n for r in got.values()) == told.count() and sorted(got) == ["com", "net", "org"]
    assert all(r.found >= 0.85 * r.blocked and r.found >= 0.85 * r.flagged for r in got.values())


def test_url_sections(spark):
    cases = {"/en/7": "en", "/EN": "en", "/": "empty", "": "empty", "/123/x": "digits", "/about": "word", "/a-b": "other", "/\u00e9\u00e9/": "other"}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", urls.section(F.col("p")).alias("s"))
    assert {r.p: r.s for r in df.collect()} == cases


def test_url_odd_rows(spark):
    """Null urls and ids, repeated rows and clashing names each give a row; an empty table none."""
    kinds = "page_id long, url string, score int, label int, suffix string"
    rows = [(None, None, 1, 1, "k"), (1, "http://a.com/en/x", 1, 1, "k"), (1, "http://a.com/en/x", 1, 1, "k"), (2, "", 1, 1, "k"), (3, "http://q.org/" + "x" * 100_000, 1, 1, "k")]
    pages = spark.createDataFrame(rows, kinds)
    got = urls.judge(pages, urls.labelled_by_rules(pages, RULES), RULES).collect()
    assert sorted((r.page_id, r.host, r.rule, r.verdict) for r in got if r.page_id) == [(1, "a.com", "com/en/", "block")] * 2 + [(2, "", None, "allow"), (3, "q.org", None, "allow")]
    assert len(got) == 5 and urls.judge(pages.limit(0), pages.limit(0).selectExpr("page_id", "url", "label AS blocked"), RULES).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rows, labels = corpus(seed=5, n=400)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("mnopqrst") for _ in range(6))
    plain = [word() for _ in range(80)]
    item = [word() for _ in range(20)]
    lines = "\n".join(" ".join(word() for _ in range(20)) for _ in range(3))
    extra = {1000: " ".join(plain), 1001: " ".join(plain[:-1]), 1002: "start " + " ".join(item), 1003: f"first\n{lines}\nend", 1004: f"second\n{lines}\nother", 1005: "you idiot moron zzkrat " + " ".join(plain[::-1])}
    rows += [(i, t, "en", "s", len(t)) for i, t in extra.items()]
    d = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{d}/{name.replace(' ', '_')}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == list(P.COLUMNS) or name == "best-fit packing"
    toxic = {i for i, _, t in labels if t} | {1005}
    gone = {i for i, *_ in rows} - set(kept["toxicity"])
    assert 1005 in gone and len(gone ^ toxic) <= 8
    assert kept["line dedup"][1003].text == extra[1003] and kept["line dedup"][1004].text == "second\nother" and kept["line dedup"][1004].n_chars == 12
    assert set(kept["toxicity"]) == set(kept["line dedup"])
    assert set(kept["line dedup"]) - set(kept["n-gram Jaccard join"]) == {1001}
    assert set(kept["n-gram Jaccard join"]) - set(kept["benchmark decontamination"]) == {1002}
    assert set(kept["best-fit packing"]) == set(kept["benchmark decontamination"])
    assert P.run(spark, d).count() == docs.count()


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, columns of the operators' own names and empty tables go through every stage."""
    import corpus_pipeline as P

    d = f"file://{tmp_path}/odd"
    names = "score double, row int, ref long, th long, cut int, fp string, pack int, n int"
    rows = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", None, "s", 0), (3, "few words", "en", None, 9), (3, "few words", "en", None, 9), (None, "few words", "en", "s", 9), (4, "few words", "en", "s", 9)]
    docs = spark.createDataFrame([(*r, 0.9, 1, 2, 3, 4, "f", 5, 6) for r in rows], f"{DOCS}, {names}")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    kept = []
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == list(P.COLUMNS) and stage(spark, docs.limit(0), d).count() == 0
        kept.append(sorted((r.doc_id for r in out.collect()), key=str))
    every = sorted((r[0] for r in rows), key=str)
    assert kept == [every, every, [x for x in every if x != 4], every]
    packed = P.STAGES[-1][1](spark, docs, d).collect()
    assert sorted((r.doc_id for r in packed), key=str) == every and P.STAGES[-1][1](spark, docs.limit(0), d).count() == 0
