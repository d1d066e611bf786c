"""Fill-in-the-middle against a list of units, and its round trip."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from scholarframe.llm import fill_middle


def brute(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "a", "ab", " ", "\x01", "\x02", "\x02\x03", "\x02\x04\x01\x02", "<P>", "x <S> y", "<M", "<<", "P>S>", "<", "日本 語\n\té", "😀a😀b", "$0 \\1 $", "abc" * 20000, "word " * 30000, "\x01\x02" * 5000]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    mixed = ["".join(rng.choice("ab<PSM> \x01\x02\x03\x04\n😀é1") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts = ODD * 4 + mixed
    return [(i - 20, t) for i, t in enumerate(texts)] + [(None, "no id here"), (7, "twice"), (7, "twice"), (7, "other")]


def test_every_form_brute(spark, rows):
    df = spark.createDataFrame([(k, t, "f", 3) for k, t in rows], "doc_id long, text string, form string, n int").repartition(3)
    got = fill_middle.fill_middle(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(k, t) for k, t in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back_from_output_and_form(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = fill_middle.digests(fill_middle.fill_middle(df)).collect()
    want = [(*brute(k, t)[:5], sha(brute(k, t)[5]), sha(t or "")) for k, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = fill_middle.digests(fill_middle.fill_middle(df))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
