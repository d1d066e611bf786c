"""Dispatch by kinds of calls and sources against a fold over all calls."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from scholarframe.operators import dispatch
from tests import test_dispatch as one_by_one

CALLS, SOURCES = "call_id long, pool string, ord long, tokens long, kind long", "pool string, source_id long, rank int, remaining long, kind long"
ANSWERS = one_by_one.ANSWERS


def answered(call, source):
    kind = (F.coalesce(call, F.lit(5)) * 7 + F.coalesce(source, F.lit(2)) * 3) % 10
    return F.element_at(F.array(*(F.lit(x).cast("int") for x in ANSWERS)), (kind + 1).cast("int"))


def check(spark, monkeypatch, calls, sources):
    kinds, theirs = {c[0]: c[4] for c in calls}, {s[1]: s[4] for s in sources}
    of = lambda held, key, none: none if held[key] is None else held[key]
    monkeypatch.setattr(one_by_one, "answer", lambda call, source: ANSWERS[(of(kinds, call, 5) * 7 + of(theirs, source, 2) * 3) % 10])
    out = dispatch.dispatch_kinds(spark.createDataFrame(calls, CALLS), spark.createDataFrame(sources, SOURCES), answered)
    assert out.columns == ["call_id", "pool", "source_id", "outcome", "attempts", "status"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = one_by_one.fold(calls, [s[:4] for s in sources])
    assert got == want, [(g, w) for g, w in zip(got, want, strict=False) if g != w][:5]
    return got


def test_kinds_are_the_fold(spark, monkeypatch):
    """Stretches far shorter than the queues; caps of nothing, little and much; null pools, kinds and tokens; pools without sources or with spent ones only."""
    monkeypatch.setattr(dispatch, "STEP", 8)
    monkeypatch.setattr(dispatch, "LONG_CHUNK", 20)
    rng = random.Random(12)
    pools = ["hot"] * 8 + ["a", "b", "spent", "no sources", None]
    calls = [(i, rng.choice(pools), rng.randint(0, 300), rng.choice([None, -4, 0, 1, 5, 9, 30]), rng.choice([None, *range(6)])) for i in range(700)]
    caps = {"hot": [0, 500, 40, 900, 7, 1, 60, None, 300, 80], "a": [30, 25, 4000], "b": [None, 5], "spent": [0, -3]}
    sources = [(p, 20 * k + j, j, cap, rng.choice([None, 0, 1, 2, 3, 7])) for k, (p, held) in enumerate(caps.items(), 1) for j, cap in enumerate(held, 1)]
    got = check(spark, monkeypatch, calls, sources)
    assert {r[3] for r in got} == {"served", "error", "fallback"}


def test_no_attempt_is_made_one_by_one(spark, monkeypatch):
    """3,000 sources that send most calls on, then one that serves: a few tables, few rounds, and attempts are counted."""
    calls = [(i, "p", i, 1, i % 3) for i in range(6_000)]
    sources = [("p", j, j, 10_000, 5 if j < 3_000 else 6) for j in range(1, 3_001)]
    tables, settle = [], dispatch.settle
    monkeypatch.setattr(dispatch, "settle", lambda df, name="table": tables.append(name) or settle(df, name))
    got = check(spark, monkeypatch, calls[:60], sources[-40:])
    out = dispatch.dispatch_kinds(spark.createDataFrame(calls, CALLS), spark.createDataFrame(sources, SOURCES), answered)
    assert out.agg(F.max("attempts")).first()[0] == 3_000 and max(r[4] for r in got) == 40 and len(tables) < 40


def test_kinds_of_nothing(spark, monkeypatch):
    assert check(spark, monkeypatch, [], [("a", 1, 1, 5, 1)]) == []
    check(spark, monkeypatch, [(1, None, 1, 1, 1), (2, "a", 3, 1, 2)], [])
    check(spark, monkeypatch, [(4, "a", 1, 3, 1)] * 3, [("a", 1, 1, 5, 0)])
