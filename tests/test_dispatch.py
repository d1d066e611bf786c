"""Dispatch over ranked sources against a fold over all calls."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from scholarframe.operators import dispatch

ANSWERS = [200, 200, 200, 204, 429, 500, 400, 401, None, 404]
CALLS, SOURCES = "call_id long, pool string, ord long, tokens long, status string", "pool string, source_id long, rank int, remaining long"


def answer(call: int, source: int):
    return ANSWERS[(call * 7 + source * 3 + call // 10) % 10]


def answered(call, source):
    kind = (call * 7 + source * 3 + F.floor(call / 10)) % 10
    return F.element_at(F.array(*(F.lit(x).cast("int") for x in ANSWERS)), (kind + 1).cast("int"))


def fold(calls, sources):
    left = {(p, s): r for p, s, _, r in sources}
    out = []
    for call, pool, _, tokens, _ in sorted(calls, key=lambda c: (c[2], c[0])):
        end, attempts, last = (None, "fallback"), 0, None
        for p, source, _, _ in sorted((s for s in sources if s[0] == pool), key=lambda s: s[2]):
            if left[p, source] is not None and left[p, source] <= 0:
                continue
            attempts, last = attempts + 1, answer(call, source)
            if last is not None and last < 400:
                if left[p, source] is not None:
                    left[p, source] -= max(tokens or 0, 0)
                end = (source, "served")
                break
            if last is not None and last < 500 and last not in (401, 402, 403, 429):
                end = (source, "error")
                break
        out.append((call, pool, *end, attempts, last))
    return sorted(out, key=repr)


def told(spark, calls, sources):
    out = dispatch.dispatch(spark.createDataFrame(calls, CALLS), spark.createDataFrame(sources, SOURCES), answered)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_dispatch_is_the_fold(spark):
    """One pool has most calls; caps of none, nothing, little and much; equal times; calls that cost nothing."""
    rng = random.Random(4)
    pools = ["hot"] * 12 + ["a", "b", "no sources"]
    calls = [(i, rng.choice(pools), rng.randint(0, 300), rng.choice([None, -4, 0, 1, 5, 9, 30]), "x") for i in range(1_500)]
    sources = [(p, 10 * k + j, j, cap) for k, (p, caps) in enumerate({"hot": [0, 500, 40, 900, 700, 1, None, 60], "a": [30, 25], "b": [None]}.items(), 1) for j, cap in enumerate(caps, 1)]
    got = told(spark, calls, sources)
    assert got == fold(calls, sources)
    assert {r[3] for r in got} == {"served", "error", "fallback"} and max(r[4] for r in got) >= 3


def test_dispatch_odd_rows(spark):
    """Null pools, repeated calls, no calls, no sources."""
    assert told(spark, [], [("a", 1, 1, 5)]) == []
    assert told(spark, [(1, None, 1, 1, "x"), (2, "a", None, 1, "x")], []) == [(1, None, None, "fallback", 0, None), (2, "a", None, "fallback", 0, None)]
    call = next(i for i in range(100) if answer(i, 1) == 200)
    assert told(spark, [(call, "a", 1, 3, "x")] * 3, [("a", 1, 1, 5)]) == sorted([(call, "a", 1, "served", 1, 200)] * 2 + [(call, "a", None, "fallback", 0, None)], key=repr)


def test_ranks_in_pools(spark):
    rows = [(f"p{i % 3 if i % 2 else 0}", i, 1_000 - i, None) for i in range(200)]
    got = dispatch.ranked_in_pools(spark.createDataFrame(rows, SOURCES)).collect()
    want = {p: sorted((r for r in rows if r[0] == p), key=lambda r: r[2]) for p in {r[0] for r in rows}}
    assert {r.source_id: r.rank for r in got} == {row[1]: k for all_ in want.values() for k, row in enumerate(all_, 1)}
