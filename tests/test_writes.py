"""Grants on top of grants, guarded upserts of works, and seeds of graphs, on small inputs."""

from __future__ import annotations

import random

import pytest

from scholarframe.operators import graph, ledger, library


def one_by_one(items, granted, threshold, base, review):
    """The contributions of each user in turn, as one loop."""
    held, out, index = set(granted), [], {}
    for user in {u for u, *_ in items}:
        index[user] = sum(u == user and k.startswith("work:") and (u, k) not in {(a, f"work:{c}") for a, _, c, _ in items} for u, k in granted)
        for _, kind, ident, _ in sorted((r for r in items if r[0] == user), key=lambda r: (r[3], r[2])):
            key = f"{'work' if kind == 'publication' else 'review'}:{ident}"
            past = index[user] - threshold + 1
            index[user] += kind == "publication"
            if (user, key) not in held:
                held.add((user, key))
                out.append((user, key, kind, review if kind == "peer_review" else base if past <= 0 else max(1, int(base / 2 ** min(past, 6) + 0.5))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_grants_on_top_of_grants(spark, seed):
    rng = random.Random(seed)
    items = [(rng.randint(0, 2), rng.choice(["publication", "publication", "peer_review"]), f"i{k}", k) for k in range(60)]
    run = lambda rows, had: sorted(map(tuple, ledger.contribution_grants(spark.createDataFrame(rows, "user_id int, kind string, id string, ord int"), spark.createDataFrame(had, "user_id int, key string"), 3, 40, 10).collect()))
    whole = run(items, [])
    assert whole == one_by_one(items, [], 3, 40, 10)
    first = run(items[:25], [])
    had = [(u, k) for u, k, *_ in first]
    assert sorted(first + run(items[25:], had)) == whole  # only what is new is listed
    assert run(items, had) == one_by_one(items, had, 3, 40, 10) == sorted(set(whole) - set(first))  # all is listed again
    again = [*items[:5], items[2], items[3]]
    assert run(again, []) == one_by_one(again, [], 3, 40, 10)
    assert run(items, [(u, k) for u, k, *_ in whole]) == []


def test_only_the_same_work_is_overwritten(spark):
    schema = "work_key string, abstract string, seen int"
    old = spark.createDataFrame([("doi:1", "alpha beta gamma", 0), ("hash:1", "alpha beta gamma", 0), ("hash:2", "alpha beta gamma", 0), ("hash:3", None, 0), ("hash:9", "kept", 0)], schema)
    new = [("doi:1", "other words here", 1), ("hash:1", "other words here", 1), ("hash:2", "alpha beta delta", 1), ("hash:3", "now told", 1), ("hash:4", "first", 1), ("hash:4", "second", 2)]
    works, refused = library.upsert_works(old, spark.createDataFrame([(*r, r[2]) for r in new], f"{schema}, ord int"), "ord")
    assert {r.work_key: (r.abstract, r.seen) for r in works.collect()} == {"doi:1": ("other words here", 1), "hash:1": ("alpha beta gamma", 0), "hash:2": ("alpha beta delta", 1), "hash:3": ("now told", 1), "hash:4": ("second", 2), "hash:9": ("kept", 0)}
    assert works.count() == 6 and [r.work_key for r in refused.collect()] == ["hash:1"]


def test_seeds_by_entry(spark):
    works = spark.createDataFrame([(f"w{k}", f"T{k}") for k in range(40) if k != 5], "work_key string, title string")
    rows = [("work", "a", "w3", 0), ("work", "b", "w5", 0), ("collection", "c", "w7", 2), ("collection", "c", "w6", 1), ("collection", "c", "w7", 0), ("other", "x", "w1", 0)]
    rows += [("library", "u", f"w{k}", -k) for k in range(40)]
    got = graph.seeds(spark.createDataFrame(rows, "entry string, owner string, work_key string, ord int"), works, {"work": 1, "collection": None, "library": graph.SEEDS}).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.position):
        by.setdefault((r.entry, r.owner), []).append(r.work_key)
    assert by == {("work", "a"): ["w3"], ("collection", "c"): ["w7", "w6"], ("library", "u"): [f"w{k}" for k in range(39, 19, -1)]}
