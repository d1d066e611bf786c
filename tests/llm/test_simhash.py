"""SimHash classes against all pairs, and the index against every distance."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scholarframe.llm import simhash


def brute_print(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_classes(rows, most=4):
    prints, at = [brute_print(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, (doc, _) in enumerate(rows):
        for j in range(i):
            if doc is not None and rows[j][0] is not None and (doc == rows[j][0] or (prints[i] ^ prints[j]).bit_count() <= most):
                at[find(i)] = find(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{prints[i]:016x}", None if doc is None else least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def crowd(rng, many, flips, bits=64):
    """Fingerprints around one, and some anywhere."""
    centre = rng.getrandbits(64)
    near = [centre ^ sum({1 << rng.randrange(bits) for _ in range(rng.randint(0, flips))}) for _ in range(many)]
    return np.unique(np.array(near + [rng.getrandbits(64) for _ in range(many // 4)], np.uint64))


def all_links(members, most):
    distance = np.bitwise_count(members[:, None] ^ members[None, :])
    return {(i, j) for i, j in zip(*np.nonzero(distance <= most), strict=True) if i < j}


@pytest.mark.parametrize(("many", "flips", "fan", "frontier"), [(0, 0, 2, 8), (3, 1, 2, 8), (60, 3, 2, 5), (200, 6, 4, 64), (300, 9, 16, 100), (700, 12, 16, 1 << 16)])
def test_tree_meets_every_link_once(many, flips, fan, frontier):
    members = crowd(random.Random(many), many, flips)
    members = members[np.argsort(simhash.gray_rank(members))]
    for most in (0, 1, 4):
        got = [(i, j) for q, n in simhash.search(members, most, fan, frontier) for i, j in zip(q, n, strict=True)]
        assert len(got) == len(set(got)) and set(got) == all_links(members, most)


def test_gray_rank():
    codes = np.array([i ^ i >> 1 for i in range(1000)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(1000))


def _parts(pairs, members):
    at = {m: m for m in members}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        at[find(a)] = find(b)
    groups: dict = {}
    for m in members:
        groups.setdefault(find(m), []).append(m)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(("seed", "flips", "most", "leaf"), [(1, 8, 4, 64), (2, 14, 4, 32), (3, 6, 2, 40), (4, 6, 3, 100), (5, 6, 4, 4096)])
def test_split_nodes_lose_no_link(spark, seed, flips, most, leaf):
    """Crowds far larger than a leaf, cut again and again: the links connect what all pairs connect."""
    members = crowd(random.Random(seed), 600, flips).view(np.int64).tolist()
    fps = spark.createDataFrame([(m,) for m in members], "fp long").repartition(3)
    got = [(r.a, r.b) for r in simhash.links(fps, most, leaf).collect()]
    unsigned = np.array(members, np.int64).view(np.uint64)
    want = [(members[i], members[j]) for i, j in all_links(unsigned, most)]
    assert _parts(got, members) == _parts(want, members)


def test_a_leaf_gives_stars():
    rng = random.Random(9)
    members = np.unique(np.array([rng.getrandbits(12) for _ in range(900)], np.uint64))  # nearly all linked
    a, b = simhash.stars(members, 4)
    assert len(a) == len(members) - 1 and len(set(a.tolist())) == 1
    with pytest.raises(ValueError):
        simhash.links(None, 4, 8)


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 3000)
    rows = []
    for _ in range(8):
        own = [word() for _ in range(rng.randint(60, 400))]
        for _ in range(rng.choice([1, 3, 15])):
            copy = list(own)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", None, " \n", "A b", "a  B\n", "a b c", "x y z q", "x y z Q", "one", "one ", "é 日本 x\x0by z", "one " * 40000, "日本語" * 30000]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("leaf", [32, 4096])
def test_classes_brute(spark, leaf):
    rows = near_copies(leaf) + [(None, "one"), (None, None), (5, "one more row of five"), (5, "and another")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, node int").repartition(3)
    got = simhash.simhash_classes(df, leaf=leaf).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows)


def test_empty_table_and_hash(spark):
    assert simhash.simhash_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    texts = ["", "a", "a b c d", "日本語 é", "x" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(r.t.encode(), 42) for r in got)
