"""Periodic runs against their definition, word by word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from scholarframe.llm import periodic


def brute_runs(words):
    """Every stretch that is long enough for its smallest period, if neither neighbour extends it."""
    n, out = len(words), []
    fits = lambda s, e, q: all(words[i] == words[i + q] for i in range(s, e - q))
    for s in range(n):
        for e in range(s + 6, n + 1):
            q = next(q for q in range(1, e - s + 1) if fits(s, e, q))
            if e - s >= max(6, 4 * q) and not (s and words[s - 1] == words[s - 1 + q]) and not (e < n and words[e] == words[e - q]):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_definition(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = [rng.choice("ab" if seed % 2 else "abc") for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            loop = [rng.choice("abc") for _ in range(rng.randint(1, 4))]
            words += (loop * 7)[: rng.randint(0, 26)] + [rng.choice("abcd") for _ in range(rng.randint(0, 3))]
        words = words[:60]
        ids = periodic.word_ids([w.encode() for w in words])
        assert periodic.find_runs(ids) == periodic.find_runs(ids, 0) == brute_runs(words)


def test_long_lags_with_and_without_probe():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 900, 5000)
    planted = []
    for start, q, times in ((100, 70, 4.5), (700, 301, 4.0), (2300, 1, 40), (2500, 128, 9.3)):
        length = int(q * times)
        ids[start : start + length] = np.resize(ids[start : start + q] if q > 1 else [901], length)
        ids[start - 1] = ids[start + length] = 5000 + start  # neither end extends
        planted.append((start, length, q))
    ids = np.unique(ids, return_inverse=True)[1]
    assert periodic.find_runs(ids) == periodic.find_runs(ids, 100) == planted
    assert periodic.find_runs(np.zeros(3000, np.int64)) == periodic.find_runs(np.zeros(3000, np.int64), 0) == [(0, 3000, 1)]


def test_digests_and_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "日本 日本 日本 日本  日本 日本 日本", "x " * 3000, " ".join(f"w{i % 1500}" for i in range(7000))]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + "\x0b\x0cz" for _ in range(120)]
    rows = [(i, t, "r") for i, t in enumerate(texts)] + [(None, "b b b b b b b c", "r"), (5, "again again", "r"), (5, "again again", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = periodic.digests(periodic.periodic_runs(df.select("doc_id", periodic.looped(df.text, df.doc_id).alias("text"), "runs"))).collect()
    want = []
    for key, text, _ in rows:
        words = words_of(text)
        h = zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words) if len(words) < 100 else periodic.find_runs(periodic.word_ids([w.encode() for w in words]))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digests(periodic.periodic_runs(empty)).count() == 0
