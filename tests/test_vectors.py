"""Nearest vectors by cells against a full scan, and how much of it is skipped."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import Observation

from scholarframe.operators import vectors


def brute(rows, seeds, k, among=None):
    """By the full scan, in the same order: rounded cosine, then key."""
    units = {}
    for model, key, v in rows:
        x = np.array(v if v else [0.0], float)
        units.setdefault(model, {})[key] = x / n if (n := np.linalg.norm(x)) > 0 and len(x) == 6 else None
    out = []
    for model, seed in seeds:
        own = units[model][seed]
        near = []
        for key, x in units[model].items():
            if key != seed and (among is None or key in among):
                near.append((-round(float(own @ x), 6) if own is not None and x is not None else 0.0, key))
        out += [(model, seed, key, round(-s, 6) + 0.0, i + 1) for i, (s, key) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    out = [(i % 2, i, (centres[i % 12] + rng.normal(size=6) * 0.05).tolist()) for i in range(1500)]
    out += [(0, 2000, out[0][2]), (0, 2001, out[0][2]), (0, 2002, [0.0] * 6), (1, 2003, None), (1, 2004, []), (0, 2005, [1.0, 2.0])]
    return out


@pytest.mark.parametrize(("cells", "k"), [(1, 3), (8, 7), (32, 10), (32, 900)])
def test_equal_to_a_full_scan(spark, rows, cells, k):
    seeds = [(0, 0), (1, 1), (0, 10), (1, 777), (0, 2000), (0, 2002), (1, 2003)]
    index = vectors.build(spark.createDataFrame(rows, "model int, key long, vector array<double>").repartition(3), cells)
    asked = spark.createDataFrame(seeds, "model int, seed long")
    got = vectors.nearest(index, asked, k).collect()
    assert sorted((r.model, r.seed, r.key, r.similarity + 0.0, r["rank"]) for r in got) == brute(rows, seeds, k)


def test_cells_are_skipped_and_works_chosen_first(spark, rows):
    index = vectors.build(spark.createDataFrame(rows, "model int, key long, vector array<double>"), 12)
    seeds = [(i % 2, i) for i in range(0, 1500, 100)]
    asked = spark.createDataFrame(seeds, "model int, seed long")
    counted = Observation()
    got = vectors.nearest(index, asked, 5, counted=counted).collect()
    assert sorted((r.model, r.seed, r.key, r.similarity + 0.0, r["rank"]) for r in got) == brute(rows, seeds, 5)
    assert counted.get["compared"] < 0.5 * len(seeds) * len(rows) / 2
    among = {k for _, k, _ in rows if k % 7 == 3}
    works = spark.createDataFrame([(k,) for k in among] * 2 + [(-1,)], "key long")
    got = vectors.nearest(index, asked, 5, among=works).collect()
    assert sorted((r.model, r.seed, r.key, r.similarity + 0.0, r["rank"]) for r in got) == brute(rows, seeds, 5, among)
    none = vectors.build(spark.createDataFrame([], "model int, key long, vector array<double>"))
    assert vectors.nearest(none, asked, 5).count() == 0


def test_equal_to_a_full_scan_in_many_small_blocks(spark, rows, monkeypatch):
    for name, value in (("BLOCK", 40), ("PRODUCTS", 300), ("PAIRS", 7)):
        monkeypatch.setattr(vectors, name, value)
    seeds = [(i % 2, i) for i in range(0, 1500, 17)] + [(0, 2001), (0, 2002), (1, 2004)]
    index = vectors.build(spark.createDataFrame(rows, "model int, key long, vector array<double>"), 8)
    got = vectors.nearest(index, spark.createDataFrame(seeds, "model int, seed long"), 6).collect()
    assert sorted((r.model, r.seed, r.key, r.similarity + 0.0, r["rank"]) for r in got) == brute(rows, seeds, 6)


def test_a_block_gives_few_rows_a_seed():
    """Each seed met every row as a row of its own before; copies of one vector count by their first keys."""
    rng = np.random.default_rng(2)
    units = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 3000, 0), rng.normal(size=(3000, 8))])
    units /= np.linalg.norm(units, axis=1)[:, None]
    rows = pa.table({"key": np.arange(6000)[::-1], "unit": list(units)})
    asked = pa.table({"model": pa.array([1] * 200), "seed": np.arange(2900, 3100), "asked": list(units[::-1][2900:3100]), "least": [-2.0] * 200})
    got = vectors._block(asked, rows, 5, 8)
    assert 1000 <= len(got) <= 1300
    assert got.filter(pc.equal(got["seed"], 3050))["key"].to_pylist()[:5] == [3000, 3001, 3002, 3003, 3004]
