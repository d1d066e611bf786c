"""Exact nearest vectors of many seeds, by coarse cells and triangle bounds.

Vectors are scaled to length one, where the order by cosine is the order by distance.  Centres of cells are fitted on a bounded sample, every
row goes to the cell of its nearest centre and keeps its distance r to it.  For a seed at distance d from a centre, a row of the
cell is at least |d - r| away.  The seed's own cell is searched first; the k-th similarity found there, a bound that the
k best of all can only better, rules out whole cells by their smallest and largest r, and rows of the others by their own.
What is left is compared by blocks of rows and seeds, as matrix products, so the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from scholarframe.plans.tables import settle

#: Rows that centres are fitted on, at most about so many; cells; rounds of fitting.
SAMPLE_ROWS, CELLS, ROUNDS = 8192, 32, 8
#: Similarities are rounded to so many digits before rows are ranked; ties go by key.
DIGITS = 6
#: Rows of a cell, and seeds, that one group compares, more or less; products, and candidate pairs, held at once.
BLOCK, PRODUCTS, PAIRS = 16_384, 1 << 21, 1 << 16


@dataclass
class Index:
    """rows: model, key, unit (array<double>), cell, r; cells: model, cell, lo, hi, many; centres of the cells from 0.  Cell -1 has the vectors without a direction."""

    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray


def _units(column: pa.Array) -> list[np.ndarray | None]:
    out = []
    for values in column.to_pylist():
        x = np.array([np.nan if v is None else v for v in values or []], np.float64)
        norm = np.sqrt((x * x).sum())
        out.append(x / norm if len(x) and np.isfinite(norm) and norm > 0 else None)
    return out


def fit_centres(units: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of about even cells: farthest points of the sample, moved to their rows' means some times."""
    if not len(units):
        return np.empty((0, 0))
    chosen = [0]
    near = ((units - units[0]) ** 2).sum(1)
    while len(chosen) < min(cells, len(units)) and near.max() > 1e-12:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((units - units[chosen[-1]]) ** 2).sum(1))
    centres = units[chosen]
    for _ in range(rounds):
        own = (units @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        centres = np.array([units[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _placed(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, dists, units = [], [], []
        for unit in _units(batch.column("vector")):
            if unit is None or not len(centres) or len(unit) != centres.shape[1]:
                cells.append(-1), dists.append(0.0), units.append(None)
                continue
            far = np.sqrt(np.maximum(((centres - unit) ** 2).sum(1), 0))
            cells.append(int(far.argmin())), dists.append(float(far.min())), units.append(unit.tolist())
        yield pa.record_batch([batch.column("model"), batch.column("key"), pa.array(units, pa.list_(pa.float64())), pa.array(cells, pa.int32()), pa.array(dists, pa.float64())], ["model", "key", "unit", "cell", "r"])


def build(vectors: DataFrame, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS) -> Index:
    """An index of vectors (model, key long, vector array); the centres come from a sample of rows, the cells hold all.

    Vectors that are null, empty, zero, not finite or of another length than the sample's first have no direction: their similarity to anything is 0."""
    spark = vectors.sparkSession
    vectors = vectors.select("model", F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    share = min(1.0, sample_rows / max(1, vectors.count()))
    drawn = vectors.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("key").limit(2 * sample_rows).select("vector").toArrow().column("vector").combine_chunks()
    units = [u for u in _units(drawn) if u is not None]
    units = np.array([u for u in units if len(u) == len(units[0])]) if units else np.empty((0, 0))
    centres = fit_centres(units, cells)
    held = spark.sparkContext.broadcast(centres)  # cells x dimensions, whatever the table
    rows = settle(vectors.mapInArrow(lambda it: _placed(it, held.value), _schema(vectors)), "cells")
    told = settle(rows.groupBy("model", "cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("many")), "cell-sizes")
    return Index(rows, told, centres)


def _schema(vectors: DataFrame) -> str:
    return f"model {dict(vectors.dtypes)['model']}, key long, unit array<double>, cell int, r double"


def _asked(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each seed and cell, with the seed's distance from the cell's centre."""
    for batch in batches:
        units = batch.column("unit").to_pylist()
        many = len(centres) + 1
        at = np.repeat(np.arange(len(units)), many)
        far = np.array([0.0 if c < 0 or u is None else float(np.sqrt(((centres[c] - np.array(u)) ** 2).sum())) for u in units for c in range(-1, len(centres))])
        yield pa.record_batch([batch.column("model").take(pa.array(at)), batch.column("key").take(pa.array(at)), batch.column("unit").take(pa.array(at)), batch.column("cell").take(pa.array(at)), pa.array(np.tile(np.arange(-1, len(centres), dtype=np.int32), len(units))), pa.array(far)], ["model", "seed", "asked", "home", "cell", "d"])


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of an array column; those that are null, vectors without a direction, are zeros."""
    held = column.is_valid().to_numpy().astype(bool)
    out = np.zeros((len(held), dims))
    out[held] = pc.list_flatten(column).to_numpy().reshape(-1, dims) if held.any() else 0.0
    return out


def _block(asked: pa.Table, rows: pa.Table, k: int, dims: int) -> pa.Table:
    """(model, seed, key, s): of a block of rows, each seed's k most similar and what may round to the same, by matrix products; s is summed in order."""
    keys = rows.column("key").to_numpy()
    rows = rows.take(np.argsort(keys, kind="stable"))
    keys, units = np.sort(keys, kind="stable"), _matrix(rows.column("unit"), dims)
    # Of equal vectors only those of the first keys can count; one of them may be the seed itself.
    _, group = np.unique(np.ascontiguousarray(units).view(f"V{8 * dims}").ravel() if dims else np.zeros(len(keys)), return_inverse=True)
    order = np.argsort(group, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys)) - np.searchsorted(group[order], group[order])
    keys, units = keys[place <= k], units[place <= k]
    seeds, vectors, least = asked.column("seed").to_numpy(), _matrix(asked.column("asked"), dims), asked.column("least").to_numpy()
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, PRODUCTS // max(1, len(keys)))
    for at in range(0, len(seeds), step):
        own, names = vectors[at : at + step], seeds[at : at + step]
        near = own @ units.T
        near[~own.any(1), k + 1 :] = -np.inf  # a seed without a direction is 0 similar to all, so keys decide
        near[names[:, None] == keys] = -np.inf
        bound = least[at : at + step] - 1e-9
        if len(keys) > k:
            bound = np.maximum(bound, np.partition(near, len(keys) - k, axis=1)[:, -k] - 10.0**-DIGITS - 1e-9)
        i, j = np.nonzero((near >= bound[:, None]) & (near > -np.inf))
        for part in range(0, len(i), PAIRS):
            x, y = i[part : part + PAIRS], j[part : part + PAIRS]
            s = np.cumsum(own[x] * units[y], axis=1)[:, -1] + 0.0 if dims else np.zeros(len(x))
            found.append((x + at, keys[y], s))
    x, key, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), keys[:0], np.empty(0))
    return pa.table({"model": asked.column("model").take(pa.array(x)), "seed": pa.array(seeds[x]), "key": pa.array(key), "s": pa.array(s)})


def _met(asked: DataFrame, rows: DataFrame, cells: DataFrame, k: int, dims: int, slots: int) -> DataFrame:
    """(model, seed, key, similarity): candidates among each seed's k best of the cells it asks, blocks of a cell's rows against slots of seeds."""
    parts = cells.select("model", "cell", F.ceil(F.col("many") / BLOCK).alias("parts"))
    dealt = rows.join(parts, ["model", "cell"]).withColumn("part", F.pmod(F.xxhash64("key"), "parts")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    asking = asked.join(parts, ["model", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("slot", F.pmod(F.xxhash64("seed"), F.lit(slots)).cast("int"))
    by = ["model", "cell", "part", "slot"]
    a, b = asking.select(*by, "seed", "asked", "least").groupBy(*by), dealt.select(*by, "key", "unit").groupBy(*by)
    kind = dict(rows.dtypes)["model"]
    out = a.cogroup(b).applyInArrow(lambda x, y: _block(x, y, k, dims), f"model {kind}, seed long, key long, s double")
    return out.select("model", "seed", "key", F.round("s", DIGITS).alias("similarity"))


def nearest(index: Index, seeds: DataFrame, k: int = 10, among: DataFrame | None = None, counted: Observation | None = None) -> DataFrame:
    """(model, seed, key, similarity, rank): each seed's k most similar rows of its model, without itself, by cosine rounded to DIGITS; ties by key.

    seeds has model and seed, keys of the index.  With `among` (key) only those rows are found, whether or not a seed is one of them: bounds of
    whole cells hold for a part of their rows, too.  `counted` observes `compared`, the pairs of the second search, in other cells."""
    own = index.rows.join(seeds.select("model", F.col("seed").alias("key")).distinct(), ["model", "key"], "left_semi")
    kind = dict(index.rows.dtypes)["model"]
    centres = index.rows.sparkSession.sparkContext.broadcast(index.centres)
    asked = settle(own.mapInArrow(lambda it: _asked(it, centres.value), f"model {kind}, seed long, asked array<double>, home int, cell int, d double"), "seeds")
    rows = index.rows if among is None else settle(index.rows.join(among.select("key").distinct(), "key", "left_semi").select(index.rows.columns), "among")
    dims = index.centres.shape[1]
    slots = max(1, -(-own.count() // BLOCK))
    # The seed's own cell gives a bound; a cell of k rows or fewer bounds nothing.
    home = settle(_met(asked.where("cell = home").withColumn("least", F.lit(-2.0)), rows, index.cells, k, dims, slots), "home")
    best = Window.partitionBy("model", "seed").orderBy(F.col("similarity").desc())
    bound = home.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("model", "seed", (F.col("similarity") - 2 * 10**-DIGITS).alias("least"))
    ruled = asked.where("cell <> home").join(settle(bound, "bounds"), ["model", "seed"], "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    # Rows of similarity `least` or more are within `reach`; those without a direction are 0 similar to all.
    reach = F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0))) + 1e-9
    cells = ruled.withColumn("reach", reach).join(index.cells, ["model", "cell"])
    undirected = (F.col("cell") < 0) | (F.col("home") < 0)
    cells = cells.where(F.when(undirected, F.col("least") <= 0).otherwise((F.col("d") - F.col("hi") <= F.col("reach")) & (F.col("lo") - F.col("d") <= F.col("reach"))))
    if counted is not None:
        cells = cells.observe(counted, F.coalesce(F.sum("many"), F.lit(0)).alias("compared"))
    scored = home.union(_met(cells.drop("lo", "hi", "many"), rows, index.cells, k, dims, slots))
    ranked = Window.partitionBy("model", "seed").orderBy(F.col("similarity").desc(), "key")
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
