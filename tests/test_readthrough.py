"""Read-through caches: each miss is computed once, and only misses are."""

from __future__ import annotations

import os

import pytest

from scholarframe.operators import readthrough


def counting(folder):
    """A callable that leaves a file of the texts of each of its calls."""

    def compute(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write("\x00".join(texts))
        return [[float(len(t))] for t in texts]

    return compute


def calls(folder):
    return [open(f"{folder}/{f}").read().split("\x00") for f in os.listdir(folder)]


def test_misses_are_computed_once(spark, tmp_path):
    items = [(f"k{i % 40}", f"text {i % 40}", i) for i in range(200)] + [(None, "no key", 900), ("k99", None, 901)]
    cache = [(f"k{i}", "m", [-float(i)]) for i in range(10)] + [("k3", "m", [7.0]), ("k20", "other", [5.0])]
    items, cache = spark.createDataFrame(items, "key string, text string, place int").repartition(5), spark.createDataFrame(cache, "key string, model string, value array<double>")
    read = readthrough.read_through(items, cache, "m", counting(tmp_path), batch=4)
    rows = {r.place: r for r in read.rows.collect()}
    read.rows.count(), read.added.count()  # nothing is computed again
    asked = [t for call in calls(tmp_path) for t in call]
    assert sorted(asked) == sorted([f"text {i}" for i in range(10, 40)] + [""]) and max(map(len, calls(tmp_path))) <= 4
    assert len(rows) == 202 and rows[900].value is None and rows[901].value == [0.0]
    assert all((rows[i].value, rows[i].cached) == (([-float(i % 40)], True) if i % 40 < 10 else ([float(len(f"text {i % 40}"))], False)) for i in range(200))
    again = readthrough.keep_new(cache, read.added.union(read.added))
    assert again.where("model = 'm'").groupBy("key").count().where("count > 1").count() == 1  # k3 came twice
    assert readthrough.keep_new(again, read.added).count() == again.count() == 12 + 31
    once = readthrough.read_through(items, again, "m", counting(tmp_path))
    assert once.added.isEmpty() and sorted(t for call in calls(tmp_path) for t in call) == sorted(asked)


def test_empty_tables_and_bad_callables(spark):
    cache = spark.createDataFrame([], "key string, model string, value string")
    items = spark.createDataFrame([], "key string, text string")
    assert readthrough.read_through(items, cache, "m", lambda t: t).rows.count() == 0
    with pytest.raises(Exception, match="gave 0 values"):
        readthrough.read_through(spark.createDataFrame([("a", "b")], "key string, text string"), cache, "m", lambda t: [])
