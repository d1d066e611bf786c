"""Versions of several tables: whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scholarframe.plans import versions


def test_a_write_that_dies_leaves_the_version_before(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    assert versions.read(spark, folder) == {} and versions.newest(spark, folder) == (0, {})
    table = lambda n, tag: spark.range(n).select("id", F.lit(tag).alias("tag"))
    assert versions.write(spark, folder, {"parents": table(3, "a"), "children": table(9, "a")}) == 1
    broken = spark.range(5).select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).cast("string").alias("tag"))
    with pytest.raises(Exception, match="lost"):
        versions.write(spark, folder, {"parents": table(4, "b"), "children": broken})
    now = versions.read(spark, folder)
    assert {k: (v.count(), v.first().tag) for k, v in now.items()} == {"parents": (3, "a"), "children": (9, "a")}
    assert versions.write(spark, folder, {"children": table(2, "c")}) == 2  # the other table stays
    after = versions.read(spark, folder)
    assert {k: (v.count(), v.first().tag) for k, v in after.items()} == {"parents": (3, "a"), "children": (2, "c")}
    assert now["children"].count() == 9  # readers of the version before go on with it


def test_children_go_with_their_parent(spark, tmp_path):
    parents, children = spark.createDataFrame([(1, "old"), (2, "old")], "doc int, title string"), spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc int, place int")
    got = versions.replace_children(parents, children, spark.createDataFrame([(1, "new"), (3, "new")], "doc int, title string"), spark.createDataFrame([(1, 7), (9, 0)], "doc int, place int"), "doc")
    assert sorted(map(tuple, got["parents"].collect())) == [(1, "new"), (2, "old"), (3, "new")]
    assert sorted(map(tuple, got["children"].collect())) == [(1, 7), (2, 0)]
