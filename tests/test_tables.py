"""Shared folders and shipping of the package."""

from __future__ import annotations

import pytest

from scholarframe.plans import tables


class _Conf:
    def get(self, key, default=None):
        return default


class _Session:
    """A session that only tells its master."""

    conf = _Conf()

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})()


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_unset_shared_folder_is_an_error_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(_Session(master))


def test_worker_path_is_extended(spark):
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    spark.sparkContext.environment["PYTHONPATH"] = "/somewhere/else"
    tables.importable(spark)
    tables.importable(spark)
    assert spark.sparkContext.environment["PYTHONPATH"].split(":") == [str(tables.PACKAGE.parent), "/somewhere/else"]
    spark.sparkContext.environment["PYTHONPATH"] = known or str(tables.PACKAGE.parent)


def test_settled_tables_are_read_from_the_shared_folder(spark):
    made = tables.settle(spark.range(5), "five")
    assert made.count() == 5 and all(f.startswith(tables.shared_dir(spark)) or tables.shared_dir(spark).removeprefix("file://") in f for f in made.inputFiles())
