"""Several tables as one version: all of them are written, then a manifest that names them, and readers take the newest manifest.

A store is a folder.  A version's tables lie in a folder of their own, by a name that no other attempt has; nothing is ever written over.  Until its
manifest is there, a version doesn't exist for any reader, so a write that dies between two tables leaves the version before as it
was.  Of two writers that start from one version both manifests stay, and readers take that of the larger name: writers of one store
must take turns.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_manifests"


def newest(spark: SparkSession, folder: str) -> tuple[int, dict[str, str]]:
    """Number of the newest whole version and the paths of its tables; 0 and none for a store that has no version."""
    try:
        told = spark.read.schema("number long, name string, tables map<string,string>").parquet(f"{folder}/{MANIFESTS}/*")
    except AnalysisException:
        return 0, {}
    last = told.agg(F.max(F.struct("number", "name", F.to_json("tables").alias("tables"))).alias("m")).select("m.number", F.from_json("m.tables", "map<string,string>").alias("tables")).first()
    return (0, {}) if last is None or last["number"] is None else (last["number"], last["tables"])


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest version, all of one write."""
    return {name: spark.read.parquet(path) for name, path in newest(spark, folder)[1].items()}


def write(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> int:
    """Writes the tables as the next version; those of the version before that aren't named stay as they are.  Returns its number."""
    number, paths = newest(spark, folder)
    name = uuid.uuid4().hex
    for table, rows in tables.items():
        path = f"{folder}/{name}/{table}"
        rows.write.parquet(path)
        paths = paths | {table: path}
    manifest = spark.createDataFrame([(number + 1, name, paths)], "number long, name string, tables map<string,string>")
    manifest.coalesce(1).write.parquet(f"{folder}/{MANIFESTS}/{name}")
    return number + 1


def replace_children(parents: DataFrame, children: DataFrame, new_parents: DataFrame, new_children: DataFrame, key: str) -> dict[str, DataFrame]:
    """(parents, children) after the new ones were put in: a new parent takes the place of the old one of its key, and all of the
    old one's children go, whether or not new ones come.  Children without a new parent are left out."""
    asked = new_parents.select(key).distinct()
    kept = new_children.join(asked, key, "left_semi")
    return {
        "parents": parents.join(asked, key, "left_anti").unionByName(new_parents.select(parents.columns)),
        "children": children.join(asked, key, "left_anti").unionByName(kept.select(children.columns)),
    }
