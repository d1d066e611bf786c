"""Reading inputs and cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package: on one machine from where the driver has it, before whatever they look in
    already; on a cluster from an archive that Spark hands to every executor, once an application."""
    context = spark.sparkContext
    root, known = str(PACKAGE.parent), context.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if on_cluster(spark) and context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as archive:
            for file in sorted(PACKAGE.rglob("*.py")):
                archive.write(file, file.relative_to(PACKAGE.parent))
        # Only the driver reads this file; its file server sends it on.
        path = Path(tempfile.mkdtemp(prefix="scholarframe-")) / "scholarframe.zip"
        path.write_bytes(packed.getvalue())
        context.addPyFile(str(path))


def on_cluster(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master != "local" and not master.startswith("local[")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's reader, so that any file system it knows will do."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on a single machine, as in tests, a folder of our own.

    On a cluster an unset folder is an error: what an executor writes to its own disk, others would read as nothing."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if on_cluster(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scholarframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str = "table", batch_rows: int = 0) -> DataFrame:
    """Writes a table in the shared folder and reads it back: what follows starts from those files.

    With `batch_rows`, Arrow batches to Python have so many rows at most while it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    known = int(spark.conf.get(ARROW_ROWS))
    fewer = batch_rows > 0 and not 0 < known <= batch_rows
    if fewer:
        spark.conf.set(ARROW_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        if fewer:
            spark.conf.set(ARROW_ROWS, str(known))
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with each row's place in the order, from 1: range partitions are numbered each for itself, after the rows of those before."""
    ranges = settle(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for r in sorted(ranges.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        before.append((r["_range"], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(before, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return ranges.join(F.broadcast(starts), "_range").withColumn(name, place.cast("int")).drop("_range", "_before")
