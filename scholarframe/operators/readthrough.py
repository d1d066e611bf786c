"""Read-through caches with an injected callable: what is cached is joined, what isn't is computed once and handed back to be kept.

A cache is a table of (key, model, value).  Items with equal keys are one miss.  Misses go through the callable in batches on the
executors, and their values are settled before anything reads them, so a retry of a later stage calls nothing again.  The
callable takes a list of texts and returns as many values; it must give the same value for the same text, since
a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scholarframe.functions.text import cosine
from scholarframe.operators import rank
from scholarframe.plans.tables import settle

#: Texts of one call.
BATCH = 64


@dataclass
class Read:
    """rows: the items with value and cached (boolean); added: (key, model, value) of what was computed."""

    rows: DataFrame
    added: DataFrame


def _computed(batches: Iterator[pa.RecordBatch], compute: Callable[[list[str]], list], kind: pa.DataType, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            values = compute(part.column("text").to_pylist())
            if len(values) != part.num_rows:
                raise ValueError(f"{part.num_rows} texts gave {len(values)} values")
            yield pa.record_batch([part.column("key"), pa.array(values, kind)], ["key", "value"])


def read_through(items: DataFrame, cache: DataFrame, model: str, compute: Callable[[list[str]], list], batch: int = BATCH) -> Read:
    """items (key, text and any others) with the cache's values of `model`, and of the rest computed values.

    Every row of items stays.  Of rows with one key but several texts the smallest text is computed; a null text counts as an empty one, and a
    null key is never cached: its row has a null value.  Where the cache has a key several times its smallest value is read."""
    kind = cache.schema["value"].dataType
    held = cache.where(F.col("model") == model).groupBy("key").agg(F.min("value").alias("value"))
    wanted = items.where("key is not null").groupBy("key").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    missed = wanted.join(held, "key", "left_anti")
    key = dict(items.dtypes)["key"]
    arrow = to_arrow_type(kind)
    computed = settle(missed.mapInArrow(lambda it: _computed(it, compute, arrow, batch), f"key {key}, value {kind.simpleString()}"), "computed")
    values = held.withColumn("cached", F.lit(True)).unionByName(computed.withColumn("cached", F.lit(False)))
    return Read(items.join(values, "key", "left"), computed.select("key", F.lit(model).alias("model"), "value"))


def keep_new(cache: DataFrame, added: DataFrame) -> DataFrame:
    """The cache with the added rows whose key and model it hasn't got: insert or ignore, and of rows added twice one."""
    fresh = added.groupBy("key", "model").agg(F.min("value").alias("value")).join(cache.select("key", "model"), ["key", "model"], "left_anti")
    return cache.unionByName(fresh.select(cache.columns))


def embedded_text(title: Column, abstract: Column) -> Column:
    """What a work is embedded by: its title, and on the next line its abstract if it has one."""
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.nullif(abstract, F.lit("")))


def rank_by_meaning(works: DataFrame, key: str, query: str, cache: DataFrame, model: str, embed: Callable[[list[str]], list]) -> tuple[DataFrame, DataFrame]:
    """(works ranked by the similarity of their embeddings to the query's, rows to be kept in the cache).

    The query is embedded on the driver, one call; works go through the cache."""
    asked = F.array(*(F.lit(float(x)) for x in embed([query])[0]))
    read = read_through(works.select(F.col(key).alias("key"), embedded_text(F.col("title"), F.col("abstract")).alias("text")), cache, model, embed)
    near = read.rows.select(F.col("key").alias(key), F.round(cosine(F.col("value"), asked), 6).alias("similarity"))
    return rank.rank_by_similarity(works, near, key), read.added
