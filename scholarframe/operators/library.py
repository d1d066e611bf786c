"""Written state as tables: caches with an expiry, saved items and collections, matrices, extraction, manuscripts.

A write takes the table as it is and the rows asked for, and returns the table as it is after; whoever owns the
files writes it as a new version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.operators.evidence import latest, missing_pairs, upsert
from scholarframe.operators.integrate import same_work

#: Revisions that a manuscript keeps, and seconds between two of them at least.
MAX_REVISIONS, REVISION_SECONDS = 20, 300


def put_cached(cache: DataFrame, new: DataFrame, keys: list[str], now: Column, ttl: Column) -> DataFrame:
    """cache with `new` rows, the last of each key (by `asked`), in place of or besides its own; they expire `ttl` from now."""
    last = latest(new, keys, ["asked"]).drop("asked")
    return upsert(cache, last.withColumn("expires_at", now + ttl), keys)


def upsert_works(old: DataFrame, new: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(works, refused): the stored works after `new` was put in, by work_key, and new rows that were refused.

    Both have work_key, abstract and the same columns; `order` is new's, and of rows with one key the last is put in.  A key made from a DOI is
    the same work always and is overwritten.  One made from other fields may be another work's: it is overwritten only if the abstracts look like
    the same work's."""
    last = latest(new, ["work_key"], [order]).drop(order)
    held = old.select("work_key", F.col("abstract").alias("_held"), F.lit(True).alias("_known"))
    told = last.join(held, "work_key", "left").withColumn("_may", F.col("_known").isNull() | F.col("work_key").startswith("doi:") | same_work(F.col("_held"), F.col("abstract")))
    put = told.where("_may").select(*old.columns)
    return old.join(put.select("work_key"), "work_key", "left_anti").select(*old.columns).unionByName(put), told.where("not _may").select(*old.columns)


def fresh(cache: DataFrame, now: Column) -> DataFrame:
    """Rows that have not expired; others are misses."""
    return cache.where(F.col("expires_at") >= now)


def owned_by(rows: DataFrame, user: Column) -> DataFrame:
    """Rows of one owner: another's is the same as none."""
    return rows.where(F.col("user_id") == user)


def delete_owned(rows: DataFrame, asked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows left, asked with `deleted`): asked has user_id and keys; only rows of the asking user go."""
    on = ["user_id", *keys]
    gone = asked.select(*on).distinct()
    found = rows.select(*on).distinct().withColumn("deleted", F.lit(True))
    told = asked.join(found, on, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return rows.join(gone, on, "left_anti"), told


def create_collections(collections: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with `created`: a name is new to its user once, the first asked for, and never where it stands already.

    collections has user_id and name, asked user_id, name and asked, the order of asking."""
    first = F.row_number().over(Window.partitionBy("user_id", "name").orderBy("asked")) == 1
    known = collections.select("user_id", "name").distinct().withColumn("known", F.lit(True))
    return asked.withColumn("first", first).join(known, ["user_id", "name"], "left").withColumn("created", F.col("first") & F.col("known").isNull()).drop("first", "known")


def fill_pairs(rows: DataFrame, columns: DataFrame, cells: DataFrame, force: bool = False, row_id: int | None = None, column_id: int | None = None) -> DataFrame:
    """Pairs (matrix_id, row_id, column_id) to fill: those missing or failed, or with `force` all; within one row or column if given."""
    rows = rows if row_id is None else rows.where(F.col("row_id") == row_id)
    columns = columns if column_id is None else columns.where(F.col("column_id") == column_id)
    return rows.join(columns, "matrix_id") if force else missing_pairs(rows, columns, cells)


def save_cells(cells: DataFrame, new: DataFrame) -> DataFrame:
    """cells with new ones in place of or besides them; equal cells are written once, the last by `asked`."""
    return upsert(cells, latest(new, ["matrix_id", "row_id", "column_id"], ["asked"]).drop("asked"), ["matrix_id", "row_id", "column_id"])


def remove_from_matrix(parts: DataFrame, cells: DataFrame, gone: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """(rows or columns left, cells left): a removed row or column, named by `part`, takes its cells along."""
    on = ["matrix_id", part]
    return parts.join(gone.select(*on), on, "left_anti"), cells.join(gone.select(*on), on, "left_anti")


def extraction_status(marks: DataFrame) -> DataFrame:
    """The last mark of each document and kind: marks has document_id, kind, status, error and asked."""
    return latest(marks, ["document_id", "kind"], ["asked"]).drop("asked")


def fill_tallies(cells: DataFrame) -> DataFrame:
    """Of each matrix: cells run, found, not reported, failed."""
    count = lambda s: F.count_if(F.col("status") == s)
    return cells.groupBy("matrix_id").agg(F.count("*").alias("ran"), count("found").alias("filled"), count("not_reported").alias("not_reported"), count("error").alias("errors"))


def save_manuscripts(manuscripts: DataFrame, patches: DataFrame) -> DataFrame:
    """manuscripts after the owner's last patch of each: a null in a patch leaves the field, others' patches do nothing.

    patches has user_id, public_id, asked and any of the manuscripts' fields."""
    on = ["user_id", "public_id"]
    last = latest(patches, on, ["asked"])
    fields = [c for c in last.columns if c not in (*on, "asked")]
    patch = last.select(*on, *(F.col(c).alias(f"new_{c}") for c in fields), F.col("asked").alias("saved_at"))
    joined = manuscripts.join(patch, on, "left")
    return joined.select(*on, *(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in manuscripts.columns if c not in on), F.col("saved_at"))


def revisions(saves: DataFrame, seconds: int = REVISION_SECONDS, keep: int = MAX_REVISIONS) -> DataFrame:
    """(manuscript_id, save_id, at) of the saves that leave a revision: the first, and each that comes `seconds` or
    more after the last one that did; of those the newest `keep`.

    saves has manuscript_id, save_id and at, in seconds.  A manuscript's saves stream through one task in
    order, sorted and spilled by Spark; only the time of the last revision is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, last = None, None
        for batch in batches:
            left = []
            for manuscript, at in zip(batch.column("manuscript_id").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if manuscript != owner:
                    owner, last = manuscript, None
                left.append(last is None or at - last >= seconds)
                last = at if left[-1] else last
            yield batch.filter(pa.array(left, pa.bool_()))

    rows = saves.where("manuscript_id is not null and at is not null").select("manuscript_id", "save_id", "at")
    dealt = rows.repartition("manuscript_id").sortWithinPartitions("manuscript_id", "at", "save_id")
    newest = F.row_number().over(Window.partitionBy("manuscript_id").orderBy(F.col("at").desc(), F.col("save_id").desc()))
    return dealt.mapInArrow(run, rows.schema).withColumn("k", newest).where(F.col("k") <= keep).drop("k")


def record_usage(sources: DataFrame, usage: DataFrame, now: Column) -> DataFrame:
    """sources after a period's usage: tokens start anew in a new month, dormancy ends, a spent cap exhausts.

    sources has id, status, monthly_token_cap, tokens_used_period, period_starts_at and dormant_until; usage has id and
    tokens, of which only positive ones count."""
    used = usage.where("tokens > 0").groupBy("id").agg(F.sum("tokens").alias("new"))
    rolled = F.date_trunc("month", "period_starts_at") < F.date_trunc("month", now)
    total = F.when(rolled, F.col("new")).otherwise(F.col("tokens_used_period") + F.col("new"))
    state = F.when(F.col("status") == "disabled", "disabled").when(total >= F.col("monthly_token_cap"), "exhausted").otherwise("active")
    after = {"status": state, "tokens_used_period": total, "period_starts_at": F.when(rolled, F.date_trunc("month", now)).otherwise(F.col("period_starts_at")), "dormant_until": F.lit(None)}
    joined = sources.join(used, "id", "left")
    kept = [F.when(F.col("new").isNotNull(), after[c].cast(t)).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c, t in sources.dtypes]
    return joined.select(*kept)


def all_down(statuses: DataFrame, group: str) -> DataFrame:
    """(group, down): whether a search has statuses and none of them is ok."""
    return statuses.groupBy(group).agg(F.bool_and(F.col("status") != "ok").alias("down"))


def may_run(need: Column, balance: Column, allowance: Column, used: Column, used_at: Column, now: Column) -> Column:
    """Whether a feature may run: an account, whose balance is not null, covers it; without one the month's allowance does,
    of which a use before this month no longer counts."""
    spent = F.when(F.date_trunc("month", used_at) < F.date_trunc("month", now), 0).otherwise(F.coalesce(used, F.lit(0)))
    return F.when(balance.isNotNull(), balance >= need).otherwise(F.greatest(F.lit(0), allowance - spent) >= need)
