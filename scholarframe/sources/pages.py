"""Recorded result pages of literature sources as a Spark data source, with a range of years pushed down.

    spark.dataSource.register(PageSource)
    spark.read.format("literature_pages").option("path", folder).option("source", "openalex").load().where("year >= 2000")

A recording is a folder of one sub-folder per source and page with that page's payload, and an index of the pages: source,
page, first and last year, entries.  Each page is an input partition, or several are where there are many.  Comparisons of `year` are taken over: `words` puts the range
in the source's own language, pages whose years the index rules out are never opened, and of the others only entries in
the range are returned.  A page that can't be read costs its entries only: it gives one row with `error` set, if no range is asked
for.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from scholarframe.plans.tables import settle
from scholarframe.sources.records import ENTRIES, READERS, RECORD_SCHEMA

#: Input partitions of a source at most; with more pages than that, each takes several, so that tasks don't grow with the pages.
PARTITIONS = 256
SCHEMA = "source string, page long, position int, year int, payload string, error string"
INDEX = "_index"


@dataclass
class Range:
    """Years from first to last, both included; None is open.  `asked`: whether a null year is ruled out."""

    first: int | None = None
    last: int | None = None
    asked: bool = False

    def take(self, found: Filter) -> bool:
        """Narrows the range by a comparison of the year; False if it is none."""
        if getattr(found, "attribute", None) != ("year",):
            return False
        value = getattr(found, "value", None)
        lower = {EqualTo: value, GreaterThanOrEqual: value, GreaterThan: value + 1 if isinstance(value, int) else None}.get(type(found))
        upper = {EqualTo: value, LessThanOrEqual: value, LessThan: value - 1 if isinstance(value, int) else None}.get(type(found))
        if lower is None and upper is None and not isinstance(found, IsNotNull):
            return False
        self.asked = True
        if lower is not None:
            self.first = lower if self.first is None else max(self.first, lower)
        if upper is not None:
            self.last = upper if self.last is None else min(self.last, upper)
        return True

    def has(self, year: int | None) -> bool:
        if year is None:
            return not self.asked
        return (self.first is None or year >= self.first) and (self.last is None or year <= self.last)

    def meets(self, first: int | None, last: int | None) -> bool:
        """Whether a page of entries from first to last year (None: none has one) may hold an entry of the range."""
        if first is None or last is None:
            return not self.asked
        return (self.last is None or first <= self.last) and (self.first is None or last >= self.first)


def words(source: str, years: Range, this_year: int) -> str | None:
    """The range as the source's request has it; None without one, or if the source takes none."""
    if years.first is None and years.last is None:
        return None
    first, last = 1000 if years.first is None else years.first, this_year if years.last is None else years.last
    until = "" if years.last is None else f"until-pub-date:{years.last}-12-31"
    return {
        "openalex": f"publication_year:{first}-{last}",
        "crossref": ",".join(filter(None, ("" if years.first is None else f"from-pub-date:{years.first}-01-01", until))),
        "doaj": f"bibjson.year:[{first} TO {last}]",
        "europepmc": f"PUB_YEAR:[{first} TO {last}]",
        "semanticscholar": f"{'' if years.first is None else years.first}-{'' if years.last is None else years.last}",
    }.get(source)


@dataclass
class Page(InputPartition):
    source: str
    pages: list[int]
    request: str | None


def _year(entry: object, path: tuple) -> int | None:
    for step in path:
        try:
            entry = entry[step]
        except (KeyError, IndexError, TypeError):
            return None
    try:
        return int(entry)
    except (TypeError, ValueError):
        return None


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.source = options["path"].rstrip("/"), options["source"]
        self.this_year = int(options.get("this_year", 2026))
        self.years = Range()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.years.take(f)]

    def partitions(self) -> list[Page]:
        """The pages that may hold what is asked for, each with its request."""
        import pyarrow.dataset as ds

        system, folder = _opened(self.folder)
        known = ds.dataset(f"{folder}/{INDEX}", format="parquet", filesystem=system, exclude_invalid_files=True)
        own = known.to_table(filter=ds.field("source") == self.source).to_pylist()
        request = words(self.source, self.years, self.this_year)
        asked = sorted(r["page"] for r in own if self.years.meets(r["first"], r["last"]))
        size = -(-len(asked) // PARTITIONS) or 1
        return [Page(self.source, asked[k : k + size], request) for k in range(0, len(asked), size)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        for page in partition.pages if partition is not None else ():  # none: no page is left
            yield from self._entries(page)

    def _entries(self, page: int) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        system, folder = _opened(self.folder)
        root, path = ENTRIES[self.source]
        found = system.get_file_info(pafs.FileSelector(f"{folder}/source={self.source}/page={page}", allow_not_found=True))
        for file in sorted(f.path for f in found if not f.base_name.startswith(("_", "."))):
            with system.open_input_stream(file) as stream:
                text = stream.read()
            try:
                entries = json.loads(text)
                for step in root:
                    entries = entries[step]
                if not isinstance(entries, list):
                    raise TypeError(f"{root[-1]} is no list")
            except (ValueError, KeyError, TypeError) as error:
                if not self.years.asked:
                    yield self.source, page, None, None, None, type(error).__name__
                continue
            for position, entry in enumerate(entries):
                year = _year(entry, path)
                if self.years.has(year):
                    yield self.source, page, position, year, json.dumps(entry, ensure_ascii=False), None


def _opened(folder: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}")


class PageSource(DataSource):
    """Pages of one source of a recording; options: path, source, and this_year for open ends."""

    @classmethod
    def name(cls) -> str:
        return "literature_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:  # noqa: ANN001
        return PageReader(self.options)


def load(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Entries of the recorded pages of a source; filters on `year` reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    return spark.read.format(PageSource.name()).option("path", folder).option("source", source).load()


def fan_out(spark: SparkSession, folder: str, sources: list[str], name: str = "fan-out") -> tuple[DataFrame, DataFrame]:
    """(records of all sources, status of each): source, status, entries, failed_pages, records.

    One pass writes the records and counts on the way, by observed metrics: a page that can't be read costs its own entries and makes its
    source `partial`, a source that isn't recorded at all is an `error`, and neither stops the others."""
    known = {r["source"] for r in spark.read.parquet(f"{folder}/{INDEX}").select("source").distinct().collect()}
    seen: dict[str, tuple[Observation, Observation]] = {}
    found = None
    for source in sources:
        if source not in known or source not in READERS:
            continue
        read, made = seen[source] = Observation(), Observation()
        entries = load(spark, folder, source).observe(read, F.count_if(F.col("error").isNull()).alias("entries"), F.count_if(F.col("error").isNotNull()).alias("failed_pages"))
        own = READERS[source](spark, entries).observe(made, F.count("*").alias("records"))
        found = own if found is None else found.unionByName(own)
    if found is not None:
        found = settle(found, name)
    rows = []
    for source in sources:
        if source not in seen:
            rows.append((source, "error", 0, 0, 0))
            continue
        read, made = (o.get for o in seen[source])
        state = "ok" if not read["failed_pages"] else "partial" if read["entries"] else "error"
        rows.append((source, state, read["entries"], read["failed_pages"], made["records"]))
    status = spark.createDataFrame(rows, "source string, status string, entries long, failed_pages long, records long")
    return found if found is not None else spark.createDataFrame([], RECORD_SCHEMA), status


def totals(status: DataFrame, merged: DataFrame) -> DataFrame:
    """One row of a search: sources that succeeded, raw records, works after merging, and whether any source fell short."""
    told = status.agg(F.count_if(F.col("status") != "error").alias("succeeded"), F.sum("records").alias("raw"), F.coalesce(F.bool_or(F.col("status") != "ok"), F.lit(False)).alias("degraded"))
    return told.join(F.broadcast(merged.agg(F.count("*").alias("merged"))))


def record(entries: DataFrame, folder: str) -> None:
    """Writes entries (source, page, position, year, payload) as a recording: a payload per source and page, then the index.

    payload is an entry's JSON text, page the number of the page it is on; pages are of a bounded size by whoever numbers them."""
    part = F.struct("position", "payload")
    pages = entries.groupBy("source", "page").agg(F.sort_array(F.collect_list(part)).alias("all"), F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("entries"))
    listed = F.concat(F.lit("["), F.array_join(F.col("all.payload"), ","), F.lit("]"))
    wrapped = listed
    for source, (root, _) in ENTRIES.items():
        body = F.concat(F.lit("".join(f'{{"{k}":' for k in root)), listed, F.lit("}" * len(root)))
        wrapped = F.when(F.col("source") == source, body).otherwise(wrapped)
    pages.select("source", "page", wrapped.alias("value")).write.partitionBy("source", "page").text(folder)
    pages.select("source", "page", "first", "last", "entries").write.parquet(f"{folder}/{INDEX}")
