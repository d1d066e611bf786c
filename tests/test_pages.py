"""Recorded pages: ranges pushed to the reader, pages not opened, and what a broken page costs."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, IsNotNull, LessThan

from scholarframe.sources import pages, records


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Ten pages of five works of one source, a year a page, the last without years, and one page of another source."""
    path = f"file://{tmp_path_factory.mktemp('pages')}/recorded"
    year = "case when id < 45 then cast(2000 + id div 5 as int) end"
    entries = spark.range(50).selectExpr("'openalex' AS source", "id div 5 AS page", "cast(id % 5 AS int) AS position", f"{year} AS year", f"to_json(named_struct('id', concat('W', id), 'title', concat('Title ', id), 'publication_year', {year})) AS payload")
    more = spark.range(3).selectExpr("'crossref' AS source", "0L AS page", "cast(id AS int) AS position", "2003 AS year", "concat('{\"DOI\":\"10.1/', id, '\",\"title\":[\"T\"],\"published\":{\"date-parts\":[[2003]]}}') AS payload")
    pages.record(entries.union(more), path)
    return path


def test_ranges_reach_the_reader(spark, folder):
    found = pages.load(spark, folder, "openalex").where("year > 2001 and year <= 2004")
    assert sorted(r.year for r in found.collect()) == [2002] * 5 + [2003] * 5 + [2004] * 5
    assert found.rdd.getNumPartitions() == 3  # of ten pages seven are never opened
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "")
    assert pages.load(spark, folder, "openalex").rdd.getNumPartitions() == 10
    assert pages.load(spark, folder, "openalex").where("year = 2050").count() == 0
    assert pages.load(spark, folder, "openalex").where("page = 3 and year >= 2000").count() == 5


def test_requests_are_in_the_source_s_words():
    def asked(source, *filters):
        reader = pages.PageReader({"path": "/none", "source": source})
        left = list(reader.pushFilters(list(filters)))
        return pages.words(source, reader.years, 2026), len(left)

    year = ("year",)
    both = (GreaterThanOrEqual(year, 1999), LessThan(year, 2005), IsNotNull(year))
    assert asked("openalex", *both) == ("publication_year:1999-2004", 0)
    assert asked("crossref", *both) == ("from-pub-date:1999-01-01,until-pub-date:2004-12-31", 0)
    assert asked("crossref", GreaterThan(year, 1999)) == ("from-pub-date:2000-01-01", 0)
    assert asked("semanticscholar", LessThan(year, 2005)) == ("-2004", 0)
    assert asked("europepmc", EqualTo(year, 2001), EqualTo(("page",), 1)) == ("PUB_YEAR:[2001 TO 2001]", 1)
    assert asked("doaj", GreaterThan(year, 2010)) == ("bibjson.year:[2011 TO 2026]", 0)
    assert asked("core", *both) == (None, 0) and asked("openalex", IsNotNull(year)) == (None, 0)


def test_a_truncated_page_costs_its_own_entries(spark, folder, tmp_path):
    import shutil

    broken = f"{tmp_path}/broken"
    shutil.copytree(folder.removeprefix("file://"), broken)
    page = next(Path(f"{broken}/source=openalex/page=4").glob("part-*"))
    Path(f"{broken}/source=openalex/page=4/.{page.name}.crc").unlink(missing_ok=True)
    page.write_text(page.read_text()[:60])
    found, status = pages.fan_out(spark, f"file://{broken}", ["openalex", "crossref", "doaj"])
    assert sorted(tuple(r) for r in status.collect()) == [("crossref", "ok", 3, 0, 3), ("doaj", "error", 0, 0, 0), ("openalex", "partial", 45, 1, 45)]
    assert found.count() == 48 and {r.source_record_id for r in found.where("source_id = 'openalex'").collect()} == {f"W{i}" for i in range(50) if i // 5 != 4}
    told = pages.totals(status, found.select("title").distinct()).first()
    assert (told.succeeded, told.raw, told.merged, told.degraded) == (2, 48, 46, True)
    none, status = pages.fan_out(spark, f"file://{broken}", ["core"])
    assert none.count() == 0 and status.first().status == "error" and set(none.columns) == set(records.RECORD)
